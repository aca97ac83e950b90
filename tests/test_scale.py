"""What queries must not do if they are to run over large tables: told by their plans and by odd rows."""

import os
import random
import unicodedata

from pyspark.sql import functions as F

from arbor.functions import text as T
from arbor.operators import toc
from arbor.plans import registry
from arbor.plans import views as V
from tests.test_text_tree import plain_norm, plain_tokens

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_composition_needs_no_python(spark):
    r = random.Random(5)
    pool = list("ab -—–−’‘\n\t\r\x0b\x0c\x1c\x1f\u0085    　ﬁ²Åé가가ﾊﾟ㍿Ⅷß9")
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(500)] + [None, "", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.nfkc(F.col("t")).alias("c"), T.normalized(F.col("t")).alias("n"))
    rows = rows.withColumn("toks", T.tokens(F.col("n")))
    assert "Python" not in plan_of(rows)
    for x in rows.collect():
        t = texts[x.k]
        assert x.c == (None if t is None else unicodedata.normalize("NFKC", t)) and x.n == plain_norm(t) and x.toks == plain_tokens(x.n)


def test_a_query_that_asks_once_saves_no_index_and_deals_texts_once(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    for name in ("title_lookup", "postings", "doc_frequency", "postings_union", "bm25_total", "score_full"):
        df = registry.queries()[name](spark, DATA)
        assert plan_of(df).count("Exchange hashpartitioning") <= 1, name
    assert set(os.listdir(folder)) == before


def test_documents_that_share_an_id_or_have_none_are_put_together(spark, tmp_path):
    rows = [(1, "one line\n\n two  words", "en", "a"), (1, "other line", "en", "a"), (None, "no id", "en", "b"), (2, None, "en", "b")]
    for name, some, lone in (("shared", rows, False), ("own", rows[:1] + rows[3:], True)):
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert V.one_row_each(spark, f"{tmp_path}/{name}") == lone
        got, want = V.doc_nodes(spark, f"{tmp_path}/{name}"), V._nodes_of_lines(spark, f"{tmp_path}/{name}")
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert [(r.page_no, r.text, r.token_count) for r in V.paged(spark, f"{tmp_path}/own").collect()] == [(1, "one line\n two  words", 4)]


def test_trees_of_headings_are_dealt_once_and_joined_to_nothing(spark):
    for name in ("subtree_tokens", "thinning"):
        plan = plan_of(registry.queries()[name](spark, DATA))
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, name


def test_parents_by_code_need_no_join(spark):
    rows = [("a", 1, "1"), ("a", 2, "1.1"), ("a", 3, "1"), ("a", 4, "1.2"), ("a", 5, None), (None, 6, "1"), (None, 7, "1.1"), ("b", 8, "1.1.1")]
    got = toc.parents_by_code(spark.createDataFrame(rows, "doc_id string, pos int, structure string"))
    assert "Join" not in plan_of(got)
    assert {r.pos: r.parent_pos for r in got.collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None, 7: None, 8: None}


def test_groups_of_pages_equal_the_plain_ones(spark):
    r = random.Random(3)
    rows = [(f"d{d}", k, f"{d}.{k};", r.choice([0, 1, 40, 90, 300])) for d in range(40) for k in range(1, r.randint(2, 30))]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string, token_count int")
    got = toc.grouped_pages(pages, 100)
    assert "Pandas" not in plan_of(got)
    found = {(x.doc_id, x.part): x.text for x in got.collect()}
    want = {(d, k): t for d, own in pages.toPandas().groupby("doc_id") for k, t in enumerate(toc.page_groups(own.sort_values("page_no"), 100))}
    assert found == want


def test_lines_of_contents_are_parsed_once(spark):
    for name in ("toc_parse", "toc_detect"):
        plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("\\d{1,4}" in line for line in plan.splitlines()) == 1, name


def test_a_blank_text_has_an_empty_snippet(spark, tmp_path):
    spark.createDataFrame([(1, " \n "), (2, ""), (3, None), (4, "one nation")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.snippet for r in registry.queries()["snippet"](spark, str(tmp_path)).collect()} == {1: "", 2: "", 3: None, 4: "one nation"}
