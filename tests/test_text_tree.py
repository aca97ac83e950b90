import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from arbor.functions import text as T
from arbor.operators import tree
from arbor.sources import files

TEXTS = ["  Hello\n  World ", "End-to-End—test’s", "x² ﬁne Å  É", "foo_bar baz-1-b", "", None, "a b c", "“q” 'x' −5"]


def plain_norm(t):
    t = unicodedata.normalize("NFKC", t or "").lower()
    for a, b in (("—", "-"), ("–", "-"), ("−", "-"), ("’", "'"), ("‘", "'")):
        t = t.replace(a, b)
    return re.sub(r"\s+", " ", t).strip()


def plain_tokens(norm):
    out = []
    for t in re.findall(r"[^\W_]+(?:-[^\W_]+)*", norm):
        out += [t, *t.split("-")] if "-" in t else [t]
    return out


def test_normalise_and_tokenise(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    norm = T.normalized(F.col("t"))
    for r in rows.select("k", norm.alias("n"), T.tokens(norm).alias("toks")).collect():
        assert r.n == plain_norm(TEXTS[r.k])
        assert r.toks == plain_tokens(r.n)


def test_phrases_and_counts(spark):
    r = spark.createDataFrame([('find "Deep  Learning" and "x"',)], "q string").select(T.phrases(F.col("q")).alias("p"), T.term_counts(T.tokens(F.lit("a b a-b"))).alias("c")).first()
    assert r.p == ["deep learning", "x"]
    assert [(c.term, c.positions) for c in r.c] == [("a", [0, 3]), ("b", [1, 4]), ("a-b", [2])]


def test_parents_equal_a_stack(spark):
    r = random.Random(1)
    rows = [(str(d), k, r.randint(0, 6)) for d in range(60) for k in range(1, r.randint(2, 25))]
    got = {(x.doc_id, x.pos): (x.parent_pos, x.end_pos) for x in tree.subtree_ends(tree.with_parents(spark.createDataFrame(rows, "doc_id string, pos int, level int"))).collect()}
    for d in {x[0] for x in rows}:
        stack, own = [], [x for x in rows if x[0] == d]
        for _, pos, level in own:
            while stack and stack[-1][1] >= level:
                stack.pop()
            end = next((p for _, p, q in own if p > pos and q <= level), own[-1][1] + 1) - 1
            assert got[(d, pos)] == (stack[-1][0] if stack else None, end)
            stack.append((pos, level))


MARKDOWN = "lost\n# One\ntext a\n  ## not a heading\n```\n# in a fence\n```\n## Two\n\nbody\n### Three ###\nend"


def test_markdown(spark):
    lines = tree.markdown_lines(spark.createDataFrame([("d", MARKDOWN), ("none", "just text")], "doc_id string, value string"))
    s = tree.sections(tree.markdown_headings(lines), "line_no", "line").orderBy("pos").collect()
    assert [(x.level, x.title, x.line_num) for x in s] == [(1, "One", 2), (2, "Two", 8), (3, "Three ###", 11)]
    assert s[0].text == "# One\ntext a\n  ## not a heading\n```\n# in a fence\n```" and s[1].text == "## Two\n\nbody"
    nodes = tree.linked_nodes(tree.numbered(tree.with_parents(tree.sections(tree.markdown_headings(lines), "line_no", "line")), 1)).orderBy("node_idx").collect()
    assert [(n.node_id, n.parent_id, n.depth, n.is_leaf) for n in nodes] == [("0001", None, 1, False), ("0002", "0001", 2, False), ("0003", "0002", 3, True)]
    assert nodes[2].path_titles == ["One", "Two", "Three ###"] and nodes[2].ancestor_ids == ["0001", "0002"]


def test_word_paragraphs(spark):
    rows = [("a", 1, "Title", "The file", "a"), ("a", 2, "Heading 1", "First", "a"), ("a", 4, "Normal", "text", "a"), ("b", 1, "Normal", "only", "b"), ("b", 2, None, "text", "b")]
    got = tree.paragraph_sections(spark.createDataFrame(rows, "doc_id string, par_no int, style string, text string, stem string")).orderBy("doc_id", "pos").collect()
    assert [(x.doc_id, x.level, x.title, x.text) for x in got] == [("a", 0, "The file", "The file"), ("a", 1, "First", "First\ntext"), ("b", 1, "b", "only\ntext")]
    levels = [r[0] for r in spark.createDataFrame([(s,) for s in ("heading 3", "标题 2", "TITLE", "Heading 12", None)], "s string").select(tree.style_level(F.col("s"))).collect()]
    assert levels == [3, 2, 0, None, None]


def test_thinning_folds_small_subtrees(spark):
    rows = [("d", 1, 1, "a", "w " * 50), ("d", 2, 2, "b", "one two"), ("d", 3, 3, "c", "three"), ("d", 4, 2, "e", "w " * 30), ("d", 5, 1, "f", "x")]
    got = tree.thinned(spark.createDataFrame(rows, "doc_id string, pos int, level int, title string, text string"), 10).orderBy("pos").collect()
    assert [x.title for x in got] == ["a", "b", "e", "f"] and got[1].text == "one two\n\nthree"


TREE = {"doc_name": "t", "structure": [{"title": "A", "node_id": "0000", "start_index": 1, "end_index": 4, "nodes": [{"title": "B", "summary": "sum", "line_num": 2}, {"text": "x y", "start_index": 3}]}, {"title": "C"}]}


def test_flatten_and_nest(spark):
    rows = tree.flatten_json(spark.createDataFrame([("t", json.dumps(TREE))], "doc_id string, value string"))
    got = rows.orderBy("node_idx").collect()
    assert [(x.node_id, x.start_index, x.end_index, x.depth, x.parent_id, x.is_leaf) for x in got] == [("0000", 1, 4, 1, None, False), ("auto-0001", 2, 2, 2, "0000", True), ("auto-0002", 3, 3, 2, "0000", True), ("auto-0003", 0, 0, 1, None, True)]
    assert got[0].child_ids == ["auto-0001", "auto-0002"] and got[2].path_titles == ["A"] and got[2].token_count == 2
    back = json.loads(tree.nested_json(rows).first().value)["structure"]
    assert [n["title"] for n in back] == ["A", "C"] and back[0]["nodes"][0]["summary"] == "sum"
    assert [r.line for r in tree.outline(rows).orderBy("node_idx").collect()] == ["A", "  B", "  ", "C"]


def test_page_text_and_reattached_text(spark):
    pages = spark.createDataFrame([("d", 1, "p1"), ("d", 2, "p2"), ("d", 3, "p3")], "doc_id string, page_no int, text string")
    nodes = spark.createDataFrame([("d", "n1", 1, 2, ""), ("d", "n2", 3, 2, "")], "doc_id string, node_id string, start_index int, end_index int, text string")
    assert {r.node_id: r.text for r in tree.page_text(nodes, pages).collect()} == {"n1": "p1p2", "n2": ""}
    own = spark.createDataFrame([("d", 1, "A", "old"), ("d", 2, "B", "old")], "doc_id string, line_num int, title string, text string")
    new = spark.createDataFrame([("d", 1, "A", "new"), ("d", 2, "X", "other")], "doc_id string, line_num int, title string, text string")
    assert {r.title: r.text for r in tree.with_text(own, new).collect()} == {"A": "new", "B": "old"}
    assert tree.has_text(own).first().has_text


def test_html_and_ids(spark):
    html = "<html><title>T</title><script>x<p>no</p></script><h2 class='a'>Head <b>line</b></h2><p>para\n one</p><li></li></html>"
    got = files.html_blocks(spark.createDataFrame([(1, html)], "doc_id long, html string")).collect()
    assert [(r.level, r.text) for r in got] == [(0, "T"), (2, "Head line"), (None, "para one")]
    paths = spark.createDataFrame([(p,) for p in ("/a/My File.md", "/b/my file.MD", "/c/x.y.docx")], "path string")
    assert [r.doc_id for r in files.with_doc_ids(paths).orderBy("path").collect()] == ["my-file", "my-file-2", "x.y"]
    assert files.excluded("/a/b/draft.md", ["draft.md"]) and files.excluded("/a/b/c.md", ["b/*.md"]) and not files.excluded("/a/b/c.md", ["d/*.md"])
