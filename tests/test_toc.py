import pandas as pd
from pyspark.sql import functions as F

from arbor.operators import toc


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r


def test_lines_of_contents(spark):
    cases = {
        "1.2 Methods and data   17": ("1.2", "Methods and data", 17), "- Outlook : 9": (None, "Outlook", 9), "A) Notes 3": ("A", "Notes", 3), "Contents": None, "12 | Page 4": None, "Page 3 / 9": None, "ab": None, "x" * 230 + " 3": None,
        "12345 67": None, "No page here": None,
    }
    for line, want in cases.items():
        got = one(spark, line, toc.parsed_line)
        assert (tuple(got) if got else None) == want, line


def test_contents_pages_and_their_run(spark):
    yes = "Table of Contents\n1 Introduction 1\n2 The longer story .... 12"
    assert one(spark, yes, toc.is_toc_page) and one(spark, "plain\ntext 3", toc.is_toc_page) is None
    pages = spark.createDataFrame([("d", k, k in (2, 3, 5)) for k in range(1, 8)] + [("late", k, k > 22) for k in range(1, 25)], "doc_id string, page_no int, is_toc boolean")
    assert [r.page_no for r in toc.toc_run(pages).orderBy("page_no").collect()] == [2, 3]


def test_entries_once_and_only_if_there_are_enough(spark):
    rows = [("d", 1, "1 Alpha 1"), ("d", 2, "1 ALPHA 1"), ("d", 3, "2 Beta 4"), ("d", 4, "3 Gamma 9"), ("few", 1, "1 Alpha 1"), ("few", 2, "2 Beta 2")]
    got = toc.toc_entries(spark.createDataFrame(rows, "doc_id string, line_no int, line string")).orderBy("pos").collect()
    assert [(r.doc_id, r.pos, r.title) for r in got] == [("d", 1, "Alpha"), ("d", 2, "Beta"), ("d", 3, "Gamma")]


def test_specificity(spark):
    score = lambda t, p=None: spark.createDataFrame([(t, p)], "t string, p string").select(toc.specificity(F.col("t"), F.col("p")).alias("r")).first().r
    assert score("") == -1000 and score("Overview") == -40 and score("1.2 Overview") == -20 and score("Table 3: numbers") == 105
    assert score("Growth", "Section 2: growth") == -80 and score("one two three four five") == 20


def test_cleaning_of_generated_entries(spark):
    rows = [("d", 1, "Overview", 1, None), ("d", 2, "Table 1: sales", 1, None), ("d", 3, "Results", 2, None), ("d", 4, "results", 2, None), ("d", 5, "Results", 3, None), ("d", 6, "Results", 4, None), ("d", 7, "Results", 6, None)]
    got = toc.cleaned_entries(spark.createDataFrame(rows, "doc_id string, pos int, title string, physical_index int, parent_title string")).orderBy("rank").collect()
    assert [(r.title, r.physical_index) for r in got] == [("Table 1: sales", 1), ("Results", 2), ("Results", 6)]


def test_offset_is_the_first_of_the_most_frequent(spark):
    found = spark.createDataFrame([("d", k, t, p, 1) for k, (t, p) in enumerate([("a", 5), ("b", 8), ("c", 9), ("e", 14)])], "doc_id string, pos int, title string, physical_index int, start_page int")
    printed = spark.createDataFrame([("d", k, t, p) for k, (t, p) in enumerate([("a", 1), ("b", 3), ("c", 5), ("e", 9), ("f", 11)])], "doc_id string, pos int, title string, page int")
    offsets = toc.page_offset(toc.matching_pages(printed, found))
    assert offsets.first().offset == 4
    assert {r.title: r.physical_index for r in toc.with_offset(printed, offsets).collect()}["f"] == 15


def test_pages_between_neighbours_preface_and_parents(spark):
    items = spark.createDataFrame([("d", 1, "1", "A", 3), ("d", 2, "1.1", "B", None), ("d", 3, "1.2.9", "C", 99), ("d", 4, "1", "D", 7), ("d", 5, "1.3", "E", 8)], "doc_id string, pos int, structure string, title string, physical_index int")
    last = spark.createDataFrame([("d", 20)], "doc_id string, last_page int")
    ranged = toc.within_pages(items, last)
    assert [(r.low, r.high) for r in toc.neighbours(ranged, last).orderBy("pos").collect()][1:3] == [(3, 7), (3, 7)]
    assert [(r.pos, r.title) for r in toc.with_preface(items).orderBy("pos").collect()][0] == (0, "Preface")
    assert [r.parent_pos for r in toc.parents_by_code(items).orderBy("pos").collect()] == [None, 1, None, None, 4]


def test_heading_lines(spark):
    for line, want in {"1.1 Scope of work": True, "INTRODUCTION": True, "The Annual Report": True, "this is a sentence of prose": False, "Ends with a stop.": False, "a": False, "12 34": False}.items():
        assert one(spark, line, toc.looks_like_heading) == want, line


def test_split_without_a_model(spark):
    pages = spark.createDataFrame([("d", k, f"1.{k} Heading number {k}\nsome text that goes on and on.", 100) for k in range(1, 5)], "doc_id string, page_no int, text string, token_count int")
    nodes = spark.createDataFrame([("d", [7], "Whole", 1, 4)], "doc_id string, key array<int>, title string, start_index int, end_index int")
    got = toc.recursive_split(nodes, pages).orderBy("key").collect()
    assert [(r.title, r.start_index, r.end_index) for r in got] == [(f"1.{k} Heading number {k}", k, k) for k in range(1, 5)]
    assert got[0].key == [7, 1]


def test_candidates_skip_a_title_kept_on_the_page_before(spark):
    pages = spark.createDataFrame([("d", k, t) for k, t in ((1, "Annual Report\nFirst Part"), (2, "First Part\nSecond Part"), (3, "First Part"))], "doc_id string, page_no int, text string")
    parents = spark.createDataFrame([("d", "annual report")], "doc_id string, parent_title string")
    got = toc.heading_candidates(pages, parents).orderBy("rank").collect()
    assert [(r.title, r.physical_index) for r in got] == [("First Part", 1), ("Second Part", 2), ("First Part", 3)]


def test_groups_of_pages():
    pages = pd.DataFrame({"text": list("abcdef"), "token_count": [40] * 6})
    assert toc.page_groups(pages, 1000) == ["abcdef"]
    assert toc.page_groups(pages, 100) == ["ab", "bc", "cd", "de", "ef"]
    assert toc.toc_chunks(["x" * 10] * 50, 24, 3500) == ["\n".join(["x" * 10] * 24)] * 2 + ["\n".join(["x" * 10] * 2)]
    assert toc.toc_chunks(["y" * 2000] * 3, 24, 3500) == ["y" * 2000] * 3


def test_trees_of_pages(spark):
    from arbor.operators.pages import page_tree

    body = ["Introduction\nwords", "more", "Methods\nwords", "Data sources\nwords", "tail", "Results\nwords", "end"]
    contents = "Table of Contents\n1 Introduction ..... 1\n2 Methods ..... 3\n2.1 Data sources .... 4\n3 Results ..... 6"
    texts = [contents.replace(".....", " ").replace("....", " ").replace("..", " "), *body]
    rows = [("toc", k, t, len(t.split())) for k, t in enumerate(texts, 1)] + [("plain", k, "nothing here to see, really.", 5) for k in (1, 2)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string, token_count int")
    got = page_tree(pages).orderBy("doc_id", "node_idx").collect()
    toc_nodes = [(r.title, r.start_index, r.end_index, r.parent_id, r.is_leaf) for r in got if r.doc_id == "toc"]
    assert toc_nodes == [("Preface", 1, 1, None, True), ("Introduction", 2, 3, None, True), ("Methods", 4, 4, None, False), ("Data sources", 5, 6, "0002", True), ("Results", 7, 8, None, True)]
    (root,) = [r for r in got if r.doc_id == "plain"]
    assert (root.title, root.start_index, root.end_index) == ("plain", 1, 2) and root.text.startswith("nothing")
