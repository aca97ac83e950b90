"""Tables of contents and headings of page-oriented documents: finding, parsing, cleaning, paging, nesting, splitting."""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions.text import SPACE, compact, let
from arbor.operators.lineage import cut
from arbor.operators.tree import in_document
from arbor.settings import HEADING_PATTERNS

# Lines that are no entries, and titles that say little.
IGNORED_LINES = ("table of contents", "contents")
GENERIC_TITLES = ("overview", "background", "design goals", "implementation details", "testing notes", "detailed findings", "summary", "conclusion")
LINE_LENGTH = (4, 220)
STRONG = 60
FEWEST_ENTRIES = 3
_PREFIX = r"^[A-Z]?\d+(?:\.\d+)*\s+"


def toc_line(line: Column) -> Column:
    """A line with single blanks and without the marks of a list at its ends."""
    return F.btrim(compact(line), F.lit("-*• "))


def _all(lines: Column) -> Column:
    return F.filter(F.transform(lines, toc_line), lambda x: x != "")


def is_toc_page(text: Column) -> Column:
    """True where a page shows a heading of contents and enough lines that end in a page number, else null (undecided)."""
    return let(_all(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")), _shows_contents)


def _shows_contents(lines: Column) -> Column:
    head = F.exists(F.slice(lines, 1, 5), lambda x: F.lower(x).isin(*IGNORED_LINES) | F.lower(x).startswith("table of contents"))
    named = F.exists(F.slice(lines, 1, 12), lambda x: F.contains(F.lower(x), F.lit("table of contents")))
    entry = F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.{2,}|\s)\s*\d{1,4}$") & (x.rlike(r"^\d+(?:\.\d+)?\s*[A-Za-z]") | (F.char_length(x) >= 15))))
    return F.when((head & (entry >= 2)) | (named & (entry >= 1)), F.lit(True))


def toc_run(pages: DataFrame, most: int = 20) -> DataFrame:
    """The pages (doc_id, page_no, is_toc) of each document's first run of table-of-contents pages. It has to begin within
    the first ``most`` pages; one that has begun may go beyond."""
    marked = pages.withColumn("_toc", F.coalesce("is_toc", F.lit(False)))
    island = F.sum((~F.col("_toc")).cast("int")).over(in_document("page_no").rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("_run", island).where("_toc")
    first = Window.partitionBy("doc_id")
    runs = runs.withColumn("_first", F.min("_run").over(first)).where("_run = _first")
    return runs.withColumn("_start", F.min("page_no").over(first)).where(F.col("_start") <= most).drop("_toc", "_run", "_first", "_start")


def parsed_line(raw: Column) -> Column:
    """(structure, title, page) of a line of a table of contents, or null where it is none."""
    return let(toc_line(raw), _parsed)


def _parsed(line: Column) -> Column:
    low = F.lower(line)
    bad = low.isin(*IGNORED_LINES) | F.contains(low, F.lit("| page ")) | low.rlike(r"\bpage\s+\d+\s*/\s*\d+\b")
    bad = bad | (F.char_length(line) < LINE_LENGTH[0]) | (F.char_length(line) > LINE_LENGTH[1]) | ~line.rlike("[A-Za-z]")
    paged = r"^(.+?)(?:\s*:\s*|\s+)(\d{1,4})$"
    page = F.regexp_extract(line, paged, 2)
    marked = r"^(\d+(?:\.\d+)*|[A-Z])[.)]\s+(.+)$"
    plain = r"^(\d+(?:\.\d+)*)\s+(.+)$"

    def entry(body: Column) -> Column:
        structure = F.when(body.rlike(marked), F.regexp_extract(body, marked, 1)).when(body.rlike(plain), F.regexp_extract(body, plain, 1))
        title = F.trim(F.when(body.rlike(marked), F.regexp_extract(body, marked, 2)).when(body.rlike(plain), F.regexp_extract(body, plain, 2)).otherwise(body))
        made = F.struct(structure.alias("structure"), title.alias("title"), page.try_cast("int").alias("page"))
        return let(made, lambda e: F.when((page != "") & (body != "") & (e["title"] != "") & ~F.lower(e["title"]).isin(*IGNORED_LINES), e))

    return F.when(~bad, let(F.regexp_replace(F.regexp_extract(line, paged, 1), r"^[ :-]+|[ :-]+$", ""), entry))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, structure, title, page of those lines (doc_id, line_no, line) that are entries. Each is parsed once: a
    condition on the parsed one would be moved before it and parse again."""
    return lines.select("doc_id", "line_no", F.inline(F.filter(F.array(parsed_line(F.col("line"))), lambda e: e.isNotNull())))


def toc_entries(lines: DataFrame, fewest: int = FEWEST_ENTRIES) -> DataFrame:
    """doc_id, pos, structure, title, page of the lines (doc_id, line_no, line) of tables of contents: each entry once, at
    its first place; documents with fewer than ``fewest`` have none."""
    rows = parsed_lines(lines)
    key = Window.partitionBy("doc_id", "structure", F.lower("title"), "page").orderBy("line_no")
    rows = rows.withColumn("_n", F.row_number().over(key)).where("_n = 1")
    rows = rows.withColumn("_all", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("_all") >= fewest)
    return rows.select("doc_id", F.row_number().over(in_document("line_no")).alias("pos"), "structure", "title", "page")


def toc_chunks(lines: list[str], most_lines: int = 24, most_chars: int = 3500) -> list[str]:
    """Lines in chunks for a language model, each of up to so many lines and characters."""
    out: list[list[str]] = []
    size = 0
    for line in lines:
        if not out or len(out[-1]) >= most_lines or size + len(line) + 1 > most_chars:
            out.append([])
            size = 0
        out[-1].append(line)
        size += len(line) + 1
    return ["\n".join(c) for c in out]


def dots_as_colon(text: Column) -> Column:
    """Leaders of five or more dots, spaced or not, as a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def canonical_title(title: Column) -> Column:
    """A title in lower case without ``section n:`` and without a leading number."""
    t = F.regexp_replace(toc_line(title), r"(?i)^section\s+\d+(?:\.\d+)*\s*:\s*", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, _PREFIX, ""), SPACE, " ")))


def specificity(title: Column, parent: Column | None = None) -> Column:
    """How much a title says: less for generic ones and echoes of the parent, more for numbers, names of tables, length."""
    line, canon = toc_line(title), canonical_title(title)
    score = F.when(canon.isin(*GENERIC_TITLES), -40).otherwise(0)
    if parent is not None:
        score = score + F.when((F.coalesce(parent, F.lit("")) != "") & (canon == canonical_title(parent)), -80).otherwise(0)
    score = score + F.when(line.rlike(r"(?i)\b(table|figure|appendix|exhibit|chart)\b"), 100).otherwise(0)
    score = score + F.when(line.rlike(_PREFIX), 20).otherwise(0) + F.when(F.size(F.split(line, " ")) >= 5, 20).otherwise(0)
    score = score + F.when(line.rlike("[,:;-]"), 5).otherwise(0)
    return F.when(line == "", F.lit(-1000)).otherwise(score)


def cleaned_entries(items: DataFrame) -> DataFrame:
    """Generated entries (doc_id, pos, title, physical_index, parent_title) without repeats and titles that say nothing.

    Per page and title the first stays. On a page where a title scores 60 or more, weaker generic titles and echoes of the
    parent go; a parent's echo also goes anywhere but first. Then a title that was kept or dropped on the page before is
    dropped: runs of consecutive pages keep their first.
    """
    rows = items.withColumns({"title": toc_line(F.col("title")), "_c": canonical_title(F.col("title"))}).where("title != ''")
    once = Window.partitionBy("doc_id", "physical_index", "_c").orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    page = Window.partitionBy("doc_id", "physical_index")
    echo = (F.coalesce("parent_title", F.lit("")) != "") & (F.col("_c") == canonical_title(F.col("parent_title")))
    rows = rows.withColumn("_s", specificity(F.col("title"), F.col("parent_title"))).withColumns({"_best": F.max("_s").over(page), "_k": F.row_number().over(page.orderBy("pos"))})
    strong = F.col("_best") >= STRONG
    weak = (strong & F.col("_c").isin(*GENERIC_TITLES) & (F.col("_s") < F.col("_best"))) | (echo & (strong | (F.col("_k") > 1)))
    rows = rows.where(~weak)
    title = Window.partitionBy("doc_id", "_c").orderBy(F.col("physical_index").asc_nulls_last(), "pos")
    run = (F.col("_c") != "") & (F.col("physical_index") == F.lag("physical_index").over(title) + 1)
    rows = rows.withColumn("_again", F.coalesce(run, F.lit(False))).where("not _again")
    order = Window.partitionBy("doc_id").orderBy(F.col("physical_index").asc_nulls_last(), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).drop("_c", "_n", "_s", "_best", "_k", "_again")


def page_groups(pages: pd.DataFrame, most: int = 20_000) -> list[str]:
    """Texts of consecutive pages for a language model, in parts of about equal size that overlap by a page.

    A part ends before the page that would take it beyond the mean of an even share and ``most``; so a first page that is
    beyond it alone leaves an empty part in front.
    """
    texts = pages["text"].tolist()
    upto = [0, *accumulate(pages["token_count"].tolist())]
    if upto[-1] <= most:
        return ["".join(texts)]
    even = upto[-1] / math.ceil(upto[-1] / most)
    room = math.ceil((even + most) / 2)

    def end_of(first: int, soonest: int) -> int:
        """The page before which a part from ``first`` on ends, but not before ``soonest``."""
        return max(soonest, bisect_right(upto, upto[first] + room) - 1)

    bounds, first, end = [], 0, end_of(0, 0)
    while end < len(texts):
        bounds.append((first, end))
        # The next part takes up the last page of this one and has the page that did not fit in any case.
        first, end = max(end - 1, 0), end_of(max(end - 1, 0), end + 1)
    return ["".join(texts[a:b]) for a, b in [*bounds, (first, len(texts))]]


def grouped_pages(pages: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, part (from 0) and text: ``page_groups`` of each document, as a fold over its pages' sizes."""
    item = F.struct("page_no", F.col("token_count").cast("long").alias("size"), "text")
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("pages"), F.sum("token_count").alias("total"))
    docs = docs.withColumn("room", F.ceil((F.col("total") / F.ceil(F.col("total") / most) + most) / 2))
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("cuts"), F.lit(0).alias("first"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("prior"))

    def walk(st: Column, p: Column) -> Column:
        over = st["held"] + p["size"] > F.col("room")
        cut = F.array(F.struct(st["first"].alias("a"), st["k"].alias("b")))
        return F.struct(
            F.when(over, F.concat(st["cuts"], cut)).otherwise(st["cuts"]).alias("cuts"), F.when(over, F.greatest(st["k"] - 1, F.lit(0))).otherwise(st["first"]).alias("first"),
            (st["k"] + 1).alias("k"), (F.when(over, st["prior"]).otherwise(st["held"]) + p["size"]).alias("held"), p["size"].alias("prior"),
        )

    def bounds(st: Column) -> Column:
        return F.concat(st["cuts"], F.array(F.struct(st["first"].alias("a"), F.size("pages").alias("b"))))

    whole = F.array(F.struct(F.lit(0).alias("a"), F.size("pages").alias("b")))
    parts = F.when(F.col("total") <= most, whole).otherwise(F.aggregate("pages", start, walk, bounds))
    out = docs.select("doc_id", F.transform("pages", lambda p: p["text"]).alias("texts"), F.posexplode(parts).alias("part", "p"))
    return out.select("doc_id", "part", F.array_join(F.slice("texts", F.col("p.a") + 1, F.col("p.b") - F.col("p.a")), "").alias("text"))


def matching_pages(toc: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of a printed page and a physical one: entries of both with the same title, from a document's start page on.
    ``toc``: doc_id, pos, title, page; ``found``: doc_id, pos, title, physical_index, start_page."""
    left = found.select("doc_id", F.col("pos").alias("found_pos"), "title", "physical_index", "start_page").where("physical_index >= start_page")
    return left.join(toc.select("doc_id", F.col("pos").alias("toc_pos"), "title", "page"), ["doc_id", "title"])


def page_offset(pairs: DataFrame) -> DataFrame:
    """doc_id and offset: the most frequent difference of physical and printed page, of equals the first seen."""
    each = pairs.where("page is not null").select("doc_id", (F.col("physical_index") - F.col("page")).alias("offset"), F.struct("found_pos", "toc_pos").alias("at"))
    counted = each.groupBy("doc_id", "offset").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "at")
    return counted.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("doc_id", "offset")


def with_offset(toc: DataFrame, offsets: DataFrame) -> DataFrame:
    """``toc`` with physical_index: the printed page and the document's offset."""
    return toc.join(offsets, "doc_id", "left").withColumn("physical_index", (F.col("page") + F.col("offset")).cast("int")).drop("offset")


def neighbours(items: DataFrame, last_page: DataFrame) -> DataFrame:
    """``items`` with low and high: the nearest physical pages known before and after; page 0 and the last page where
    there is none. Those are the bounds within which a missing page is looked for."""
    before = in_document("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = in_document("pos").rowsBetween(1, Window.unboundedFollowing)
    out = items.join(last_page, "doc_id", "left")
    return out.withColumns({"low": F.coalesce(F.last("physical_index", True).over(before), F.lit(0)), "high": F.coalesce(F.first("physical_index", True).over(after), F.col("last_page"))}).drop("last_page")


def within_pages(items: DataFrame, last_page: DataFrame) -> DataFrame:
    """``items`` whose physical pages beyond the last one are null."""
    out = items.join(last_page, "doc_id", "left")
    return out.withColumn("physical_index", F.when(F.col("physical_index") <= F.coalesce("last_page", F.col("physical_index")), F.col("physical_index"))).drop("last_page")


def accuracy(checked: DataFrame, last_page: DataFrame) -> DataFrame:
    """doc_id and accuracy: the share of checked entries found on their page; 0 where the last entry's page lies in the
    first half of the document."""
    share = checked.groupBy("doc_id").agg(F.avg(F.col("appears").cast("double")).alias("a"), F.max("physical_index").alias("m"))
    return share.join(last_page, "doc_id").select("doc_id", F.when(F.col("m") < F.col("last_page") / 2, 0.0).otherwise(F.col("a")).alias("accuracy"))


def title_on_page(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``items`` with appears (the page holds the title) and appear_start (yes if it is at the page's top): what stands in
    where no language model is asked. Blanks and case don't count."""
    body = F.lower(F.regexp_replace("text", SPACE, ""))
    own = pages.select("doc_id", F.col("page_no").alias("physical_index"), body.alias("_page"))
    title = F.lower(F.regexp_replace("title", SPACE, ""))
    out = items.join(own, ["doc_id", "physical_index"], "left")
    held = F.coalesce(F.contains(F.col("_page"), title), F.lit(False))
    return out.withColumns({"appears": held, "appear_start": F.when(F.coalesce(F.startswith(F.col("_page"), title), F.lit(False)), "yes").otherwise("no")}).drop("_page")


def with_preface(items: DataFrame) -> DataFrame:
    """``items`` (doc_id, pos, structure, title, physical_index, ...) with a preface at page 1 where the first begins later."""
    first = items.withColumn("_n", F.row_number().over(in_document("pos"))).where("_n = 1 and physical_index > 1")
    row = {"pos": F.col("pos") - 1, "structure": F.lit("0"), "title": F.lit("Preface"), "physical_index": F.lit(1)}
    return items.unionByName(first.select(*[row[c].cast(items.schema[c].dataType).alias(c) if c in row else (F.col(c) if c == "doc_id" else F.lit(None).cast(items.schema[c].dataType).alias(c)) for c in items.columns]))


def parents_by_code(items: DataFrame) -> DataFrame:
    """``items`` with parent_pos: the latest entry before whose code is this one's without its last part; none if there is
    no such entry or the code has one part."""
    up = F.regexp_extract("structure", r"^(.*)\.[^.]+$", 1)
    # Each entry stands twice among those of a code: as one that has it and as one that looks for it. Sorted by position, the
    # latest before is a running maximum; to join all with all took the square of their number.
    both = F.array(F.struct(F.lit(True).alias("_asks"), F.when(up != "", up).alias("_code")), F.struct(F.lit(False).alias("_asks"), F.col("structure").alias("_code")))
    rows = items.select("*", F.inline(both)).where("_asks or _code is not null")
    rows = rows.withColumn("_alone", F.when(F.col("_code").isNull(), F.col("pos")))
    before = Window.partitionBy("doc_id", "_code", "_alone").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("parent_pos", F.max(F.when(~F.col("_asks"), F.col("pos"))).over(before)).where("_asks").drop("_asks", "_code", "_alone")
    return rows.withColumn("parent_pos", F.when(F.col("doc_id").isNotNull(), F.col("parent_pos")))


# Headings in page texts


def heading_line(line: Column) -> Column:
    """A line with single blanks and without the marks of a list before it."""
    text = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), SPACE, " "))
    return F.trim(F.regexp_replace(text, r"^[-*• \t]+", ""))


def looks_like_heading(line: Column, patterns: Iterable[str] = HEADING_PATTERNS, least: int = 4, most: int = 120) -> Column:
    """Whether a cleaned line may be a heading: by a pattern, a number, capitals, or capitalised words."""
    fits = F.char_length(line).between(least, most) & ~line.rlike(r"[.;:?!]$") & (F.size(F.regexp_extract_all(line, F.lit("[A-Za-z]"), F.lit(0))) >= 2)
    named = F.lit(False)
    for p in patterns:
        named = named | line.rlike(p if p.startswith("^") else f"^(?:{p})")
    numbers = line.rlike(r"^\d+(?:\.\d+){0,3}\s+[A-Za-z]")
    capitals = line.rlike(r"\p{L}") & ~line.rlike(r"[\p{L}&&[^\p{Lu}]]")
    ws = F.regexp_extract_all(line, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]*"), F.lit(0))
    titled = F.size(ws).between(2, 12) & (F.size(F.filter(ws, lambda w: w.rlike("^[A-Z0-9]"))) >= 0.6 * F.size(ws))
    return fits & (named | numbers | capitals | titled)


def heading_candidates(pages: DataFrame, parents: DataFrame | None = None, patterns: Iterable[str] = HEADING_PATTERNS) -> DataFrame:
    """doc_id, rank, title and physical_index of heading lines in ``pages`` (doc_id, page_no, text).

    The parent's title is left out (``parents``: doc_id, parent_title). On a page each title counts once, and a title is
    left out right after the same title was kept on the page before. That depends on what was kept, so the lines of a
    document are folded in order.
    """
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "raw")).select("doc_id", "page_no", "n", heading_line(F.col("raw")).alias("title"))
    if parents is not None:
        lines = lines.join(parents, "doc_id", "left").where(F.lower("title") != F.coalesce(F.lower(heading_line(F.col("parent_title"))), F.lit("")))
    lines = lines.where(looks_like_heading(F.col("title"), patterns))
    item = F.struct("page_no", "n", "title", F.lower("title").alias("low"))
    gathered = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = gathered.schema["items"].dataType.simpleString()

    def keep(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        twice = F.exists(kept, lambda y: (y["page_no"] == x["page_no"]) & (y["low"] == x["low"]))
        again = (F.size(kept) > 0) & F.coalesce((last["low"] == x["low"]) & (last["page_no"] + 1 == x["page_no"]), F.lit(False))
        return F.when(twice | again, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("items", F.array().cast(kind), keep)
    return gathered.select("doc_id", F.posexplode(kept).alias("rank", "c")).select("doc_id", (F.col("rank") + 1).alias("rank"), "c.title", F.col("c.page_no").alias("physical_index"))


def may_split(nodes: DataFrame, pages: DataFrame, least_pages: int = 4, least_tokens: int = 2000) -> DataFrame:
    """Leaves (doc_id, node_id, start_index, end_index, is_leaf) of at least so many pages or tokens."""
    spanned = nodes.where("is_leaf").join(pages.select("doc_id", "page_no", "token_count"), "doc_id").where("page_no between start_index and end_index")
    size = spanned.groupBy("doc_id", "node_id").agg(F.sum("token_count").alias("tokens"))
    out = nodes.where("is_leaf").join(size, ["doc_id", "node_id"], "left")
    return out.where((F.col("end_index") - F.col("start_index") + 1 >= least_pages) | (F.col("tokens") >= least_tokens)).drop("tokens")


def children_of(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of ``parents`` (key columns doc_id and parent_title, end_index) from their heading candidates: doc_id, rank,
    title, start_index, end_index.

    A child ends before the next begins, or on its page if both begin there; the last ends with the parent. They count if
    they begin on ascending pages of their own, or if there is a single one with another title than the parent's.
    """
    order = in_document("rank")
    rows = candidates.join(parents.select("doc_id", "parent_title", F.col("end_index").alias("_end")), "doc_id")
    following = F.lead("physical_index").over(order)
    end = F.when(following.isNull(), F.col("_end")).when(following > F.col("physical_index"), following - 1).otherwise(following)
    rows = rows.select("doc_id", "rank", "title", "parent_title", F.col("physical_index").alias("start_index"), end.alias("end_index")).where("end_index >= start_index")
    whole = Window.partitionBy("doc_id")
    later = F.coalesce(F.col("start_index") > F.lag("start_index").over(order), F.lit(True))
    rows = rows.withColumn("_later", later).withColumns({"_n": F.count("*").over(whole), "_ok": F.min(F.col("_later").cast("int")).over(whole)})
    alone = (F.col("_n") == 1) & (F.lower(F.trim("title")) != F.lower(F.trim("parent_title")))
    return rows.where(((F.col("_n") >= 2) & (F.col("_ok") == 1)) | alone).select("doc_id", "rank", "title", "start_index", "end_index")


def physical_number(value: Column) -> Column:
    """The page in a mark like <physical_index_7>, or in a plain number."""
    inner = F.regexp_extract(value, r"physical_index_(\d+)", 1)
    return F.when(inner != "", inner.cast("int")).otherwise(value.try_cast("int"))


def recursive_split(nodes: DataFrame, pages: DataFrame, most_depth: int = 3, least_pages: int = 4, least_tokens: int = 2000, patterns: Iterable[str] = HEADING_PATTERNS) -> DataFrame:
    """Large leaves split at the headings in their pages, down to ``most_depth`` levels, in as many rounds.

    ``nodes``: doc_id, key, title, start_index, end_index. ``key`` is an array of numbers; a child's is its parent's and
    its rank. Returns the new nodes only. In a round a leaf's pages are looked through as a document of its own.
    """
    pages = pages.select("doc_id", "page_no", "text", "token_count")
    nodes = nodes.select("doc_id", "key", "title", "start_index", "end_index")
    done, open_nodes = nodes.where("false"), nodes
    for _ in range(1, most_depth):
        keyed = open_nodes.select(F.col("doc_id").alias("_doc"), F.to_json(F.struct("doc_id", "key")).alias("doc_id"), "key", "title", "start_index", "end_index")
        own = keyed.join(pages.withColumnRenamed("doc_id", "_doc"), "_doc").where("page_no between start_index and end_index")
        size = own.groupBy("doc_id").agg(F.sum("token_count").alias("_tokens"))
        large = keyed.join(size, "doc_id").where((F.col("end_index") - F.col("start_index") + 1 >= least_pages) | (F.col("_tokens") >= least_tokens))
        parents = large.select("doc_id", F.col("title").alias("parent_title"), "end_index")
        found = heading_candidates(own.join(large.select("doc_id"), "doc_id", "left_semi").select("doc_id", "page_no", "text"), parents.select("doc_id", "parent_title"), patterns)
        new = children_of(found, parents).join(large.select("doc_id", "_doc", F.col("key").alias("_key")), "doc_id")
        new = new.select(F.col("_doc").alias("doc_id"), F.concat("_key", F.array("rank")).alias("key"), "title", "start_index", "end_index")
        new = cut(new)
        if new.isEmpty():
            break
        done, open_nodes = done.unionByName(new), new
    return done
