"""Section trees: headings and paragraphs to nodes, numbering, page spans, text, thinning, flattening and projections."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import text as T
from arbor.operators.lineage import cut

#: The highest heading level looked at.
LEVELS = 9
NODE_ROWS = (
    "doc_id string, node_idx int, node_id string, title string, summary string, prefix_summary string, text string, start_index int, "
    "end_index int, depth int, parent_id string, parent_idx int, child_ids array<string>, ancestor_ids array<string>, path_titles array<string>, is_leaf boolean, token_count int"
)


def in_document(*order: str | Column) -> Window:
    return Window.partitionBy("doc_id").orderBy(*order)


# Markdown


def markdown_lines(files: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1) and line of files with columns doc_id and value (the whole text)."""
    return files.select("doc_id", F.posexplode(F.split("value", "\n")).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("line_no"), "line")


def markdown_headings(lines: DataFrame) -> DataFrame:
    """``lines`` with level and title where a line is a heading outside a fence, and whether it is an indented one.

    A heading is one to six # and a blank before text, once trimmed. Lines that begin with three backticks open and close
    fences. Indented headings are dropped: their text stays with the section before.
    """
    line = F.trim(F.regexp_replace("line", r"^[\s]+|[\s]+$", ""))
    fence = line.startswith("```")
    inside = F.sum(fence.cast("int")).over(in_document("line_no").rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    marks = F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 1)
    is_heading = (marks != "") & ~fence & ~F.col("_inside")
    out = lines.withColumn("_inside", inside).withColumn("_h", is_heading)
    out = out.withColumn("indented", F.col("_h") & ~F.col("line").startswith("#"))
    kept = F.col("_h") & ~F.col("indented")
    return out.select(
        "doc_id", "line_no", "line", "indented", F.when(kept, F.length(marks)).alias("level"), F.when(kept, F.trim(F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 2))).alias("title")
    )


def sections(rows: DataFrame, position: str, text: str) -> DataFrame:
    """One row for each row with a level: doc_id, pos (from 1), line_num, level, title, text.

    A section's text is its own row and those up to the next heading, joined by line ends and trimmed. Rows before the
    first heading belong to none.
    """
    number = F.sum(F.col("level").isNotNull().cast("int")).over(in_document(position).rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("pos", number).where("pos > 0")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position), F.col(text)))), lambda x: x[text])
    head = F.min(F.when(F.col("level").isNotNull(), F.struct(F.col(position).alias("p"), "level", "title")))
    grouped = numbered.groupBy("doc_id", "pos").agg(head.alias("h"), F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "").alias("text"))
    return grouped.select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("h.p").alias("line_num"), F.col("h.level").alias("level"), F.col("h.title").alias("title"), "text")


# Word processor paragraphs


def style_level(style: Column) -> Column:
    """The level of a paragraph style: heading 1 to 9 in English or Chinese, 0 for a title, else null."""
    name = F.trim(F.coalesce(style, F.lit("")))
    level = F.regexp_extract(name, r"(?i)^(?:heading|标题)\s*([1-9])$", 1)
    return F.when(level != "", level.cast("int")).when(F.lower(name) == "title", F.lit(0))


def paragraph_sections(paragraphs: DataFrame) -> DataFrame:
    """Sections of paragraphs (doc_id, par_no, style, text, stem). A document without headings is one section titled by its
    file's stem that holds all its text; one without paragraphs is not in ``paragraphs`` and so not here."""
    leveled = paragraphs.withColumns({"level": style_level(F.col("style")), "title": F.col("text")})
    titled = leveled.where(F.col("level").isNotNull()).select("doc_id").distinct()
    found = sections(leveled.join(titled, "doc_id", "left_semi"), "par_no", "text")
    plain = paragraphs.join(titled, "doc_id", "left_anti").groupBy("doc_id").agg(
        F.first("stem").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par_no", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    return found.unionByName(plain.select("doc_id", F.lit(1).alias("pos"), F.lit(1).alias("line_num"), F.lit(1).alias("level"), "title", "text"))


# Trees


def with_parents(headings: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``headings`` (doc_id, pos, level) with parent_pos: the nearest heading before with a lower level, or null.

    For each level the last position so far is a running maximum, so one sort by document gives all parents.
    """
    before = in_document("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("pos"))).over(before) for k in range(levels + 1)]
    out = headings.withColumn("_last", F.array(*last))
    lower = F.filter(F.transform(F.slice("_last", F.lit(1), F.col("level")), lambda x: x), lambda x: x.isNotNull())
    return out.withColumn("parent_pos", F.array_max(lower)).drop("_last")


def subtree_ends(headings: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``headings`` with end_pos, the last position of the subtree: before the next heading of the same or a lower level."""
    return _ended(headings.withColumn("_from", F.lit(0)), levels).drop("_from", "_next")


def _ended(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``rows`` with end_pos and _next, the next heading of the same or a lower level as (pos, _from). A document is gone
    through from its end, so each frame only grows; from its beginning each row would look at all that follow."""
    backwards = in_document(F.desc("pos"))
    after = backwards.rowsBetween(Window.unboundedPreceding, -1)
    following = [F.last(F.when(F.col("level") == k, F.struct("pos", "_from")), ignorenulls=True).over(after) for k in range(levels + 1)]
    whole = F.max("pos").over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_next", F.array_min(F.slice(F.array(*following), F.lit(1), F.col("level") + 1)))
    return out.withColumn("end_pos", F.coalesce(F.col("_next.pos") - 1, whole))


def subtree_tokens(headings: DataFrame, tokens: Callable[[Column], Column] = T.word_count) -> DataFrame:
    """``headings`` with own_tokens and subtree_tokens: what there is from the heading to the document's end less what there
    is from the end of its subtree on."""
    total = F.sum("own_tokens").over(in_document(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    out = _ended(headings.withColumn("own_tokens", tokens(F.col("text"))).withColumn("_from", total))
    return out.withColumn("subtree_tokens", F.col("_from") - F.coalesce("_next._from", F.lit(0))).drop("_from", "_next")


def thinned(headings: DataFrame, least: int, tokens: Callable[[Column], Column] = T.word_count) -> DataFrame:
    """``headings`` with subtrees of fewer than ``least`` tokens folded into their top heading, whose text they join.

    Folding moves texts up but loses none, so a subtree has as many tokens before as after; which headings fold can be told at
    once, and those below the highest of them go. Blank texts are left out of a joined one.
    """
    before, so_far = in_document("pos").rowsBetween(Window.unboundedPreceding, -1), in_document("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = subtree_tokens(headings.withColumn("text", F.coalesce("text", F.lit(""))), tokens)
    rows = rows.withColumn("_folds", (F.col("end_pos") > F.col("pos")) & (F.col("subtree_tokens") < least))
    rows = rows.withColumn("_reach", F.max(F.when(F.col("_folds"), F.col("end_pos"))).over(before))
    rows = rows.withColumn("_stays", F.coalesce(F.col("_reach") < F.col("pos"), F.lit(True)))
    rows = rows.withColumn("_top", F.last(F.when(F.col("_stays"), F.col("pos")), ignorenulls=True).over(so_far))
    head = F.first(F.when(F.col("_stays"), F.struct("_folds", F.struct(*headings.columns).alias("row"))), ignorenulls=True)
    written = F.collect_list(F.when((F.col("_folds") | ~F.col("_stays")) & (T.compact(F.col("text")) != ""), F.struct("pos", "text")))
    kept = rows.groupBy("doc_id", "_top").agg(head.alias("head"), F.array_join(F.transform(F.array_sort(written), lambda x: x["text"]), "\n\n").alias("joined"))
    text = F.when(F.col("head._folds"), F.col("joined")).otherwise(F.col("head.row.text"))
    return kept.select(*[(text if c == "text" else F.col("head.row")[c]).alias(c) for c in headings.columns])


def padded(number: Column) -> Column:
    """A number with four digits at least."""
    return F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))


def numbered(rows: DataFrame, first: int = 0) -> DataFrame:
    """``rows`` with node_id: their place in the document in pre-order, from ``first``."""
    return rows.withColumn("node_id", padded(F.row_number().over(in_document("pos")) - 1 + first))


def linked_nodes(rows: DataFrame) -> DataFrame:
    """Nodes from rows (doc_id, pos, parent_pos, node_id, title and others): node_idx, depth, parent_id, ancestor_ids,
    path_titles, child_ids, is_leaf. One join for each level of depth, as many as there are; documents of all sizes go through
    the same joins. Rows whose parent is not among them are left out."""
    base = cut(rows).withColumn("node_idx", F.row_number().over(in_document("pos")) - 1)
    name = F.when(F.coalesce("title", F.lit("")) != "", F.array("title")).otherwise(F.array().cast("array<string>"))
    level = base.where("parent_pos is null").select("doc_id", "pos", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<string>").alias("ancestor_ids"), name.alias("path_titles"), F.col("node_id").alias("_own"))
    found = level
    edges = base.where("parent_pos is not null").select("doc_id", F.col("pos").alias("child_pos"), F.col("parent_pos").alias("pos"), F.col("node_id").alias("child_id"), name.alias("child_name"))
    while True:
        level = edges.join(level, ["doc_id", "pos"]).select(
            "doc_id", F.col("child_pos").alias("pos"), (F.col("depth") + 1).alias("depth"), F.col("_own").alias("parent_id"), F.concat("ancestor_ids", F.array("_own")).alias("ancestor_ids"), F.concat("path_titles", "child_name").alias("path_titles"), F.col("child_id").alias("_own")
        )
        level = cut(level)
        if level.isEmpty():
            break
        found = found.unionByName(level)
    children = base.where("parent_pos is not null").groupBy("doc_id", F.col("parent_pos").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("child_ids"))
    out = base.join(found.drop("_own"), ["doc_id", "pos"]).join(children, ["doc_id", "pos"], "left")
    return out.withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>"))).withColumn("is_leaf", F.size("child_ids") == 0)


def with_summaries(nodes: DataFrame, summarise: Callable[[Column], Column] | None = None, least: int = 200) -> DataFrame:
    """Leaves get summary, inner nodes prefix_summary: the text itself if it has fewer than ``least`` tokens, else what
    ``summarise`` makes of it (without one, its first 400 characters)."""
    long = summarise(F.col("text")) if summarise else F.substring("text", 1, 400)
    made = F.when(T.word_count(F.col("text")) < least, F.col("text")).otherwise(long)
    return nodes.withColumns({"summary": F.when(F.col("is_leaf"), made), "prefix_summary": F.when(~F.col("is_leaf"), made)})


# Pages


def ends_of_sections(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """``toc`` (doc_id, pos, physical_index, appear_start) with start_index and end_index: the page before the next
    section's if that starts at its page's top, else the same page; the last one's is the last page."""
    following = in_document("pos")
    n = pages.groupBy("doc_id").agg(F.max("page_no").alias("_pages"))
    shift = F.when(F.lead("appear_start").over(following) == "yes", 1).otherwise(0)
    out = toc.withColumn("_next", F.lead("physical_index").over(following) - shift).join(n, "doc_id", "left")
    return out.withColumns({"start_index": F.col("physical_index"), "end_index": F.coalesce("_next", "_pages")}).drop("_next", "_pages")


def page_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """``nodes`` with text: their pages', start to end, put together. A node without a page has an empty text."""
    span = F.explode(F.when(F.col("start_index") <= F.col("end_index"), F.sequence("start_index", "end_index")).otherwise(F.array().cast("array<int>")))
    keyed = nodes.drop("text").withColumn("_node", F.col("node_id"))
    each = keyed.select("doc_id", "_node", span.alias("page_no")).join(pages.select("doc_id", "page_no", F.col("text").alias("_page")), ["doc_id", "page_no"])
    texts = each.groupBy("doc_id", "_node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "_page"))), lambda x: x["_page"]), "").alias("text"))
    return keyed.join(texts, ["doc_id", "_node"], "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("_node")


def whole_file_nodes(pages: DataFrame, stems: DataFrame) -> DataFrame:
    """A single node for each document: all its pages, summarised by the first 400 characters, or by its stem."""
    whole = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]).alias("t"), F.max("page_no").alias("end_index"))
    text = F.regexp_replace(F.array_join("t", "\n"), r"^\s+|\s+$", "")
    return whole.join(stems, "doc_id").select(
        "doc_id", F.lit("0000").alias("node_id"), F.col("stem").alias("title"), F.lit(1).alias("start_index"), "end_index", text.alias("text"),
        F.when(text != "", F.substring(text, 1, 400)).otherwise(F.col("stem")).alias("summary"), F.lit(1).alias("pos"), F.lit(None).cast("int").alias("parent_pos"),
    )


def with_text(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``nodes`` with the text of ``texts`` (doc_id, line_num, title, text) where they have one, else their own."""
    keyed = texts.select("doc_id", "line_num", "title", F.col("text").alias("_text")).dropDuplicates(["doc_id", "line_num", "title"])
    return nodes.join(keyed, ["doc_id", "line_num", "title"], "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")


def has_text(nodes: DataFrame) -> DataFrame:
    """For each document whether any node has a text."""
    return nodes.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("text"), F.lit("")) != "").alias("has_text"))


# Nested trees


def flatten_json(documents: DataFrame) -> DataFrame:
    """Nodes in pre-order of documents (doc_id, value: a JSON tree, an object with ``structure`` or a list of nodes).

    Nodes without an id are named by their order. Pages fall back to line_num, the end to the start. Trees have no schema
    of a fixed depth, so a document is walked in Python, without recursion.
    """
    columns = [c.split()[0] for c in NODE_ROWS.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for doc_id, value in zip(batch["doc_id"], batch["value"]):
                tree = json.loads(value)
                roots = tree.get("structure") if isinstance(tree, dict) else tree
                if not isinstance(roots, list):
                    raise TypeError("a tree is a list of nodes or an object whose structure is one")
                rows += _flat(doc_id, roots)
            yield pd.DataFrame(rows, columns=columns)

    return documents.select("doc_id", "value").mapInPandas(walk, NODE_ROWS)


def _flat(doc_id: str, roots: list[dict]) -> list[dict]:
    rows: list[dict] = []
    stack = [(node, None) for node in reversed(roots)]
    while stack:
        node, up = stack.pop()
        k = len(rows)
        line = node.get("line_num")
        start = next((x for x in (node.get("start_index"), line) if x is not None), 0)
        end = next((x for x in (node.get("end_index"), line) if x is not None), start)
        title = node.get("title") or ""
        own = node.get("node_id") or f"auto-{k:04d}"
        first = node.get("text") or node.get("summary") or node.get("prefix_summary") or title
        rows.append(
            {
                "doc_id": doc_id, "node_idx": k, "node_id": own, "title": title, "summary": node.get("summary"), "prefix_summary": node.get("prefix_summary"),
                "text": node.get("text"), "start_index": start, "end_index": end, "depth": up["depth"] + 1 if up else 1, "parent_id": up["node_id"] if up else None,
                "parent_idx": up["node_idx"] if up else None, "child_ids": [], "ancestor_ids": [*up["ancestor_ids"], up["node_id"]] if up else [],
                "path_titles": (up["path_titles"] if up else []) + ([title] if title else []), "is_leaf": not node.get("nodes"), "token_count": len(first.split()),
            }
        )
        if up:
            up["child_ids"].append(own)
        stack += [(child, rows[-1]) for child in reversed(node.get("nodes") or [])]
    return rows


def nested_json(nodes: DataFrame, columns: tuple[str, ...] = ("title", "node_id", "start_index", "end_index", "summary", "prefix_summary", "text")) -> DataFrame:
    """doc_id and value: the nodes of each document as a JSON tree with the given keys, empty ones and empty lists left out."""

    def nest(rows: pd.DataFrame) -> pd.DataFrame:
        made: dict[str, dict] = {}
        roots: list[dict] = []
        for r in rows.sort_values("node_idx").to_dict("records"):
            item = {c: (int(r[c]) if c.endswith("_index") else r[c]) for c in columns if not pd.isna(r.get(c)) and r[c] != ""}
            made[r["node_id"]] = item
            up = made.get(r["parent_id"]) if r["parent_id"] is not None else None
            (roots if up is None else up.setdefault("nodes", [])).append(item)
        doc = rows["doc_id"].iloc[0]
        return pd.DataFrame([(doc, json.dumps({"doc_name": doc, "structure": roots}, ensure_ascii=False))], columns=["doc_id", "value"])

    return nodes.groupBy("doc_id").applyInPandas(nest, "doc_id string, value string")


def outline(nodes: DataFrame) -> DataFrame:
    """doc_id, node_idx and line: the title after two blanks for each level above."""
    return nodes.select("doc_id", "node_idx", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.coalesce("title", F.lit(""))).alias("line"))
