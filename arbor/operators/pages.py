"""Section trees of page-oriented documents without a language model: contents if a document has them, else headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.functions import text as T
from arbor.functions.text import SPACE
from arbor.operators import toc, tree
from arbor.operators.lineage import cut
from arbor.settings import Settings

#: Share of entries that have to be found on their pages for a table of contents to be trusted.
TRUSTED = 0.6


def contents(pages: DataFrame, settings: Settings) -> DataFrame:
    """Entries of each document's table of contents: doc_id, pos, structure, title, page, toc_end (its last page)."""
    run = toc.toc_run(pages.select("doc_id", "page_no", "text", toc.is_toc_page(F.col("text")).alias("is_toc")), settings.toc_check_page_num)
    lines = run.select("doc_id", "page_no", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line"))
    entries = toc.toc_entries(lines.select("doc_id", (F.col("page_no").cast("long") * 1_000_000 + F.col("n")).alias("line_no"), "line"))
    return entries.join(run.groupBy("doc_id").agg(F.max("page_no").alias("toc_end")), "doc_id")


def _plain(column: str):
    return F.lower(F.regexp_replace(column, SPACE, ""))


def first_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, pos and found: the first page from low to high (columns of ``wanted``) whose text holds the title."""
    body = pages.select("doc_id", F.col("page_no"), _plain("text").alias("_body"))
    held = wanted.select("doc_id", "pos", "low", "high", _plain("title").alias("_title")).join(body, "doc_id")
    held = held.where("page_no between low and high").where(F.contains(F.col("_body"), F.col("_title")))
    return held.groupBy("doc_id", "pos").agg(F.min("page_no").alias("found"))


def placed_contents(entries: DataFrame, pages: DataFrame, last: DataFrame, settings: Settings) -> DataFrame:
    """``entries`` with physical_index: the printed page plus the document's usual offset, or where the title is found
    between its neighbours' pages if it isn't there."""
    near = entries.select("doc_id", "pos", "title", (F.col("toc_end") + 1).alias("low"), (F.col("toc_end") + settings.toc_check_page_num).alias("high"))
    found = near.join(first_pages(near, pages), ["doc_id", "pos"]).select("doc_id", "pos", "title", F.col("found").alias("physical_index"), F.col("low").alias("start_page"))
    offset = toc.page_offset(toc.matching_pages(entries, found))
    placed = cut(toc.title_on_page(toc.within_pages(toc.with_offset(entries, offset), last), pages))
    known = placed.withColumn("physical_index", F.when(F.col("appears"), F.col("physical_index")))
    missing = toc.neighbours(known, last).where("physical_index is null").select("doc_id", "pos", "title", F.greatest("low", F.col("toc_end") + 1).alias("low"), "high")
    return placed.join(first_pages(missing, pages), ["doc_id", "pos"], "left").withColumn("physical_index", F.coalesce("found", "physical_index")).drop("found", "appears", "appear_start")


def page_tree(pages: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Nodes of documents given as pages (doc_id, page_no, text, token_count).

    A document whose table of contents can be read and is right for most entries gets its sections, with a preface if they
    begin later than page 1. Any other is one node over all pages. Large leaves of both are split at headings. Every node
    has its pages' text and a summary: the text if it is short, else its beginning.
    """
    settings = settings or Settings()
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("last_page"))
    placed = cut(placed_contents(cut(contents(pages, settings)), pages, last, settings))
    right = cut(toc.accuracy(toc.title_on_page(placed, pages), last).where(F.col("accuracy") >= TRUSTED).select("doc_id"))
    entries = placed.join(right, "doc_id", "left_semi").where("physical_index is not null").select("doc_id", "pos", "structure", "title", "physical_index")
    entries = toc.title_on_page(toc.with_preface(entries), pages)
    ended = tree.ends_of_sections(entries, pages.select("doc_id", "page_no"))
    coded = toc.parents_by_code(ended).select(
        "doc_id", F.array(F.col("pos").cast("int")).alias("key"), F.array(F.col("parent_pos").cast("int")).alias("up"), "parent_pos", "title", "start_index", F.greatest("start_index", "end_index").alias("end_index")
    )
    sections = coded.select("doc_id", "key", F.when(F.col("parent_pos").isNotNull(), F.col("up")).alias("up"), "title", "start_index", "end_index")
    whole = last.join(right, "doc_id", "left_anti").select("doc_id", F.array(F.lit(1)).alias("key"), F.lit(None).cast("array<int>").alias("up"), F.col("doc_id").alias("title"), F.lit(1).alias("start_index"), F.col("last_page").alias("end_index"))
    first = cut(sections.unionByName(whole))
    leaves = first.join(first.where("up is not null").select("doc_id", F.col("up").alias("key")).distinct(), ["doc_id", "key"], "left_anti")
    if settings.recursive_split_enabled:
        new = toc.recursive_split(leaves, pages, settings.recursive_split_max_depth, settings.recursive_split_min_pages, settings.recursive_split_min_tokens, settings.recursive_split_heading_patterns)
        first = first.unionByName(new.withColumn("up", F.slice("key", F.lit(1), F.size("key") - 1)))
    ordered = cut(first).withColumn("pos", F.row_number().over(tree.in_document("key")))
    ups = ordered.select("doc_id", F.col("key").alias("up"), F.col("pos").alias("parent_pos"))
    rows = tree.numbered(ordered.join(ups, ["doc_id", "up"], "left").select("doc_id", "pos", "parent_pos", "title", "start_index", "end_index"))
    nodes = tree.page_text(tree.linked_nodes(rows), pages)
    return nodes.withColumn("summary", F.when(T.word_count(F.col("text")) < 200, F.col("text")).otherwise(F.substring("text", 1, 400)))
