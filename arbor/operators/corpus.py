"""Corpora: a catalog of documents, filters on it, building from a directory, search over all documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.operators import index as I
from arbor.operators import search as S
from arbor.operators import tree
from arbor.operators.pages import page_tree
from arbor.settings import Settings
from arbor.sources import files

CATALOG = "doc_id string, doc_name string, source_path string, doc_type string, tags array<string>, source string, created_at timestamp_ntz"


@dataclass(frozen=True)
class CorpusFilter:
    """Predicates on the catalog; empty ones let all pass. Times are ISO texts; one that can't be read is an error."""

    doc_id: str | None = None
    doc_type: str | None = None
    source: str | None = None
    tags: tuple[str, ...] = ()
    created_from: str | None = None
    created_to: str | None = None


@dataclass
class Corpus:
    catalog: DataFrame
    index: I.Index

    def save(self, path: str) -> None:
        self.catalog.write.mode("overwrite").parquet(f"{path}/catalog")
        self.index.save(f"{path}/index")


def load_corpus(spark: SparkSession, path: str) -> Corpus:
    return Corpus(spark.read.parquet(f"{path}/catalog"), I.load_index(spark, f"{path}/index"))


def filtered(catalog: DataFrame, wanted: CorpusFilter) -> DataFrame:
    """The rows of the catalog that all given predicates hold for. A row without a time fails a bound on it."""
    for name in ("doc_id", "doc_type", "source"):
        value = getattr(wanted, name)
        if value:
            catalog = catalog.where(F.col(name) == value)
    if wanted.tags:
        catalog = catalog.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted.tags])))
    for value, below in ((wanted.created_from, False), (wanted.created_to, True)):
        if value:
            bound = F.to_timestamp_ntz(F.lit(value))
            catalog = catalog.where(F.col("created_at") <= bound if below else F.col("created_at") >= bound)
    return catalog


def summary(catalog: DataFrame) -> DataFrame:
    """One row: n_documents and the sorted different doc_types and sources."""
    return catalog.agg(
        F.count("*").alias("n_documents"), F.array_sort(F.collect_set("doc_type")).alias("doc_types"), F.array_sort(F.collect_set("source")).alias("sources")
    )


def _nodes(sections: DataFrame, first_id: int) -> DataFrame:
    rows = tree.numbered(tree.with_parents(sections), first_id)
    nodes = tree.linked_nodes(rows.withColumns({"start_index": F.col("line_num"), "end_index": F.col("line_num")}))
    return tree.with_summaries(nodes)


def markdown_tree(markdown: DataFrame) -> DataFrame:
    """Nodes of Markdown texts (doc_id, value)."""
    return _nodes(tree.sections(tree.markdown_headings(tree.markdown_lines(markdown)), "line_no", "line"), 1)


def word_tree(paragraphs: DataFrame) -> DataFrame:
    """Nodes of Word paragraphs (doc_id, par_no, style, text, stem)."""
    return _nodes(tree.paragraph_sections(paragraphs), 1)


def directory_nodes(scanned: DataFrame, extract: files.Extractor | None = None) -> DataFrame:
    """Nodes of scanned documents, all types together."""
    found = [I.complete(markdown_tree(files.markdown_files(scanned))), I.complete(word_tree(files.word_paragraphs(scanned)))]
    if extract is not None:
        found.append(I.complete(page_tree(files.pdf_pages(scanned, extract))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def build_corpus(spark: SparkSession, directory: str, exclude: list[str] | None = None, source: str | None = None, settings: Settings | None = None, extract: files.Extractor | None = None) -> Corpus:
    """The catalog and the index of a directory's documents, built by one job over all of them."""
    settings = settings or Settings(index_include_text=True)
    scanned = files.scan_directory(spark, directory, exclude)
    catalog = scanned.select(
        "doc_id", F.when(F.col("doc_type") == "markdown", files.stem(F.col("path"))).otherwise(files.file_name(F.col("path"))).alias("doc_name"), F.col("path").alias("source_path"),
        "doc_type", F.array().cast("array<string>").alias("tags"), F.lit(source).cast("string").alias("source"), F.to_timestamp_ntz(F.current_timestamp().cast("string")).alias("created_at"),
    )
    return Corpus(catalog, I.build_index(directory_nodes(scanned, extract), settings))


def search_corpus(corpus: Corpus, queries: DataFrame, wanted: CorpusFilter | None = None, request: S.Request | None = None, explain: bool = False, composed: bool = False, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Results over the documents that pass the filter: each document's own top_k, then the top_k of all of them by score,
    doc_id and page. The catalog is filtered before the index is touched."""
    docs = filtered(corpus.catalog, wanted or CorpusFilter())
    own = docs.select("doc_id")
    index = corpus.index.within(own)
    request = (request or S.Request()).filled(index.settings)
    found = S.search_queries(index, queries, request, explain, composed).withColumnRenamed("rank", "doc_rank")
    order = S.Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "start_index", "node_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= request.top_k)
    found = found.join(docs.select("doc_id", "doc_name", "source_path", "doc_type", "tags", "source"), "doc_id")
    return rerank(found) if rerank else found
