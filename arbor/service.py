"""Building and querying from files: what the command line and the HTTP server share."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor import clients
from arbor.operators import corpus as C
from arbor.operators import index as I
from arbor.operators import search as S
from arbor.operators import tree
from arbor.settings import Settings, load, read
from arbor.sources import files


def session(name: str = "arbor") -> SparkSession:
    """The running session, or a local one with few shuffle partitions, as single queries touch few rows."""
    return SparkSession.getActiveSession() or SparkSession.builder.appName(name).config("spark.sql.shuffle.partitions", "8").getOrCreate()


def build_document(spark: SparkSession, path: str, settings: Settings | None = None, parser: str = "plain") -> I.Index:
    """The index of one file: Markdown, Word, PDF (with a parser) or a JSON tree."""
    if path.endswith(".json"):
        return I.build_index(tree.flatten_json(files.json_trees(spark, path)), settings)
    folder, name = os.path.split(path)
    scanned = files.with_doc_ids(spark.read.format("binaryFile").load(path).select("path", "content").withColumn("doc_type", files.doc_type(F.col("path"))))
    if scanned.where("doc_type is null").count():
        raise ValueError(f"not a document: {name}")
    return I.build_index(C.directory_nodes(scanned, files.text_extractor(parser)), settings)


def results(found: DataFrame, name: str, query: str, path: str) -> dict:
    """Results as plain values, by rank; what is empty is left out."""
    rows = [json.loads(r) for r in found.orderBy("rank").toJSON().collect()]
    return {"name": name, "query": query, "index_path": path, "results": [{k: v for k, v in r.items() if v not in (None, "", [], {})} for r in rows]}


def query_index(spark: SparkSession, path: str, query: str, request: S.Request | None = None, explain: bool = False, client: clients.Client | None = None, rerank_top: int = 3) -> dict:
    found = S.search_index(I.load_index(spark, path), query, request, explain)
    if client is not None:
        found = clients.rerank(found, query, client, rerank_top).drop("rank").withColumnRenamed("new_rank", "rank")
    return results(found, os.path.basename(path.rstrip("/")), query, path)


def query_corpus(spark: SparkSession, path: str, query: str, wanted: C.CorpusFilter | None = None, request: S.Request | None = None, explain: bool = False, client: clients.Client | None = None, rerank_top: int = 3) -> dict:
    asked = spark.createDataFrame([(0, query)], "qid int, query string")
    found = C.search_corpus(C.load_corpus(spark, path), asked, wanted, request, explain)
    if client is not None:
        found = clients.rerank(found, query, client, rerank_top).drop("rank").withColumnRenamed("new_rank", "rank")
    return results(found, os.path.basename(path.rstrip("/")), query, path)


def settings_of(values: dict, path: str | None = None) -> Settings:
    """Settings from a file, if there is one, and over them the values that are given. Weights and bonuses are merged."""
    given = read(path) if path else {}
    for k, v in values.items():
        if isinstance(v, dict):
            given[k] = {**(given.get(k) or {}), **v}
        elif v is not None:
            given[k] = v
    return load(user=given)
