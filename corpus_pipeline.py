"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of ``documents``; the last
returns packed pieces. A stage's result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm import decontaminate, order_minhash, packing, quality, spans
from arbor.llm.common import shared_folder, table


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*like.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of label 1. It learns from labelled rows that aren't held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    kept = quality.scored(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model).where("predicted = 1")
    return kept.select("_row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the lowest doc_id. Rows without an id or a word stay."""
    return _as_documents(order_minhash.one_of_each(docs), docs)


def span_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated spans; n_chars follows the text."""
    # Own columns that are called as what the operator adds go by other names for the time.
    own = [f"own_{k}_{c}" if c.lower() in ("n_sentences", "n_removed", "removed") else c for k, c in enumerate(docs.columns)]
    cleaned = spans.deduplicated(docs.toDF(*own))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in own]).toDF(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return _as_documents(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("sentence_spans", span_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``. Results of stages go to the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
