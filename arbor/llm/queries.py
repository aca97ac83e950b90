"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm import chat, decontaminate, langid, license_scan, lz_fingerprint, order_minhash, packing, quality, shard, spans
from arbor.llm.common import held_out, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    return quality.scored(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_langid_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.select("doc_id", "text", "lang"))
    found = langid.predicted(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.hit_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_license_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_prefix_targets(conversations.unionByName(chat.control_conversation(spark))))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed", "removed")


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_quality_rules": op1_quality_rules, "op2_langid_marginal": op2_langid_marginal, "op4_license_zstd": op4_license_zstd, "op7_lz_fingerprint": op7_lz_fingerprint, "op10_order_minhash": op10_order_minhash, "op8_sentence_spans": op8_sentence_spans, "op3_decontaminate": op3_decontaminate, "op9_best_fit_pack": op9_best_fit_pack, "op5_chat_format": op5_chat_format, "op6_shard": op6_shard}


def oracle_sql() -> dict:
    return {"op3_decontaminate": decontaminate.ORACLE_SQL, "op5_chat_format": chat.ORACLE_SQL}
