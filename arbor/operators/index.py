"""The fielded inverted index: nodes with normalised fields, postings and statistics, each a DataFrame."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbor.functions import text as T
from arbor.operators.lineage import delete
from arbor.settings import FIELDS, Settings, load

FORMAT = 2
#: Folders of a saved index's postings, by a hash of the term; a query reads those of its terms.
BUCKETS = 64
TABLES = ("nodes", "postings", "term_stats", "field_stats")
NODE_COLUMNS = {
    "doc_id": "string",
    "node_idx": "int",
    "node_id": "string",
    "title": "string",
    "summary": "string",
    "prefix_summary": "string",
    "text": "string",
    "start_index": "int",
    "end_index": "int",
    "depth": "int",
    "parent_id": "string",
    "ancestor_ids": "array<string>",
    "path_titles": "array<string>",
    "is_leaf": "boolean",
}


def complete(nodes: DataFrame) -> DataFrame:
    """``nodes`` with all columns of a node in their types; missing ones are null, or empty arrays."""
    out = []
    for name, kind in NODE_COLUMNS.items():
        given = F.col(name).cast(kind) if name in nodes.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(given, F.array().cast(kind)) if kind.startswith("array") else given).alias(name))
    return nodes.select(*out)


def with_fields(nodes: DataFrame, include_text: bool = False, composed: bool = False) -> DataFrame:
    """``nodes`` with ``norms``, the five fields in normalised form. Text counts for leaves only, and only if included."""
    raw = {name: F.col(name) for name in FIELDS} | {"path_titles": F.array_join("path_titles", " ")}
    raw["text"] = F.when(F.col("is_leaf"), F.col("text")) if include_text else F.lit(None).cast("string")
    return nodes.withColumn("norms", F.struct(*[T.normalized(raw[f], composed).alias(f) for f in FIELDS]))


def field_rows(nodes: DataFrame) -> DataFrame:
    """Five rows for each node: doc_id, node_idx, field, norm, toks, field_len."""
    rows = nodes.select("doc_id", "node_idx", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("norms")[f].alias("norm")) for f in FIELDS])).alias("f"))
    rows = rows.select("doc_id", "node_idx", "f.field", "f.norm").withColumn("toks", T.tokens(F.col("norm")))
    return rows.withColumn("field_len", F.size("toks"))


def postings(rows: DataFrame) -> DataFrame:
    """doc_id, field, term, node_idx, tf, positions, field_len. Counted before the shuffle, which only carries postings."""
    each = rows.select("doc_id", "field", "node_idx", "field_len", F.posexplode("toks").alias("pos", "term"))
    return each.groupBy("doc_id", "field", "term", "node_idx", "field_len").agg(
        F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")
    )


def runs(toks: Column, terms: list[str] | None = None) -> Column:
    """(term, positions) for each different token of an array, or each of ``terms`` in it, in the order of the tokens. It
    takes a sort of the places and no more."""
    placed = F.transform(toks, lambda t, n: F.struct(t.alias("term"), n.alias("pos")))
    if terms is not None:
        placed = F.filter(F.transform(toks, lambda t, n: F.when(t.isin(terms), F.struct(t.alias("term"), n.alias("pos")))), lambda x: x.isNotNull())

    def cut(p: Column) -> Column:
        last = F.size(p)
        at = F.filter(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: (last > 0) & ((i == 0) | (F.get(p, i)["term"] != F.get(p, i - 1)["term"])))
        return T.let(at, lambda a: F.transform(a, lambda i, k: F.struct(F.get(p, i)["term"].alias("term"), F.transform(F.slice(p, i + 1, F.coalesce(F.get(a, k + 1), last) - i), lambda x: x["pos"]).alias("positions"))))

    return T.let(F.sort_array(placed), cut)


def postings_of_rows(rows: DataFrame) -> DataFrame:
    """``postings`` where no two rows are of the same field and node: each row's are its own, so nothing is shuffled."""
    each = rows.select("doc_id", "field", "node_idx", "field_len", F.inline(runs(F.col("toks"))))
    return each.select("doc_id", "field", "term", "node_idx", "field_len", F.size("positions").alias("tf"), "positions")


def term_statistics(post: DataFrame) -> DataFrame:
    """How many nodes of a document hold a term in a field."""
    return post.groupBy("doc_id", "field", "term").agg(F.count("*").alias("df"))


def field_statistics(nodes: DataFrame, post: DataFrame) -> DataFrame:
    """n_nodes and avg_len for each document and field; nodes without the field count with length 0."""
    sizes = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes")).select("doc_id", "n_nodes", F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field"))
    total = post.groupBy("doc_id", "field").agg(F.sum("tf").alias("total"))
    mean = F.coalesce(F.col("total") / F.col("n_nodes"), F.lit(0.0))
    return sizes.join(total, ["doc_id", "field"], "left").select("doc_id", "n_nodes", "field", mean.alias("avg_len"))


def with_statistics(post: DataFrame, field_stats: DataFrame) -> DataFrame:
    """Postings with what their weight takes: df, n_nodes and avg_len, so that a search joins no statistics."""
    df = F.count("*").over(Window.partitionBy("doc_id", "field", "term"))
    return post.withColumn("df", df).join(field_stats, ["doc_id", "field"])


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    """The weight of a term in a field; an average of 0 counts as 1, a length of 0 as well."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = F.when(average > 0, average).otherwise(F.lit(1.0))
    return idf * (k1 + 1) * tf / (k1 * (1 - b + b * F.greatest(length, F.lit(1)) / mean) + tf)


@dataclass
class Index:
    """Nodes, postings and statistics of any number of documents, with the settings they were built with."""

    nodes: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    settings: Settings
    #: The nodes again if each is one row and they are dealt by document; then a search for few queries stays within documents.
    local: DataFrame | None = None

    def within(self, docs: DataFrame) -> Index:
        """The index of those documents that ``docs`` (doc_id) has."""
        if self.local is not None:
            return local_index(self.local.drop("norms").join(docs, "doc_id", "left_semi"), self.settings)
        return replace(self, nodes=self.nodes.join(docs, "doc_id", "left_semi"), postings=self.postings.join(docs, "doc_id", "left_semi"))

    def save(self, path: str) -> None:
        """Writes the tables as a generation of their own, then the manifest that names it, then deletes those before. So an
        index may be saved where it was loaded from, and a reader sees one or the other."""
        spark, generation = self.nodes.sparkSession, uuid.uuid4().hex
        self._write(f"{path}/{generation}", "first")
        old = _manifest(spark, path)
        manifest = json.dumps({"format": FORMAT, "generation": generation, "settings": self.settings.as_dict()})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        if old:
            delete(spark, f"{path}/{old['generation']}")

    def append(self, path: str, batch: str | None = None) -> None:
        """Adds this index's documents to the tables at ``path``: statistics are by document, so nothing there changes. Writing
        the same ``batch`` again replaces it, and one that isn't written whole isn't seen."""
        self._write(f"{path}/{_manifest(self.nodes.sparkSession, path)['generation']}", batch or uuid.uuid4().hex)

    def _write(self, base: str, batch: str) -> None:
        """Nodes, then their postings, tokenised once, then all statistics from these; last the mark that the batch is whole."""
        spark = self.nodes.sparkSession

        def written(df: DataFrame, name: str, *by: str) -> DataFrame:
            at = f"{base}/{name}/batch={batch}"
            df.write.mode("overwrite").partitionBy(*by).parquet(at)
            return spark.read.parquet(at)

        delete(spark, f"{base}/whole/batch={batch}")
        nodes = written(self.nodes, "nodes")
        post = written(postings(field_rows(nodes)), "counted")
        field_stats = written(field_statistics(nodes, post), "field_stats")
        order = ("bucket", "term", "doc_id", "node_idx")
        # Ranges of all of these, so that a term that is everywhere is dealt out; sorted, so that row groups can be skipped.
        ranged = with_statistics(post, field_stats).withColumn("bucket", bucket(F.col("term"))).repartitionByRange(*order).sortWithinPartitions(*order)
        ranged = written(ranged, "postings", "bucket")
        written(ranged.select("doc_id", "field", "term", "df").distinct().sortWithinPartitions("term"), "term_stats")
        delete(spark, f"{base}/counted/batch={batch}")
        spark.createDataFrame([(batch,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/whole/batch={batch}")


def _manifest(spark: SparkSession, path: str) -> dict | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return None
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def build_index(nodes: DataFrame, settings: Settings | None = None, composed: bool = False) -> Index:
    """The index over ``nodes``; every statistic is by document, as each document is an index of its own."""
    settings = settings or Settings()
    full = with_fields(complete(nodes), settings.index_include_text, composed)
    post = postings(field_rows(full))
    field_stats = field_statistics(full, post)
    return Index(full, with_statistics(post, field_stats), term_statistics(post), field_stats, settings)


def local_index(nodes: DataFrame, settings: Settings | None = None) -> Index:
    """``build_index`` over nodes that are one row each and dealt by document: statistics are by document, so no step
    shuffles, and a query that is asked once needs no saved index."""
    settings = settings or Settings()
    full = with_fields(complete(nodes), settings.index_include_text)
    rows = field_rows(full)
    held = rows.select("doc_id", "field", F.explode(F.array_distinct("toks")).alias("term"))
    field_stats = rows.groupBy("doc_id", "field").agg(F.count("*").alias("n_nodes"), F.avg("field_len").alias("avg_len")).select("doc_id", "n_nodes", "field", "avg_len")
    return Index(full, with_statistics(postings_of_rows(rows), field_stats), term_statistics(held), field_stats, settings, full)


def load_index(spark: SparkSession, path: str) -> Index:
    """The saved index, without batches that aren't whole. Settings that the manifest lacks take their defaults; stored zeros
    stay."""
    manifest = _manifest(spark, path)
    if manifest is None or manifest.get("format") != FORMAT:
        raise ValueError(f"no index of format {FORMAT} at {path}")
    stored = manifest.get("settings", {})
    for name in ("recursive_split_heading_patterns",):
        if name in stored:
            stored[name] = tuple(stored[name])
    base = f"{path}/{manifest['generation']}"
    whole = [r["value"] for r in spark.read.text(f"{base}/whole").select("value").collect()]
    tables = [spark.read.option("basePath", f"{base}/{name}").parquet(*[f"{base}/{name}/batch={b}" for b in whole]).drop("batch") for name in TABLES]
    return Index(*tables, load(stored=stored))
