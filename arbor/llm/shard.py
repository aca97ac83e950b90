"""Sharding by a hierarchical weighted hash tree, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-buckets of a shard within which slots are numbered; their counts (shards times this) are all that is broadcast.
NUMBERING_BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A shard has a number and a weight; an inner node weighs what its shards weigh."""

    name: str
    shard: int = -1
    weight: float = 1.0
    children: tuple[Node, ...] = field(default=())

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def grid(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Node:
    """A tree over shards 0 to ``shards`` - 1, filled rack by rack and region by region."""
    racks = [
        Node(f"rack{r}", children=tuple(Node(f"shard{s}", s) for s in range(r * shards_per_rack, min(shards, (r + 1) * shards_per_rack))))
        for r in range(-(-shards // shards_per_rack))
    ]
    regions = [
        Node(f"region{g}", children=tuple(racks[g * racks_per_region : (g + 1) * racks_per_region]))
        for g in range(-(-len(racks) // racks_per_region))
    ]
    return Node("", children=tuple(regions))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard in a region of its own: no other subtree's weight changes, so rows move into it only."""
    region = Node(f"region-of-{shard}", children=(Node(f"rack-of-{shard}", children=(Node(f"shard{shard}", shard, weight),)),))
    return Node(tree.name, children=(*tree.children, region))


def _levels(tree: Node) -> list[dict[str, list[tuple[str, float, int]]]]:
    """For each level, path of an inner node to its children as (path, weight, shard or -1), without weightless ones."""
    levels, nodes = [], [("", tree)]
    while nodes:
        level, below = {}, []
        for path, node in nodes:
            live = [c for c in node.children if c.total > 0]
            level[path] = [(f"{path}/{c.name}", float(c.total), c.shard) for c in live]
            below += [(f"{path}/{c.name}", c) for c in live]
        levels.append(level)
        nodes = [x for x in below if x[1].children]
        if nodes and len(nodes) < len(below):
            raise ValueError("all shards have to be at the same depth")
    return levels


def place(df: DataFrame, tree: Node, key: Column, out: str) -> DataFrame:
    """Adds ``out``, the shard that ``key`` (a string) descends to.

    At each level a child's draw is -ln(u) / weight with u in (0, 1) from 52 bits of a hash of key and child's path. The
    least draw wins, which gives each child its weight's share; a changed weight moves keys only to or from that child.
    """
    at = F.lit("")
    for level in _levels(tree):
        children = F.create_map(
            *[x for path, live in level.items() for x in (F.lit(path), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(s).alias("s")) for p, w, s in live]))]
        )

        def draw(c: Column) -> Column:
            bits = F.conv(F.substring(F.md5(F.concat(c["p"], F.lit(":"), key)), 1, 13), 16, 10).cast("double")
            return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / c["w"]).alias("d"), c["p"].alias("p"), c["s"].alias("s"))

        best = F.array_min(F.transform(F.element_at(children, at), draw))
        at = best["p"]
    return df.withColumn(out, best["s"])


def numbered(df: DataFrame, group: str, key: Column, order: list[str], out: str = "slot", buckets: int = NUMBERING_BUCKETS) -> DataFrame:
    """Adds ``out``: 0, 1, ... without gaps within each ``group`` value, without bringing a whole group into one task.

    Rows are numbered within (group, bucket of the key's hash); the number of rows in the buckets before is added. Both are
    dealt by (group, bucket), so they meet where they are; Spark broadcasts the counts only if their size allows it.
    """
    b = f"{out}_bucket"
    df = df.withColumn(b, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = df.groupBy(group, b).agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, b, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{out}_start"))
    within = F.row_number().over(Window.partitionBy(group, b).orderBy(*order)) - 1
    return (
        df.withColumn(f"{out}_in", within)
        .join(starts, [group, b])
        .withColumn(out, (F.col(f"{out}_start") + F.col(f"{out}_in")).cast("long"))
        .drop(b, f"{out}_start", f"{out}_in")
    )


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Every row of ``documents`` in a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: doc_id and the tree decide. A null doc_id is the key ``null``; a null text has size 1 and crc32 0. Rows
    that are repeated go to the same shard and get slots of their own. An empty table gives no rows. Other columns are
    neither read nor returned. A shard is numbered in buckets of doc_id's hash, so a bucket is the most a task holds.
    """
    tree = grid(shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = place(rows, tree, key, "shard")
    rows = numbered(rows, "shard", F.col("doc_id"), ["doc_id", "text_crc32", "size"])
    rows = place(rows, grown(tree, shards), key, "grown_shard")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
