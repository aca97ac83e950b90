"""Lempel-Ziv phrase fingerprints.

A text is parsed left to right into phrases, each the shortest one not seen before; the set of phrases is a dictionary that
a compressor would build. The least hashes of the phrases are the fingerprint, and the share of least hashes that two
fingerprints have in common estimates how much of their dictionaries the texts share.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import partitions

#: Hashes of 32 bits in a fingerprint.
SIZE = 64
#: Ranges of doc_id that are sorted apart, for each shuffle partition; the bounds and first ids of these reach the driver.
RANGES = 4
_LOWEST = -(1 << 63)


def parse(text: str, start: int, end: int, phrases: set[str], added: list[str] | None = None) -> int:
    """Adds the phrases of ``text[start:end]``, to ``added`` too, and returns where the unfinished last one begins.

    The phrases known so far hold every prefix of each, so the longest known one at a place is found by stepping up or
    down from the length of the one before.
    """
    add, length = phrases.add, 2
    note = (lambda phrase: None) if added is None else added.append
    while True:
        stop = start + length
        if stop > end:
            length, stop = end - start, end
        if length and text[start:stop] in phrases:
            while stop < end and text[start : stop + 1] in phrases:
                stop += 1
        else:
            while stop > start:
                stop -= 1
                if stop == start or text[start:stop] in phrases:
                    break
        if stop >= end:
            return start
        phrase = text[start : stop + 1]
        add(phrase)
        note(phrase)
        length = max(1, stop - start)
        start = stop + 1


def finished(text: str, start: int, phrases: set[str]) -> set[str]:
    """The phrases of the rest of ``text`` added, with the unfinished one."""
    at = parse(text, start, len(text), phrases)
    if at < len(text):
        phrases.add(text[at:])
    return phrases


def additions(text: str, start: int, phrases: set[str]) -> list[str]:
    """The phrases that the rest of ``text`` adds, with the unfinished one; ``phrases`` stay as they were."""
    added: list[str] = []
    at = parse(text, start, len(text), phrases, added)
    phrases.difference_update(added)
    if at < len(text):
        added.append(text[at:])
    return added


def signature(phrases: Collection[str], size: int = SIZE) -> np.ndarray:
    """The ``size`` least 32-bit hashes of the phrases, ascending; all if they are fewer."""
    import xxhash

    h = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases)) >> np.uint64(32))
    return h[:size].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The estimated share of phrases in common, 0 to 1: of the least hashes of both together, those that both have."""
    least = joined(a, b, size)
    if not len(least):
        return 1.0
    return float(np.isin(least, a).astype(int) @ np.isin(least, b).astype(int)) / len(least)


def joined(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The signature of the phrases of two signatures together."""
    return np.unique(np.concatenate([a, b]))[:size]


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint(text: str | None, size: int = SIZE) -> np.ndarray:
    return signature(finished(text or "", 0, set()), size)


class _Document:
    """A document with its fingerprint and the parse of what an edit of its last half leaves."""

    def __init__(self, doc_id: int | None, text: str, size: int):
        self.doc_id, self.text, self.size = doc_id, text, size
        self.left = len(text) - len(text) // 2
        self.phrases: set[str] = set()
        self.at = parse(text, 0, self.left, self.phrases)
        # What both texts begin with is parsed and hashed once.
        self.begun = signature(self.phrases, size)
        self.signature = joined(self.begun, signature(additions(text, self.at, self.phrases), size), size)

    def row(self, after: _Document) -> tuple:
        edited = self.text[: self.left] + after.text[: len(self.text) // 2]
        other = joined(self.begun, signature(additions(edited, self.at, self.phrases), self.size), self.size)
        return (
            self.doc_id,
            len(self.text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            as_text(self.signature),
            as_text(other),
            likeness(self.signature, other, self.size),
            likeness(self.signature, after.signature, self.size),
        )


def _ranges(rows: DataFrame, n: int) -> tuple[Column, Column]:
    """The number of a row's range, ascending as ids descend, and the order of rows that share an id.

    Bounds are quantiles of the ids. An id that takes up several of them, as null may, is split by the hash of the text, so no
    range depends on how often an id occurs. A range is looked up in two steps, of a square root of their number each.
    """
    found = rows.agg(F.percentile_approx("key", [(k + 1) / n for k in range(n - 1)], max(10_000, 10 * n))).first()[0] or []
    bounds = sorted(set(found))
    hot = {k: times for k, times in Counter(found).items() if times > 1}
    step = max(1, math.isqrt(len(bounds)))
    chunks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    if not bounds:
        return F.lit(0).cast("long"), F.col("none").cast("long")
    passed = F.size(F.filter(longs([c[-1] for c in chunks]), lambda b: b < F.col("key")))
    inside = F.size(F.filter(F.get(F.array(*[longs(c) for c in chunks]), passed), lambda b: b < F.col("key")))
    below = F.when(passed == len(chunks), len(bounds)).otherwise(passed * step + inside)
    number, order = (len(bounds) - below).cast("long"), F.col("none").cast("long")
    last = 1 << 20
    if not hot:
        return number * last, order
    times = F.element_at(F.create_map(*[x for k, m in hot.items() for x in (F.lit(k).cast("long"), F.lit(m).cast("long"))]), F.col("key"))
    # 61 bits of the hash, those of rows without an id after the others.
    mixed = F.shiftrightunsigned(F.xxhash64("text"), 3) + F.when(F.col("none"), F.lit(1 << 61)).otherwise(F.lit(0).cast("long"))
    part = F.floor(mixed / (F.lit(float(1 << 62)) / times))
    return number * last + F.when(times.isNull(), last - 1).otherwise(F.least(part, F.lit(last - 2))), F.when(times.isNull(), order).otherwise(mixed)


def in_ring(documents: DataFrame) -> DataFrame:
    """bucket, ghost, key, none and text, sorted within partitions so that a row's next document follows it in its bucket.

    Buckets are ranges of doc_id. The first document of each range is sent to the range before as well, as a ghost, and the
    first of all to the last, so one shuffle of the texts is all that finding the next document takes. The first ids are a row
    for each range, which is what is broadcast.
    """
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bucket, order = _ranges(rows, RANGES * partitions(documents))
    rows = rows.select(bucket.alias("bucket"), "key", "none", order.alias("order"), "text")
    found = rows.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("key").alias("down"), "order")).alias("first")).orderBy("bucket").collect()
    # Buckets ascend as ids descend: the first of a bucket is also wanted by the bucket before it.
    wanted = [(~r["first"]["down"], r["first"]["order"], found[k - 1]["bucket"]) for k, r in enumerate(found)]
    firsts = documents.sparkSession.createDataFrame(wanted, "key long, order long, also long")
    rows = rows.join(F.broadcast(firsts), ["key", "order"], "left")
    own = F.struct("bucket", F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("also").alias("bucket"), F.lit(True).alias("ghost"))
    placed = rows.withColumn("p", F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    placed = placed.select("p.bucket", "p.ghost", "key", "none", "order", "text")
    return placed.repartition(partitions(documents), "bucket").sortWithinPartitions("bucket", "ghost", F.desc("key"), "order", "text")


def fingerprints(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's first ones, or
    all. The next document has the next lower doc_id, after the lowest the highest; rows with the same doc_id follow each
    other in order of their texts, or of their texts' hashes where there are very many, null ids come after all others, and a
    single row is its own next. Null texts are empty; an empty text has an empty fingerprint, which is like another empty one
    only. Texts are taken whole, an empty table gives no rows, and other columns are not looked at.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, bucket = None, None
        for batch in batches:
            out = []
            for b, ghost, key, none, text in zip(batch["bucket"], batch["ghost"], batch["key"], batch["none"], batch["text"]):
                if b != bucket:
                    before, bucket = None, b
                if ghost and before is None:
                    continue  # a second ghost of the same id
                now = _Document(None if none else int(key), text, size)
                if before is not None:
                    out.append(before.row(now))
                before = None if ghost else now
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = pd.array([r[0] for r in out], dtype="Int64")
            yield frame

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ring(documents).mapInPandas(walk, schema)
