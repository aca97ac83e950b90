"""Helpers that the operators share: tables, words, hashes and lineage cuts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.operators.lineage import cut, drop, shared_folder, unused

__all__ = ["WordHashes", "cut", "drop", "held_out", "mixed", "partitions", "rolling", "seeds", "shared_folder", "signed", "table", "unused", "words"]

#: ASCII characters other than letters and digits become spaces and A-Z become a-z; bytes over 0x7F stay.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words ``[0-9A-Za-z and everything over 0x7F]+`` of a text, A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash, filled on demand and emptied when it holds ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        import xxhash

        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.hash(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` items; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return mixed(out)


def seeds(n: int, start: int) -> np.ndarray:
    return mixed(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) | np.uint64(1)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def held_out(doc_id: Column) -> Column:
    """True for rows that labels are never learned from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
