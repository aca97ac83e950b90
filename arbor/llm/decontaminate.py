"""Benchmark decontamination by a prefix-filtered set join.

An item's window of words is contained in a document if all its shingles are, in place. So, as in prefix-filtered joins at
a threshold of one, a single shingle of each window is joined: the rarest one, in the order of corpus frequencies. The
position of that shingle in the window and the document's length bound where the window can begin; there it is verified
word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import WordHashes, rolling, words

WINDOW = 10
SHINGLE = 3
#: Windows joined in one pass over the documents. A block's index holds at most so many, with their words.
BLOCK = 400_000


def windows_of(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every run of ``size`` words; all words if there are fewer; none without words."""
    ws = words(text)
    if not ws:
        return []
    return [tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]


def _shingles(hashes: np.ndarray, shingle: int) -> np.ndarray:
    return rolling(hashes, min(shingle, len(hashes)))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that hold them: words (space-separated), items (sorted array of strings; items without
    an id are one null, the last)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {(b" ".join(w), None if i is None else str(i)) for i, t in zip(batch["item"], batch["text"]) for w in windows_of(t, size)}
            yield pd.DataFrame({"words": [w.decode("utf-8", "surrogatepass") for w, _ in rows], "item": [i for _, i in rows]})

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    # Sets leave nulls out, so the item is collected in an array.
    held = F.array_sort(F.flatten(F.collect_set(F.array("item"))))
    return items.mapInPandas(split, "words string, item string").groupBy("words").agg(held.alias("items"))


class _Lookup:
    """Membership of 64-bit hashes: a bitmap passes few others, then a sorted array decides."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.sorted)) * 64))))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.shift = np.uint64(64 - self.bits)
        self.bitmap[(self.sorted >> self.shift).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bitmap[(hashes >> self.shift).astype(np.int64)])
        if len(at) == 0:
            return at
        own = hashes[at]
        place = np.minimum(np.searchsorted(self.sorted, own), len(self.sorted) - 1)
        return at[self.sorted[place] == own]


def _frequencies(documents: DataFrame, wanted: np.ndarray, lengths: list[int]) -> dict[int, int]:
    """How often each wanted shingle occurs over all documents. At most as many rows as ``wanted`` come back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, cache = _Lookup(wanted), WordHashes()
        total = np.zeros(len(lookup.sorted), np.int64)
        for batch in batches:
            for text in batch["text"]:
                hashes = cache.of(words(text))
                for n in lengths:
                    own = rolling(hashes, n)
                    own = own[lookup.hits(own)]
                    if len(own):
                        np.add.at(total, np.searchsorted(lookup.sorted, own), 1)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"h": lookup.sorted[seen].view(np.int64), "n": total[seen]})

    counted = documents.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return {r["h"] & (2**64 - 1): r["n"] for r in counted.collect()}


class _Index:
    """The windows of a block under the one shingle of each that is rarest in the corpus."""

    def __init__(self, rows: list[tuple[bytes, list[str | None]]], frequency: dict[int, int], shingle: int):
        cache = WordHashes()
        self.windows: dict[int, list[tuple[int, tuple[bytes, ...], list[str | None]]]] = defaultdict(list)
        self.lengths: set[int] = set()
        prefix = []
        for text, items in rows:
            ws = tuple(text.split())
            own = _shingles(cache.of(list(ws)), shingle)
            at = min(range(len(own)), key=lambda k: (frequency.get(int(own[k]), 0), int(own[k])))
            self.windows[int(own[at])].append((at, ws, items))
            self.lengths.add(min(shingle, len(ws)))
            prefix.append(own[at])
        self.lookup = _Lookup(np.array(prefix, np.uint64))

    def find(self, ws: list[bytes], hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str | None]]:
        """The places (start, end) of windows among the words, and the items they are from."""
        places, items = [], set()
        for n in self.lengths:
            own = rolling(hashes, n)
            for at in self.lookup.hits(own).tolist():
                for offset, window, of in self.windows[int(own[at])]:
                    start = at - offset
                    if start >= 0 and start + len(window) <= len(ws) and tuple(ws[start : start + len(window)]) == window:
                        places.append((start, start + len(window)))
                        items.update(of)
        return places, items


def _scan(index: _Index):
    """A function of a text: its number of words, the places of windows and their items."""

    @F.pandas_udf("n_words long, places array<array<long>>, items array<string>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        cache, rows = WordHashes(), []
        for text in texts:
            ws = words(text)
            places, items = index.find(ws, cache.of(ws))
            rows.append((len(ws), [list(p) for p in sorted(set(places))], sorted(items, key=lambda i: (i is None, i or ""))))
        return pd.DataFrame(rows, columns=["n_words", "places", "items"])

    return scan


def _indexes(documents: DataFrame, benchmark: DataFrame, window: int, shingle: int, block: int) -> list[_Index]:
    """An index for each block of at most about ``block`` windows; at least one."""
    all_windows = benchmark_windows(benchmark, window)
    blocks = max(1, -(-all_windows.count() // block))
    out = []
    for k in range(blocks):
        own = all_windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        rows = [(r["words"].encode("utf-8", "surrogatepass"), r["items"]) for r in own.collect()]
        cache, wanted, lengths = WordHashes(), [np.empty(0, np.uint64)], set()
        for text, _ in rows:
            hashes = cache.of(text.split())
            wanted.append(_shingles(hashes, shingle))
            lengths.add(min(shingle, len(hashes)))
        out.append(_Index(rows, _frequencies(documents, np.concatenate(wanted), sorted(lengths)) if rows else {}, shingle))
    return out


def hit_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """For each document row: doc_id, n_words, places (start and end, in words, of each window that occurs), items (sorted;
    items without an id are one null, which report counts in n_items as the SQL does).

    Rows with null text have no words. Every row of ``documents`` is returned, repeated ones too. The benchmark's windows
    are joined in blocks of at most about ``block``; a block's index goes to the executors, so its size is bounded whatever
    the benchmark's. With more than one block, a document's places are brought together by its text's digest.
    """
    indexes = _indexes(documents, benchmark, window, shingle, block)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(indexes) == 1:
        return rows.select("doc_id", _scan(indexes[0])("text").alias("s")).select("doc_id", "s.*")
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    found = [rows.select("doc_id", digest, _scan(index)("text").alias("s")).select("doc_id", "digest", "s.*") for index in indexes]
    rest = reduce(DataFrame.unionByName, [x.where(F.size("places") > 0).select("digest", "places", "items") for x in found[1:]])
    rest = rest.groupBy("digest").agg(F.flatten(F.collect_set("places")).alias("more_places"), F.flatten(F.collect_set("items")).alias("more_items"))
    return found[0].join(rest, "digest", "left").select(
        "doc_id",
        "n_words",
        F.array_sort(F.array_union("places", F.coalesce("more_places", F.array().cast("array<array<long>>")))).alias("places"),
        F.array_sort(F.array_union("items", F.coalesce("more_items", F.array().cast("array<string>")))).alias("items"),
    )


def report(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``hit_spans``."""
    # Places are sorted by start: a place adds the words beyond the furthest end so far.
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(F.greatest(a["end"], p[1]).alias("end"), (a["n"] + F.greatest(F.lit(0), p[1] - F.greatest(a["end"], p[0]))).alias("n")),
    )["n"]
    return spans.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The documents without a window of the benchmark, with their columns as they are. Rows with null text stay."""
    indexes = _indexes(documents, benchmark, window, shingle, block)

    def dirty(index: _Index, text: Column) -> Column:
        return F.size(_scan(index)(text)["places"]) > 0

    if len(indexes) == 1:
        return documents.where(~dirty(indexes[0], F.col("text")))
    found = [documents.where(dirty(index, F.col("text"))).select("text") for index in indexes]
    return documents.join(reduce(DataFrame.unionByName, found).distinct(), "text", "left_anti").select(*documents.columns)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
i as (select cast(item_id as varchar) as id, {_WORDS} as w from benchmark where text is not null),
windows as (
  select distinct id, n, array_to_string(w[k:k + n - 1], ' ') as s
  from (select id, w, least(10, len(w)) as n, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from i where len(w) > 0)
), places as (
  select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from windows) where len(w) >= n)
), hits as (select doc_id, k, n, id from places join windows using (n, s)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, id from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""
