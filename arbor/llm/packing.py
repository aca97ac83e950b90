"""Best-fit packing of tokenised documents by a linear grouping scheme.

Documents are tokenised in parallel; only the histogram of piece lengths (at most as many rows as the capacity) reaches the
driver, which plans in counts, never in single documents. So planning costs the same for a thousand or a trillion pieces.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import cut, partitions
from arbor.llm.shard import numbered

CAPACITY = 1024
END = 2
#: Lengths of up to this share of the capacity are small: they fill what the configurations leave.
SMALL = 0.12
GROUPS = 64
#: A bin made by a configuration stands if at most this share of it is left once documents have taken the places. The plan
#: is made for each of these, and the one with the fewest bins is taken.
SLACKS = (0.0, 0.002, 0.01, 0.03)

_SPECIAL = ("<|endoftext|>", 50256)
#: Beyond these characters the two libraries may know different versions of Unicode.
_PLAIN = re.compile(r"[^\x00-ɏ]").search
_coders: dict = {}


def _coder(tokenizer: str):
    """A function from text to token ids. Texts of Latin characters go through tiktoken, which has the same vocabulary and
    gives the same ids about five times as fast; all others through tokenizers itself."""
    if tokenizer not in _coders:
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public.path(tokenizer))
        with open(public.path(tokenizer.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL[0]: _SPECIAL[1]})

        def ids(text: str) -> np.ndarray:
            if _PLAIN(text):
                return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
            return quick.encode_to_numpy(text, allowed_special="all")

        _coders[tokenizer] = ids
    return _coders[tokenizer]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first takes the remainder, the others are full."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is empty and so consists of ``end`` alone."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _coder(tokenizer)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                own = np.append(ids(text or ""), np.uint32(end)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(own), capacity)):
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(own[s : s + n].tobytes()))
            out = pd.DataFrame({"piece": piece, "start": start, "length": length, "ids_crc32": crc})
            out.insert(0, "doc_id", batch["doc_id"].iloc[at].array)
            yield out

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """The fractional optimum over configurations of a few sizes, by column generation: (how many of each size, times)."""
    g = len(sizes)
    columns = np.diag(np.maximum(capacity // sizes, 1).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    times = inverse @ demand
    for k in range(rounds):
        worth = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        taken = np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = sizes <= c
            gain = np.where(fits, best[np.where(fits, c - sizes, 0)] + worth, -1.0)
            j = int(gain.argmax())
            if gain[j] > best[c - 1] + 1e-12:
                best[c], taken[c] = gain[j], j
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-6:
            break
        new, c = np.zeros(g), capacity
        while c > 0:
            if taken[c] < 0 or best[c] == best[c - 1]:
                c -= 1
            else:
                new[taken[c]] += 1
                c -= sizes[taken[c]]
        direction = inverse @ new
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, times / direction, np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        times = np.maximum(times - step * direction, 0)
        times[out] = step
        columns[:, out] = new
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        if k % 200 == 199:
            inverse = np.linalg.inv(columns)
            times = np.maximum(inverse @ demand, 0)
    return [(columns[:, j].astype(int), times[j]) for j in range(g)]


def _grouped(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Large lengths, ascending, in runs of about equal cardinality; a length is in one group, so copies stay together."""
    total, out, room = sum(counts.values()), [], 0.0
    for length in sorted(counts):
        if room <= 0:
            out.append([])
            room += total / groups
        out[-1].append(length)
        room -= counts[length]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS, slacks: tuple[float, ...] = SLACKS) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in a bin, number of such bins): every piece of ``histogram`` (length to count) is in one bin.

    Full pieces are bins of their own. Large lengths are rounded up within groups of equal cardinality and configurations
    of the rounded sizes are optimised; each is used at most as often as the whole part of its optimum says. Actual lengths
    take the places of their group, longest first, the last place the longest that still fits. Where too much of a bin
    stays empty, its pieces go with those that the whole parts leave over and the small ones: placed longest first, each
    where the least room is left that holds it, in counts of equal bins at a time.
    """
    pieces = {length: n for length, n in histogram.items() if n > 0}
    large = {length: n for length, n in pieces.items() if small * capacity < length < capacity}
    grouped = _grouped(large, groups) if large else []
    sizes = np.array([max(g) for g in grouped], int)
    chosen: list[tuple[np.ndarray, int]] = []
    if large:
        demand = np.array([float(sum(large[x] for x in g)) for g in grouped])
        # The fullest configurations choose first.
        chosen = sorted(((c, int(t + 1e-9)) for c, t in _configurations(sizes, demand, capacity)), key=lambda x: -int(x[0] @ sizes))
    plans = [_substituted(dict(pieces), grouped, chosen, capacity, slack) for slack in (slacks if large else slacks[:1])]
    return min(plans, key=lambda bins: sum(n for _, n in bins))


def _substituted(left: dict[int, int], grouped: list[list[int]], chosen: list[tuple[np.ndarray, int]], capacity: int, slack: float) -> list[tuple[tuple[int, ...], int]]:
    """Full pieces as bins, then documents in the places of configurations, then the rest by best fit."""
    bins: dict[tuple[int, ...], int] = defaultdict(int)
    if left.get(capacity):
        bins[(capacity,)] = left.pop(capacity)
    group_of = {x: g for g, own in enumerate(grouped) for x in own}
    longest = [sorted(g) for g in grouped]
    stock = sorted(group_of)
    for config, times in chosen:
        wanted = [int(g) for g in np.flatnonzero(config)[::-1] for _ in range(config[g])]
        while times > 0:
            taken: dict[int, int] = defaultdict(int)
            for k, g in enumerate(wanted):
                room = capacity - sum(x * c for x, c in taken.items())
                own = stock if k == len(wanted) - 1 else longest[g]
                at = bisect_right(own, room) - 1
                while at >= 0 and left[own[at]] <= taken[own[at]]:
                    at -= 1
                if at < 0:
                    break
                taken[own[at]] += 1
            lengths = tuple(sorted((x for x, c in taken.items() for _ in range(c)), reverse=True))
            if len(lengths) < len(wanted) or capacity - sum(lengths) > slack * capacity:
                break
            n = min([times, *(left[x] // c for x, c in taken.items())])
            bins[lengths] += n
            times -= n
            for x, c in taken.items():
                left[x] -= n * c
                if left[x] == 0:
                    longest[group_of[x]].remove(x)
                    stock.remove(x)
    return _best_fit(bins, left, capacity)


def _best_fit(bins: dict[tuple[int, ...], int], left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Places what is left, longest first, where the least room is left that holds it."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for lengths, n in bins.items():
        room[capacity - sum(lengths)][lengths] = n
    for length in sorted((x for x, n in left.items() if n > 0), reverse=True):
        n = left[length]
        while n > 0:
            fit = min((r for r, kinds in room.items() if r >= length and kinds), default=None)
            if fit is None:
                per = capacity // length
                full, rest = divmod(n, per)
                for k, times in ((per, full), (rest, 1)):
                    if k and times:
                        kinds = room[capacity - k * length]
                        kinds[(length,) * k] = kinds.get((length,) * k, 0) + times
                break
            lengths, times = next(iter(room[fit].items()))
            per = fit // length
            full, rest = min(times, n // per), 0
            if full < times and n - full * per > 0:
                rest = n - full * per
                rest = rest if rest < per else 0
            for k, taken in ((per, full), (rest, 1)):
                if k and taken:
                    kinds = room[fit - k * length]
                    kinds[lengths + (length,) * k] = kinds.get(lengths + (length,) * k, 0) + taken
                    n -= k * taken
                    times -= taken
            if times:
                room[fit][lengths] = times
            else:
                del room[fit][lengths]
    return [(lengths, n) for _, kinds in sorted(room.items()) for lengths, n in kinds.items()]


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first bin, times, offset): ranks of that length in order, a run for a place."""
    out, used, first = defaultdict(list), defaultdict(int), 0
    for lengths, n in bins:
        offset = 0
        for length in lengths:
            out[length].append((used[length], first, n, offset))
            used[length] += n
            offset += length
        first += n
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of equal length are interchangeable for the plan; each is given a rank among those of its length (numbered in
    buckets, so that a length which many documents have isn't brought into one task), and the rank says its place. Null
    ids and repeated rows are packed like any others; an empty table gives no rows. Tokens are written to the shared
    checkpoint folder as lengths and checksums once, as the histogram and the ranks need them.
    """
    pieces = cut(tokenised(documents, tokenizer, capacity, end))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    ranked = numbered(pieces, "length", F.struct("doc_id", "piece", "ids_crc32"), ["doc_id", "piece", "start", "ids_crc32"], "rank", max(256, partitions(documents)))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for own in np.unique(length):
                rows, runs = np.flatnonzero(length == own), where[int(own)]
                run = runs[np.searchsorted(runs[:, 0], rank[rows], side="right") - 1]
                sequence[rows] = run[:, 1] + rank[rows] - run[:, 0]
                offset[rows] = run[:, 3]
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(locate, schema)
