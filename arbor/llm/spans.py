"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import WordHashes, cut, drop, mixed, rolling, seeds, signed, unused
from arbor.llm.common import words as spaced_words

#: Sentences of a span, and the fewest words a span needs: shorter ones recur by chance.
SENTENCES = 3
LEAST_WORDS = 12
#: The fewest words of a sentence, so that any three are a span. None has over 2 * SHORTEST - 1, so that any 27 words of a
#: text hold three whole ones.
SHORTEST = 4
#: Words cut at a time, and spans sent on at a time, about.
AT_ONCE = 200_000

#: Letters of scripts that put no spaces between words: each is a word. Their stops and blanks are in no word.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_STOPS = "\u3000-\u3004\u3008-\u3040\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_UNSPACED = re.compile(f"[{_ALONE}{_STOPS}]")
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_WORD_OR_LETTER = re.compile(f"[{_ALONE}]|(?:(?![{_ALONE}{_STOPS}])[0-9A-Za-z\\x80-\U0010ffff])+")
_PLACE = seeds(2 * SHORTEST, 8000)


def words(text: str | None) -> list[bytes]:
    """The words of a text; where a script has no spaces between words, its letters."""
    if text and not text.isascii() and _UNSPACED.search(text):
        text = " ".join(_WORD_OR_LETTER.findall(text))
    return spaced_words(text)


def _starts(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where sentences start in the words of texts laid end to end; ``lengths`` are the texts' numbers of words, over 0.

    Words that may start one are taken by the hash of the word and the one before, the least first, as far as those taken
    stay ``SHORTEST`` apart from each other and from the text's ends. As long as any is left that may, it is taken, so no
    sentence has ``2 * SHORTEST`` words. The choice depends on the words near by, not on where the text begins.
    """
    none = np.uint64(2**64 - 1)
    ends = np.cumsum(lengths)
    first = ends - lengths
    rank = np.full(len(hashes), none)
    rank[1:] = np.minimum(mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]), none - np.uint64(1))
    for k in range(SHORTEST):
        rank[np.minimum(first + k, ends - 1)] = none
    for k in range(1, SHORTEST):
        rank[np.maximum(ends - k, first)] = none
    taken = np.zeros(len(hashes), bool)
    taken[first] = True
    for _ in range(5):
        best = rank < none
        for k in range(1, SHORTEST):
            best[k:] &= rank[k:] < rank[:-k]
            best[:-k] &= rank[:-k] <= rank[k:]
        at = np.flatnonzero(best)
        if len(at) == 0:
            break
        taken[at] = True
        for k in range(1 - SHORTEST, SHORTEST):
            rank[at + k] = none
    # What a few rounds leave, such as long runs of one word, one by one in the same order.
    left = np.flatnonzero(rank < none)
    for i in left[np.argsort(rank[left], kind="stable")].tolist():
        if rank[i] < none:
            taken[i] = True
            rank[i - SHORTEST + 1 : i + SHORTEST] = none
    return np.flatnonzero(taken)


def _cut_words(texts: Iterable[str | None], cache: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each text: the words that start its sentences, the sentences' hashes, its number of words. Of the texts, one is held
    as words at a time, and as hashes of words no more than about ``AT_ONCE`` and one text."""
    left = iter(texts)
    while True:
        some, size = [], 0
        for text in left:
            some.append(cache.of(words(text)))
            size += len(some[-1])
            if size >= AT_ONCE:
                break
        if not some:
            return
        lengths = np.array([len(hs) for hs in some], np.int64)
        if size:
            hashes = np.concatenate(some)
            starts = _starts(hashes, lengths[lengths > 0])
            place = np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size)))
            own = mixed(np.add.reduceat(mixed(hashes * _PLACE[place]), starts))
        else:
            starts, own = np.empty(0, np.int64), np.empty(0, np.uint64)
        ends = np.cumsum(lengths)
        lows, highs = np.searchsorted(starts, ends - lengths), np.searchsorted(starts, ends)
        for low, high, first, n in zip(lows.tolist(), highs.tolist(), (ends - lengths).tolist(), lengths.tolist()):
            yield starts[low:high] - first, own[low:high], n


def _places(text: str, starts: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in the text of the sentences that start at these words."""
    pattern = _WORD_OR_LETTER if not text.isascii() and _UNSPACED.search(text) else _WORD
    at = [m.start() for m in pattern.finditer(text)]
    edges = [0, *[at[k] for k in starts[1:].tolist()], len(text)]
    return list(zip(edges[:-1], edges[1:]))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence with what stands after it up to the next one's first word; together they are the text.

    Sentences here are runs of ``SHORTEST`` to ``2 * SHORTEST - 1`` words, cut where the words themselves say, without case
    and punctuation, so equal words get equal cuts but near the ends of what is equal. A text of fewer words is one.
    """
    if not text:
        return []
    ((starts, _, _),) = _cut_words([text], WordHashes())
    return _places(text, starts)


def _spans(own: np.ndarray, starts: np.ndarray, size: int, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's spans that count and the sentences where they begin."""
    if len(own) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.append(starts, size)
    long = np.flatnonzero(total[n:] - total[:-n] >= least)
    return rolling(own, n)[long], long


def _told_apart(documents: DataFrame) -> list[Column]:
    """What tells rows apart: none (whether there is no id), k (the id, or for rows without one a hash of the text) and t (that
    hash). Rows without an id come after all with one."""
    none, t = F.col("doc_id").isNull(), F.xxhash64("text")
    return [none.alias("none"), F.when(none, t).otherwise(F.col("doc_id").cast("long")).alias("k"), t.alias("t")]


def span_hashes(documents: DataFrame, n: int = SENTENCES, least: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of ``documents``: none, k and t (see ``_told_apart``), n_sentences, own (whether a span repeats
    within it) and its different spans, as hashes of 64 bits (h) with 32 more (g) beside them."""

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, columns = WordHashes(), ["none", "k", "t", "n_sentences", "own", "h", "g"]
        for batch in batches:
            rows, held = [], 0
            for none, k, t, text, (starts, own, size) in zip(batch["none"], batch["k"], batch["t"], batch["text"], _cut_words(batch["text"], cache)):
                all_spans = _spans(own, starts, size, n, least)[0]
                once = np.unique(all_spans)
                rows.append((none, k, t, max(len(starts), int(bool(text))), len(once) < len(all_spans), signed(once), _more(own, once, n)))
                held += len(once)
                if held >= AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    rows = documents.select(*_told_apart(documents), "text")
    return rows.mapInPandas(spans, "none boolean, k long, t long, n_sentences int, own boolean, h array<long>, g array<int>")


def _more(own: np.ndarray, spans: np.ndarray, n: int) -> np.ndarray:
    """32 bits from another hash of the sentences of each of ``spans``, which are sorted and different."""
    if not len(spans):
        return np.empty(0, np.int32)
    h = rolling(own, n)
    order = np.argsort(h, kind="stable")
    first = order[np.searchsorted(h[order], spans)]
    return (rolling(mixed(own + np.uint64(0x632BE59BD9B4E019)), n)[first] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def repeated_spans(hashes: DataFrame) -> DataFrame:
    """none, k and the hashes of the spans of each document whose first holder is another: the one with the lowest doc_id, or
    without any id the lowest hash. Which spans are of several rows is counted, which needs no highest id beside
    the lowest; rows that only share a span with rows of their own id drop out when ids are compared."""
    spans = hashes.select("none", "k", F.explode(F.arrays_zip("h", "g")).alias("s")).select("none", "k", "s.h", "s.g")
    given, rest = F.when(~F.col("none"), F.col("k")), F.when(F.col("none"), F.col("k"))
    held = spans.groupBy("h", "g").agg(F.min(given).alias("first"), F.min(rest).alias("first_rest"), F.count("*").alias("n"))
    # Cut, so that the rows of a hot span meet a plain table and can be split.
    several = cut(held.where("n > 1").drop("n"))
    again = spans.join(several, ["h", "g"])
    again = again.where(F.when(F.col("none"), F.col("first").isNotNull() | (F.col("k") > F.col("first_rest"))).otherwise(F.col("k") > F.col("first")))
    found = cut(again.groupBy("none", "k").agg(F.collect_set("h").alias("spans")))
    drop(several)
    return found


def _removal(n: int, least: int):
    @F.pandas_udf("text string, n_removed int, removed array<array<int>>")
    def remove(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, of, (starts, own, size) in zip(texts, spans, _cut_words(texts, WordHashes())):
            if text is None:
                rows.append((None, 0, []))
                continue
            h, at = _spans(own, starts, size, n, least)
            again = pd.Series(h).duplicated().to_numpy(bool)  # also within the document
            if of is not None and len(of):
                again |= np.isin(h, np.asarray(of, np.int64).view(np.uint64))
            cut = _places(text, starts)
            gone = np.zeros(len(cut) + 1, np.int64)
            for k in at[again]:
                gone[k : k + n] = 1
            kept = "".join(text[a:b] for (a, b), g in zip(cut, gone) if not g)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
            removed = [[cut[a][0], cut[b - 1][1]] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
            rows.append((kept.rstrip() if removed else text, int(gone.sum()), removed))
        return pd.DataFrame(rows, columns=["text", "n_removed", "removed"])

    return remove


def deduplicated(documents: DataFrame, n: int = SENTENCES, least: int = LEAST_WORDS) -> DataFrame:
    """The documents with ``text`` less every sentence that a non-first occurrence of a span covers.

    A span is ``n`` sentences in a row of at least ``least`` words; spans are alike if their words are, case and punctuation
    apart. Its first occurrence is the first in the document with the lowest doc_id; rows that share a doc_id count as one
    document. Rows without an id come after all others and are told apart by their texts. All others lose the sentences. Adds
    n_sentences, n_removed and removed (start and end of each removed stretch, in code points of the old text), in place of
    columns of those names; other columns are kept, whatever they are called. Null texts stay null, texts without a repeat
    stay as they are, and an empty table gives no rows. Needs columns doc_id and text.

    Spans are hashed once and written; they are counted with map-side combining, and a span that many documents share is one
    row there and joins back by its hash, where a hot one is split. What each row loses is written too, and the hashes are
    deleted before any text is sent. Only texts that lose something are cut again.
    """
    hashes = cut(span_hashes(documents, n, least))
    found = repeated_spans(hashes)
    told = cut(hashes.select("none", "k", "t", "n_sentences", "own").distinct().join(found, ["none", "k"], "left"))
    drop(hashes, found)
    none, k, t, count, own, gone, made, hit = (unused(documents, x) for x in ("none", "k", "t", "count", "own", "gone", "made", "hit"))
    told = told.toDF(none, k, t, count, own, gone)
    keys = [c.alias(x) for c, x in zip(_told_apart(documents), (none, k, t))]
    rows = documents.select("*", *keys).join(told, [none, k, t], "left")
    # Texts that lose nothing are neither sent to Python nor cut again.
    rows = rows.withColumn(hit, F.col("text").isNotNull() & (F.col(own) | F.col(gone).isNotNull()))
    rows = rows.withColumn(made, _removal(n, least)(F.when(F.col(hit), F.col("text")), F.col(gone)))
    text = F.when(F.col(hit), F.col(made)["text"]).otherwise(F.col("text")).alias("text")
    kept = [text if c == "text" else F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("n_sentences", "n_removed", "removed")]
    return rows.select(*kept, F.col(count).alias("n_sentences"), F.col(made)["n_removed"].alias("n_removed"), F.col(made)["removed"].alias("removed"))
