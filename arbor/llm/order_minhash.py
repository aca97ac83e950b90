"""Near-duplicates by Order MinHash over word shingles, verified by banded alignment.

A sketch of a document is the sequence, in text order, of the few occurrence-labelled shingles with the least hashes; two
documents have equal sketches only if they share those shingles in the same order, which makes it a hash for edit
similarity. Documents with an equal sketch meet in a bucket; there their sequences of shingles are aligned in a band as wide
as the threshold leaves room for.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.llm.common import WordHashes, cut, drop, mixed, rolling, seeds, signed, unused, words
from arbor.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: (shingles from which it holds, shingles in a sketch, sketches). At a similarity of 0.8 a pair meets in one of the
#: sketches with a probability of over 0.999.
LEVELS = ((0, 2, 10), (16, 4, 18))
#: Members of a bucket are compared with so many leaders, one after the other, before what is left is compared exactly.
LEADERS = 2
#: Members of a bucket that are still of several classes are compared pair by pair where they are so few, else in blocks.
PAIRS_UP_TO = 24
#: A block is of documents with this many characters together, each counted as ``LIGHTEST`` at least.
BLOCK, LIGHTEST = 1 << 19, 1 << 12


def labelled_shingles(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``n`` words and of how often it came before; of all words if they are fewer."""
    if len(hashes) == 0:
        return hashes
    own = rolling(hashes, min(n, len(hashes)))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return own
    at = np.arange(len(own))
    seen = np.empty(len(own), np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(seen == 0, own, mixed(own + seen * np.uint64(0x9E3779B97F4A7C15)))


def _levels(n: int, similarity: float) -> list[int]:
    """The level of ``n`` shingles and that of the fewest that a similar document can have."""
    level = lambda x: max(k for k, row in enumerate(LEVELS) if x >= row[0])
    return sorted({level(n), level(int(np.ceil(similarity * n - 1e-9)))})


def sketches(shingles: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The Order MinHash sketches of a document, each as one hash that also says which sketch it is."""
    out = []
    for level in _levels(len(shingles), similarity):
        _, size, times = LEVELS[level]
        size = min(size, len(shingles))
        factors = seeds(times, 1000 * (level + 1))
        drawn = np.multiply.outer(factors, shingles)
        at = np.argpartition(drawn, size - 1, axis=1)[:, :size] if size < len(shingles) else np.tile(np.arange(size), (times, 1))
        kept = shingles[np.sort(at, axis=1)]
        sketch = factors
        for k in range(size):
            sketch = sketch * np.uint64(0x9E3779B97F4A7C15) + kept[:, k]
        out.append(sketch)
    return mixed(np.concatenate(out))


def signatures(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, the 128 bits of its words (h1, h2) and its sketches, for each document that has an id and a word."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        cache = WordHashes()
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                ws = words(text)
                if ws:
                    whole = xxhash.xxh3_128_digest(b" ".join(ws))
                    h1, h2 = np.frombuffer(whole, np.int64).tolist()
                    rows.append((i, h1, h2, signed(sketches(labelled_shingles(cache.of(ws), shingle), similarity))))
            yield pd.DataFrame(rows, columns=["doc_id", "h1", "h2", "sketches"])

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(sign, "doc_id long, h1 long, h2 long, sketches array<long>")


def alignment(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """The share of two documents' labelled shingles that an alignment keeps: kept / (kept by either). 0 if under ``least``.

    A labelled shingle stands once in a document, so an alignment of the two sequences with the fewest insertions and
    deletions is a longest increasing run of the places in ``b`` of ``a``'s shingles. Places further apart than the
    insertions and deletions that ``least`` leaves room for are outside the band. Memory is linear in the documents and time
    nearly so, whatever their lengths.
    """
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb) - 1e-9:
        return 0.0
    kept = int(np.ceil(least / (1 + least) * (na + nb) - 1e-9))
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= na + nb - 2 * kept
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < kept:
        return 0.0
    places = at_b[np.argsort(at_a)]
    if (places[1:] > places[:-1]).all():
        whole = len(places)
    else:
        ends: list[int] = []
        for p in places.tolist():
            k = bisect_left(ends, p)
            ends[k : k + 1] = [p]
        whole = len(ends)
    found = whole / (na + nb - whole)
    return found if found >= least - 1e-9 else 0.0


def similarity_of(a: list, b: list, shingle: int = SHINGLE, least: float = SIMILARITY) -> float:
    """``alignment`` of two documents given as words. Equal ones are alike, others with less than ``shingle`` words aren't."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) < shingle:
        return 0.0
    number: dict = {}
    one, two = (mixed(np.array([number.setdefault(w, len(number) + 1) for w in ws], np.uint64)) for ws in (a, b))
    return alignment(labelled_shingles(one, shingle), labelled_shingles(two, shingle), least)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of documents that are similar."""

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similarity_of(words(x), words(y), shingle, similarity) > 0 for x, y in zip(left, right)], dtype=bool)

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").where(similar("text_a", "text_b")).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame | None, node: str, out: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(out, F.col(node))
    own = labels.select(F.col("node").alias(node), F.col("label").alias(out))
    return rows.join(own, node, "left").withColumn(out, F.coalesce(out, node))


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels once ``edges`` hold too: components of the labels that they link."""
    linked = _labelled(_labelled(edges, labels, "a", "la"), labels, "b", "lb")
    over = components(linked.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    if labels is None:
        return over
    moved = over.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(old.unionByName(over.join(labels, "node", "left_anti")))


def _apart(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """key, node and label l of the members of buckets that are of several classes."""
    rows = _labelled(members.select("key", "node"), labels, "node", "l")
    several = rows.groupBy("key").agg(F.min("l").alias("low"), F.max("l").alias("high"), F.count("*").alias("n")).where("low < high")
    return cut(rows.join(cut(several.select("key", "n")), "key"))


def _blocks(rows: DataFrame, weight: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``block``: numbers of runs, in ``order``, of about ``BLOCK`` together by ``weight``."""
    given = rows.withColumn("weight", weight).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(given.withColumn("at", F.monotonically_increasing_id()))
    # The part is in the upper bits of ``at``; sums within it run in its order.
    part = F.shiftright("at", 33)
    upto = F.sum("weight").over(Window.partitionBy(part).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    inside = placed.withColumns({"part": part, "upto": F.coalesce(upto, F.lit(0))})
    # One row for each part: what all parts before it weigh.
    parts = placed.groupBy(part.alias("part")).agg(F.sum("weight").alias("w"))
    before = cut(parts.select("part", F.coalesce(F.sum("w").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    return inside.join(before, "part").withColumn("block", F.floor((F.col("before") + F.col("upto")) / BLOCK)).drop("part", "upto", "before", "weight", "at")


def _rest(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between ``nodes`` of different classes l, enough to connect all that are similar, in an exact way.

    A prefix-filtered join of blocks: two similar documents share all but few of their shingles, so in any common order of
    shingles they share one of the first of each. The order is by how many of these documents hold a shingle; those that only
    one class holds come first and join nothing. Documents stand in blocks beside others of their class and of a like least
    shingle; two blocks meet if a shingle is among the first of both, for documents of different classes, and are compared
    whole: the numbers of shingles in common are a product of matrices, and only what they leave is aligned. Shingles
    are counted in arrays, once for each block that holds them, pairs of documents are never rows, and a text travels once for
    each block that its own meets.
    """

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in batches:
            rows = []
            for node, label, text in zip(batch["node"], batch["l"], batch["text"]):
                own = labelled_shingles(cache.of(words(text)), shingle)
                if len(own):
                    rows.append((node, label, signed(own.min(keepdims=True))[0], len(text)))
            yield pd.DataFrame(rows, columns=["node", "l", "least", "chars"])

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        cache = WordHashes()
        each = [(np.unique(labelled_shingles(cache.of(words(t)), shingle)), label) for t, label in zip(rows["text"], rows["l"])]
        found = pd.DataFrame({"h": signed(np.concatenate([h for h, _ in each])), "l": np.repeat([label for _, label in each], [len(h) for h, _ in each])})
        found = found.groupby("h")["l"].agg(["count", "min", "max"]).reset_index()
        found["part"] = found["h"] % parts
        own = [(part, rows["block"].iloc[0], *[g[c].tolist() for c in ("h", "count", "min", "max")]) for part, g in found.groupby("part")]
        return pd.DataFrame(own, columns=["part", "block", "h", "n", "low", "high"])

    def frequencies(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["h"].map(len).to_numpy()
        flat = pd.DataFrame({c: np.concatenate(rows[c].tolist()) for c in ("h", "n", "low", "high")}).assign(block=np.repeat(rows["block"].to_numpy(), sizes))
        over = flat.groupby("h").agg(f=("n", "sum"), low=("low", "min"), high=("high", "max"))
        over = over[over["low"] < over["high"]]["f"]
        flat = flat[flat["h"].isin(over.index)]
        flat = flat.assign(f=over.loc[flat["h"]].to_numpy()) if len(flat) else flat.assign(f=0)
        return pd.DataFrame([(block, g["h"].tolist(), g["f"].tolist()) for block, g in flat.groupby("block")], columns=["block", "h", "f"])

    def firsts(rows: pd.DataFrame, frequency: pd.DataFrame) -> pd.DataFrame:
        cache = WordHashes()
        known, f = (np.array([x for xs in frequency[c] for x in xs], np.int64) for c in ("h", "f"))
        known, f = known[np.argsort(known)], f[np.argsort(known)]
        out = []
        for text, label in zip(rows["text"], rows["l"]):
            own = np.unique(labelled_shingles(cache.of(words(text)), shingle))
            some = np.intersect1d(signed(own), known, assume_unique=True)
            # Those that aren't known come first, so the others have what they leave of the prefix.
            n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 - (len(own) - len(some))
            if n > 0:
                some = some[np.lexsort((some, f[np.searchsorted(known, some)]))][:n]
                out.append(pd.DataFrame({"h": some, "l": label}))
        if not out:
            return pd.DataFrame(columns=["h", "block", "low", "high"], dtype="int64")
        found = pd.concat(out).groupby("h")["l"].agg(["min", "max"]).reset_index()
        return found.set_axis(["h", "low", "high"], axis=1).assign(block=rows["block"].iloc[0])[["h", "block", "low", "high"]]

    held = cut(texts.join(nodes, "node").select("node", "l", "text").mapInPandas(marked, "node long, l long, least long, chars long"))
    classes = cut(held.groupBy("l").agg(F.min("least").alias("place")))
    placed = _blocks(held.join(classes, "l"), F.greatest("chars", F.lit(LIGHTEST)).cast("long"), ["place", "l", "least", "node"])
    placed = cut(placed.select("node", "l", "block").distinct())
    inside = placed.join(texts, "node").select("block", "l", "text")
    # A block's shingles are dealt in parts of their hashes, about a million in each part over all blocks.
    parts = 1 + max(64, (placed.join(held, ["node", "l"]).agg(F.sum("chars")).first()[0] or 0) // 4_000_000)
    counts = cut(inside.groupBy("block").applyInPandas(counted, "part long, block long, h array<long>, n array<long>, low array<long>, high array<long>"))
    frequency = counts.groupBy("part").applyInPandas(frequencies, "block long, h array<long>, f array<long>")
    at = inside.groupBy("block").cogroup(frequency.groupBy("block")).applyInPandas(firsts, "h long, block long, low long, high long")
    at = cut(at)
    several = at.groupBy("h").agg(F.min("low").alias("l0"), F.max("high").alias("l1")).where("l0 < l1").select("h")
    at = cut(at.join(cut(several), "h"))
    one, two = (at.select("h", F.col("block").alias(x), F.struct("low", "high").alias(f"of_{x}")) for x in ("i", "j"))
    # Two blocks of the same single class have nothing to compare.
    alike = (F.col("of_i") == F.col("of_j")) & (F.col("of_i")["low"] == F.col("of_i")["high"])
    met = cut(one.join(two, "h").where("i <= j").where(~alike).select("i", "j").distinct())
    sides = met.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    brought = sides.join(placed.select("block", "node", "l"), "block").join(texts, "node").select("i", "j", "block", "node", "l", "text")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_links(rows, shingle, similarity), columns=["a", "b"], dtype="int64")

    return brought.groupBy("i", "j").applyInPandas(compare, "a long, b long")


def _links(rows: pd.DataFrame, shingle: int, similarity: float) -> list[tuple[int, int]]:
    """Links between the documents of two blocks (columns i, j, block, node, l, text), or within one."""
    rows = rows.sort_values("node", kind="stable")
    cache = WordHashes()
    own = [labelled_shingles(cache.of(words(t)), shingle) for t in rows["text"]]
    nodes, sizes = rows["node"].tolist(), np.array([len(x) for x in own])
    left, right = np.flatnonzero(rows["block"] == rows["i"]), np.flatnonzero(rows["block"] == rows["j"])
    common = _common([own[k] for k in left], [own[k] for k in right])
    need = np.maximum(1, np.ceil(similarity / (1 + similarity) * (sizes[left][:, None] + sizes[right][None, :]) - 1e-9))
    labels = rows["l"].to_numpy()
    open_ = (common >= need) & (labels[left][:, None] != labels[right][None, :])
    if len(left) == len(right) and (left == right).all():
        open_ = np.triu(open_, 1)
    x, y = np.nonzero(open_)
    up = {int(label): int(label) for label in labels}

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    # The closest first: what they link needn't be compared again.
    for k in np.argsort(-(common / need)[x, y], kind="stable").tolist():
        i, j = int(left[x[k]]), int(right[y[k]])
        a, b = root(int(labels[i])), root(int(labels[j]))
        if a != b and alignment(own[i], own[j], similarity):
            up[max(a, b)] = min(a, b)
            out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
    """How many shingles each of ``left`` has in common with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    values, counts = np.unique(np.concatenate([*left, *right]), return_counts=True)
    both = values[counts > 1]
    for k in range(0, len(both), at_once):
        some = both[k : k + at_once]
        a, b = (np.stack([np.isin(some, x, assume_unique=True) for x in side]).astype(np.float32) for side in (left, right))
        out += a @ b.T
    return out


def near_classes(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``documents``: doc_id and class_id, the lowest doc_id among its near-duplicates.

    Documents with the same words are copies; of each set of copies the lowest doc_id goes on. Documents that an alignment
    keeps a share of ``similarity`` of are linked; classes are what links connect. The members of a bucket are compared with
    its most central one, which shares most buckets with others and so is what copies were made from, if anything, then with
    the most central of those that stay apart, so n copies cost about n comparisons. Members of buckets that are still of
    several classes are then compared in full: pairs in small buckets, and in larger ones by an exact join of blocks, which
    leaves out only pairs that can't be similar.

    Rows that share a doc_id are one document. A row without an id or without a word is in no group: its class_id is its
    doc_id. An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    signed_rows = cut(signatures(documents, shingle, similarity))
    # Aggregates are cut before they are joined back, so that a hot key's rows meet a plain table and can be split.
    first = cut(signed_rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))
    copies = signed_rows.select("doc_id", "h1", "h2").join(first, ["h1", "h2"]).select("doc_id", "rep")
    entries = signed_rows.join(first.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"]).select(
        F.explode("sketches").alias("key"), F.col("doc_id").alias("node")
    ).distinct()
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "n")
    members = cut(entries.join(cut(shared), "key"))
    labels = None
    if not members.isEmpty():
        central = cut(members.groupBy("node").agg(F.sum("n").alias("c")))
        source = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("node"), "text")
        texts = cut(source.join(central.select("node"), "node", "left_semi").select("node", "text"))
        still, tested = members.select("key", "node"), None
        for _ in range(LEADERS):
            ranked = still.join(central, "node").groupBy("key").agg(F.min(F.struct((-F.col("c")).alias("c"), "node"))["node"].alias("lead"))
            led = cut(still.join(cut(ranked), "key").where("node != lead"))
            pairs = led.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
            pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
            tested = pairs if tested is None else cut(tested.unionByName(pairs))
            labels = _with_links(labels, _verified(pairs, texts, shingle, similarity))
            apart = _labelled(_labelled(led, labels, "node", "ln"), labels, "lead", "ll").where("ln != ll")
            still = cut(apart.select("key", "node"))
            if still.isEmpty():
                break
        apart = _apart(members, labels)
        few = apart.where(F.col("n") <= PAIRS_UP_TO).select("key", "node", "l")
        one, two = (few.select("key", F.col("node").alias(x), F.col("l").alias(f"l{x}")) for x in ("a", "b"))
        pairs = one.join(two, "key").where("a < b and la != lb").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        labels = _with_links(labels, _verified(cut(pairs), texts, shingle, similarity))
        drop(apart)
        many = _apart(members.where(F.col("n") > PAIRS_UP_TO), labels)
        nodes = cut(many.where(F.col("n") > PAIRS_UP_TO).select("node", "l").distinct())
        if not nodes.isEmpty():
            labels = _with_links(labels, _rest(nodes, texts, shingle, similarity))
        drop(members, texts, tested)
    # Copies share their representative's class; rows with the same doc_id join theirs.
    extra = copies.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    if not extra.isEmpty():
        labels = _merged(labels, copies.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
        copies = copies.select("doc_id", F.col("doc_id").alias("rep")).distinct()
    classes = _labelled(copies.groupBy("doc_id").agg(F.min("rep").alias("rep")), labels, "rep", "label")
    classes = classes.select(F.col("doc_id").alias("of"), F.col("label"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(classes, rows["doc_id"] == classes["of"], "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))


def _with_links(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels with these links, which are computed once."""
    links = cut(links)
    return labels if links.isEmpty() else _merged(labels, links)


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with their columns as they are, less those whose class has a lower doc_id. Rows that share the lowest
    doc_id of a class all stay, as do rows without an id."""
    gone = unused(documents, "gone")
    classes = near_classes(documents, shingle, similarity).where("doc_id != class_id").select(F.col("doc_id").alias(gone)).distinct()
    return documents.join(classes, documents["doc_id"] == F.col(gone), "left_anti")
