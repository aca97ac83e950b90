"""Quality classifier: a sparse ensemble of rules.

Small trees are boosted on statistics of labelled texts; every path in them is a rule, a conjunction of thresholds. A
lasso-penalised logistic regression gives most rules a weight of zero; the rest become one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import held_out, unused

#: Labelled rows that are learned from, at most about so many, chosen by a hash of doc_id.
SAMPLE = 20_000
TREES = 60
DEPTH = 3
BINS = 48
SHRINK = 0.15
#: The lasso's penalty per row, as a share of the least that makes all weights zero.
PENALTY = 0.01
#: From this score on a document is kept.
THRESHOLD = 0.3

Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text. They are shares of its characters, words or lines, and its size; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    n_chars = F.greatest(chars, F.lit(1)).cast("double")
    all_words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_words = F.greatest(F.size(all_words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    return {
        "chars": F.log1p(chars.cast("double")),
        "words": F.log1p(F.size(all_words).cast("double")),
        "word_length": n_chars / n_words,
        "upper": count(r"\p{Lu}") / n_chars,
        "capitalised": count(r"(?<!\S)\p{Lu}") / n_words,
        "digits": count(r"\p{Nd}") / n_chars,
        "marks": count(r"[^\p{L}\p{Nd}\s.,]") / n_chars,
        "symbols": count(r"[#$%&*|<>=~^_@\\{}\[\]]+") / n_words,
        "bangs": count(r"[!?]+") / n_words,
        "stops": count(r"[.!?](?=\s|$)") / n_words,
        "commas": count(",") / n_words,
        "distinct_words": F.size(F.array_distinct(all_words)) / n_words,
        "lines": F.log1p(F.size(lines).cast("double")),
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_length": F.log1p(n_chars / n_lines),
        "ends": F.when(text.rlike(r"[.!?]\s*$"), 1.0).otherwise(0.0),
        "words_again": (count(r"(?U)(?<!\S)(\S+)\s+\1(?!\S)")) / n_words,
    }


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules over statistics; a rule is a tuple of (statistic, whether above, threshold)."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, columns: dict[str, Column]) -> Column:
        """The probability of label 1, as one expression over the columns of statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, at in rule:
                holds = holds & ((columns[name] > at) if above else (columns[name] <= at))
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree by histograms: (value for each row, paths to all its nodes as lists of (feature, above, bin))."""
    n, m = binned.shape
    value, paths = np.zeros(n), []

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        if path:
            paths.append(path)
        best = (1e-3, -1, -1)
        if left and len(rows) >= 20:
            for j in range(m):
                k = len(edges[j]) + 1
                gs = np.cumsum(np.bincount(binned[rows, j], grad[rows], k))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, j], hess[rows], k))[:-1]
                if not len(gs):
                    continue
                gain = np.where((hs > 1) & (h - hs > 1), gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at)
        _, j, at = best
        if j < 0:
            value[rows] = g / (h + 1)
            return
        above = binned[rows, j] > at
        grow(rows[~above], (*path, (j, False, at)), left - 1)
        grow(rows[above], (*path, (j, True, at)), left - 1)

    grow(np.arange(n), (), depth)
    return value, paths


def extracted_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """All paths in the boosted trees as rules, each once, with a statistic's bounds merged."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        value, paths = _tree(binned, edges, y - p, p * (1 - p), depth)
        margin += SHRINK * value
        for path in paths:
            bounds: dict[tuple[int, bool], float] = {}
            for j, above, at in path:
                cut = float(edges[j][at])
                old = bounds.get((j, above))
                bounds[(j, above)] = cut if old is None else (max if above else min)(old, cut)
            found[tuple((names[j], above, cut) for (j, above), cut in sorted(bounds.items()))] = None
    return list(found)


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, at in rule:
        v = x[:, names.index(name)]
        out &= (v > at) if above else (v <= at)
    return out


def lasso_weights(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an absolute penalty, by accelerated proximal gradients."""
    n, m = z.shape
    mean, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-3)
    s = (z - mean) / scale
    rate = float(y.mean())
    lam = penalty * np.abs(s.T @ (y - rate)).max() / n
    v = np.ones(m) / np.sqrt(m)
    for _ in range(20):
        v = s.T @ (s @ v)
        v /= np.linalg.norm(v)
    step = 4 / (np.linalg.norm(s @ v) ** 2 / n + 1)
    b, w = np.log((rate + 1e-6) / (1 - rate + 1e-6)), np.zeros(m)
    pb, pw, t = b, w, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(pb + s @ pw))) - y
        nb = pb - step * r.mean()
        nw = pw - step * (s.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * lam, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pb, pw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    weights = w / scale
    return float(b - weights @ mean), weights


def fitted(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    """The rule ensemble for statistics ``x`` and labels ``y`` of 0 and 1. With a single kind of label, or none, there are
    no rules, and the score is the labels' mean with one row of each kind added."""
    if len(y) < 2 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(rate / (1 - rate))), ())
    rules = extracted_rules(x, y, names)
    z = np.stack([_holds(r, x, names) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 1), np.float32)
    intercept, weights = lasso_weights(z, y)
    return RuleEnsemble(intercept, tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Learns from at most about ``sample`` labelled documents that are not held out.

    Labels are thinned by a hash of doc_id before they meet the texts, so what is joined and what reaches the driver (one
    row of statistics for each) is bounded by ``sample``. Of repeated or contradicting labels of a document the greatest
    holds; null labels are passed over. Of rows of ``documents`` that share a doc_id each counts. The hash range is set by the
    count of labels. Without a usable label the ensemble has no rules.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = usable.count()
    chosen = usable.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1))))
    texts = documents.select(F.col("doc_id").alias("_id"), "text")
    rows = texts.join(F.broadcast(chosen), texts["_id"] == chosen["doc_id"])
    stats = statistics(F.col("text"))
    names = list(stats)
    got = rows.select(F.col("_id"), F.col("quality").cast("double").alias("_y"), *[c.alias(k) for k, c in stats.items()]).toPandas()
    got = got.sort_values(["_id", *names])
    return fitted(got[names].to_numpy(float), (got["_y"].to_numpy(float) > 0).astype(float), names)


def scored(documents: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with score and predicted, in place of columns of those names; other columns stay, whatever they are called.

    Null texts are scored as empty ones, texts of any length whole, repeated rows each for itself. An empty table gives no
    rows.
    """
    used = {name for rule, _ in model.rules for name, _, _ in rule}
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("score", "predicted")]
    stats = {k: c for k, c in statistics(documents["text"]).items() if k in used}
    made = unused(documents, "stats")
    wide = documents.select(*kept, F.struct(*[c.alias(k) for k, c in stats.items()], F.lit(0).alias("_")).alias(made))
    wide = wide.select(*kept, model.score({k: F.col(made)[k] for k in stats}).alias("score"))
    return wide.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
