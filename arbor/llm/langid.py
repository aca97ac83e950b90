"""Language identification by segmentation-marginalised unigrams.

For each language every piece of a fixed public vocabulary has a probability. A word's probability is the sum over all its
segmentations into pieces of the product of their probabilities, by the forward algorithm; a text's is the product over its
words. The piece probabilities are fitted by expectation maximisation with the forward-backward algorithm.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import cut, held_out, unused

#: Documents of a language that are learned from, at most about so many, chosen by a hash of doc_id.
SAMPLE = 400
ROUNDS = 3
#: Sums are brought back to a double's range every so many letters, and so many cells of a table are worked on at once.
RESCALE, CELLS = 8, 2_000_000
#: The probability of a character that no piece holds, and the count that smooths every piece.
UNKNOWN = 1e-7
SMOOTHING = 0.02
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
_pieces: dict[str, dict[str, int]] = {}


def vocabulary(model: str = "piece_bpe_32k.model") -> dict[str, int]:
    """The lower-case pieces of a public vocabulary, with the mark of a word's beginning as a space, and their numbers."""
    if model not in _pieces:
        import public_tokenizers as public
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public.path(model))
        plain = [p for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)) for p in [sp.id_to_piece(k)]]
        fit = sorted({p.replace("▁", " ").lower() for p in plain if re.fullmatch(r"▁?[^\W\d_]*", p) and p != ""})
        _pieces[model] = {p: k for k, p in enumerate(fit)}
    return _pieces[model]


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case, each whole and after a space."""
    if not text:
        return []
    out = []
    for w in _LETTERS.findall(text.lower()):
        if not w.isalpha():  # superscripts and the like
            w = "".join(c for c in w if c.isalpha())
        if w:
            out.append(" " + w)
    return out


def forward(word: str, pieces: dict[str, int], p: np.ndarray | list, longest: int) -> list:
    """The summed probability of all segmentations of each prefix of ``word``; ``p`` gives a piece's probability."""
    return [math.exp(x) for x in forward_logs(word, pieces, p, longest)]


def forward_logs(word: str, pieces: dict[str, int], p: np.ndarray | list, longest: int) -> list[float]:
    """Logarithms of ``forward``. Each sum is taken relative to the one before, so words may have any length."""
    logs = [0.0]
    for j in range(1, len(word) + 1):
        before, total = logs[j - 1], UNKNOWN
        for i in range(max(0, j - longest), j):
            k = pieces.get(word[i:j])
            if k is not None and p[k]:
                total += math.exp(logs[i] - before) * p[k]
        logs.append(before + math.log(total))
    return logs


def expected_counts(word: str, times: float, pieces: dict[str, int], p: list, longest: int, out: dict) -> None:
    """Adds how often each piece is expected in ``times`` occurrences of ``word``: its share of all segmentations."""
    n = len(word)
    ahead = forward_logs(word, pieces, p, longest)
    back = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        after, total = back[i + 1], UNKNOWN
        for j in range(i + 1, min(n, i + longest) + 1):
            k = pieces.get(word[i:j])
            if k is not None and p[k]:
                total += p[k] * math.exp(back[j] - after)
                out[k] += times * p[k] * math.exp(ahead[i] + back[j] - ahead[n])
        back[i] = after + math.log(total)


def log_probabilities(words: list[str], pieces: dict[str, int], p: np.ndarray, longest: int) -> np.ndarray:
    """A row for each word: the logarithm of ``forward`` at its end for each column of ``p``, by words of equal length."""
    out = np.zeros((len(words), p.shape[1]))
    padded = np.vstack([p, np.zeros((1, p.shape[1]))])
    by_length: dict[int, list[int]] = defaultdict(list)
    for at, word in enumerate(words):
        by_length[len(word)].append(at)
    for size, group in by_length.items():
        step = max(1, CELLS // ((size + 1) * longest))
        for k in range(0, len(group), step):
            own = group[k : k + step]
            out[own] = _log_forward([words[at] for at in own], size, pieces, padded, longest)
    return out


def _log_forward(words: list[str], size: int, pieces: dict[str, int], p: np.ndarray, longest: int) -> np.ndarray:
    """The forward sums of words of ``size`` letters; the last row of ``p`` stands for what is no piece."""
    row, end, length, found = [], [], [], []
    for at, word in enumerate(words):
        for j in range(1, size + 1):
            for i in range(max(0, j - longest), j):
                k = pieces.get(word[i:j])
                if k is not None:
                    row.append(at)
                    end.append(j)
                    length.append(j - i - 1)
                    found.append(k)
    piece = np.full((len(words), size + 1, longest), len(p) - 1, np.int32)
    piece[row, end, length] = found
    alpha = np.zeros((len(words), size + 1, p.shape[1]))
    alpha[:, 0] = 1.0
    scale = np.zeros((len(words), p.shape[1]))
    for j in range(1, size + 1):
        n = min(j, longest)
        # Pieces of 1, 2, ... letters begin after the sums of as many letters before.
        alpha[:, j] = alpha[:, j - 1] * UNKNOWN + np.einsum("wln,wln->wn", p[piece[:, j, :n]], alpha[:, j - n : j][:, ::-1])
        if j % RESCALE == 0:
            low = max(0, j - longest + 1)
            by = alpha[:, j].copy()
            scale += np.log(by)
            alpha[:, low : j + 1] /= by[:, None, :]
    return scale + np.log(alpha[:, size])


class Model:
    """Piece probabilities by language: ``p`` has a row for each piece and a column for each of the sorted ``langs``."""

    def __init__(self, langs: list[str], p: np.ndarray, model: str):
        self.langs, self.p, self.model = langs, p, model

    def scorer(self):
        """A function from texts to (language, probability among the languages) for each."""
        pieces = vocabulary(self.model)
        longest = max(map(len, pieces))
        langs, n = self.langs, max(1, len(self.langs))
        most = max(1000, CELLS // n)
        seen: dict[str, int] = {}
        log = np.zeros((most, n))

        def look_up(ws: list[str]) -> np.ndarray:
            """Rows of ``log`` for at most ``most`` words."""
            new = list(dict.fromkeys(w for w in ws if w not in seen))
            if len(seen) + len(new) > most:
                seen.clear()
                new = list(dict.fromkeys(ws))
            if new:
                first = len(seen)
                log[first : first + len(new)] = log_probabilities(new, pieces, self.p, longest)
                seen.update(zip(new, range(first, first + len(new))))
            return np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            lists = [words_of(t) if langs else [] for t in texts]
            total = np.zeros((len(lists), n))
            some: list[str] = []
            of: list[np.ndarray] = []

            def add() -> None:
                rows, owner = log[look_up(some)], np.concatenate(of)
                for c in range(n):
                    total[:, c] += np.bincount(owner, rows[:, c], len(lists))
                some.clear()
                of.clear()

            for at, ws in enumerate(lists):
                start = 0
                while start < len(ws):  # as many words at a time as are remembered
                    part = ws[start : start + most - len(some)]
                    some += part
                    of.append(np.full(len(part), at))
                    start += len(part)
                    if len(some) == most:
                        add()
            if some:
                add()
            out = []
            for ws, sums in zip(lists, total):
                best = int(sums.argmax())
                out.append((langs[best], float(1 / np.exp(sums - sums[best]).sum())) if ws else (UNDETERMINED, 0.0))
            return out

        return score


def train(documents: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, model: str = "piece_bpe_32k.model") -> Model:
    """Learns from text and lang of at most about ``sample`` documents a language, none of them held out.

    Their words are counted by Spark; each round's expected piece counts are summed there too, so the driver gets a row for
    each language and piece at most, whatever the texts' lengths. Languages are few enough for a list on the driver.
    """
    usable = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").alias("lang"))
    n_docs = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n_docs)
    pieces = vocabulary(model)
    if not langs:
        return Model([], np.zeros((len(pieces), 0)), model)
    rate = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int((1 << 20) * min(1.0, sample / n_docs[lang]))))])
    chosen = usable.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang")), F.lit(1 << 20)) < F.element_at(rate, F.col("lang")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch["lang"], batch["text"]):
                own[lang].update(words_of(text))
            yield pd.DataFrame([(lang, w, n) for lang, c in own.items() for w, n in c.items()], columns=["lang", "word", "n"])

    counted = cut(chosen.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    v = len(pieces)
    p = np.full((v, len(langs)), 1 / v)
    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], p: np.ndarray = p) -> Iterator[pd.DataFrame]:
            own = vocabulary(model)
            longest, columns = max(map(len, own)), [p[:, c].tolist() for c in range(len(langs))]
            place = {lang: c for c, lang in enumerate(langs)}
            sums: list[dict] = [defaultdict(float) for _ in langs]
            for batch in batches:
                for lang, word, n in zip(batch["lang"], batch["word"], batch["n"]):
                    c = place[lang]
                    expected_counts(word, float(n), own, columns[c], longest, sums[c])
            yield pd.DataFrame([(c, k, x) for c, s in enumerate(sums) for k, x in s.items()], columns=["c", "k", "x"])

        summed = counted.mapInPandas(expect, "c int, k int, x double").groupBy("c", "k").agg(F.sum("x").alias("x"))
        counts = np.full((v, len(langs)), SMOOTHING)
        for r in summed.toLocalIterator():
            counts[r["k"], r["c"]] += r["x"]
        p = counts / counts.sum(axis=0)
    return Model(langs, p, model)


def predicted(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with lang_pred and score, in place of columns of those names; other columns stay, whatever they are called.

    A null or empty text, or one without a letter, is ``und`` with a score of 0, as is every text where nothing was learned.
    Repeated rows are predicted each for itself, texts of any length whole, and an empty table gives no rows.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for batch in texts:
            yield pd.DataFrame(score(batch.tolist()), columns=["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("lang_pred", "score")]
    made = unused(documents, "made")
    return documents.select(*kept, predict("text").alias(made)).select(*kept, F.col(made)["lang_pred"].alias("lang_pred"), F.col(made)["score"].alias("score"))
