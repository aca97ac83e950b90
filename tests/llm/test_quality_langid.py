import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbor.llm import langid, quality
from arbor.llm.common import held_out


def labelled(n=700, seed=3):
    r = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        ws = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 120))]
        bad = r.random() < 0.25
        docs.append((k, " ".join(f"{w}!!" for w in ws).upper() if bad and k % 2 else " ".join([ws[0]] * len(ws)) if bad else " ".join(ws).capitalize() + "."))
        labels.append((k, 0 if bad else 1))
    docs += [(n, None), (n + 1, ""), (None, "no id"), (n + 2, "word " * 40_000)]
    labels += [(None, 0), (n + 1, None), (0, labels[0][1])]
    return docs, labels


def test_quality_separates_held_out_rows(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("quality", F.lit(9))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(d, lab)
    assert 0 < len(model.rules) < 200
    got = {r.doc_id: r for r in quality.scored(d, model).collect()}
    assert len(got) == len(docs)
    known = dict(x for x in labels if x[0] is not None and x[1] is not None)
    held = [k for k in known if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 80
    assert np.mean([got[k].predicted == known[k] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark):
    docs, labels = labelled()
    flipped = [(k, 1 - q if k is not None and q is not None and zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, q in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (quality.train(d, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert a == b


def test_compiled_score_equals_the_model(spark):
    docs, labels = labelled(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    stats = quality.statistics(F.col("text"))
    for r in d.select(*[c.alias(k) for k, c in stats.items()], model.score(stats).alias("score")).collect():
        total = model.intercept + sum(w for rule, w in model.rules if all((r[n] > at) == above for n, above, at in rule))
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_one_kind_of_label_and_no_rows(spark, no_docs):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    model = quality.train(d, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert not model.rules and all(0.5 < r.score < 1 for r in quality.scored(d, model).collect())
    empty = quality.train(no_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.scored(no_docs, empty).collect() == []


def brute_forward(word, pieces, p):
    if not word:
        return 1.0
    total = langid.UNKNOWN * brute_forward(word[1:], pieces, p)
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            total += p[pieces[word[:k]]] * brute_forward(word[k:], pieces, p)
    return total


def test_forward_sums_all_segmentations():
    pieces = {x: k for k, x in enumerate(("a", "b", "ab", "ba", "aba", " a"))}
    p = [0.3, 0.2, 0.1, 0.15, 0.05, 0.2]
    for word in ("abab", " abba", "abca", "ccc", "b"):
        assert langid.forward(word, pieces, p, 3)[-1] == pytest.approx(brute_forward(word, pieces, p), rel=1e-12)
    out = dict.fromkeys(range(len(pieces)), 0.0)
    langid.expected_counts("abab", 2.0, pieces, p, 3, out)
    covered = sum(len(x) * out[k] for x, k in pieces.items())
    assert covered == pytest.approx(8.0, rel=1e-3)


def test_words_of_any_length_in_any_number_of_languages():
    r = random.Random(3)
    pieces = {x: k for k, x in enumerate(("a", "b", "ab", "ba", "aba", " a", "bbab"))}
    for n in (1, 4, 7):
        p = np.array([[r.random() / 5 for _ in range(n)] for _ in pieces])
        some = ["".join(r.choice("ab c") for _ in range(r.randint(1, 14))) for _ in range(60)] + ["", "ab" * 4000]
        got = langid.log_probabilities(some, pieces, p, 4)
        for word, row in zip(some, got):
            for c in range(n):
                if len(word) < 20:
                    assert row[c] == pytest.approx(np.log(brute_forward(word, pieces, p[:, c])), rel=1e-10)
                assert row[c] == pytest.approx(langid.forward_logs(word, pieces, p[:, c], 4)[-1], rel=1e-10)
    # Piece counts of a long word, and scores of words that aren't cut anywhere.
    out = dict.fromkeys(range(len(pieces)), 0.0)
    langid.expected_counts("ab" * 3000, 1.0, pieces, [0.1] * 7, 4, out)
    assert sum(len(x) * out[k] for x, k in pieces.items()) == pytest.approx(6000, rel=1e-3)
    assert langid.words_of("x" * 500 + " y²") == [" " + "x" * 500, " y"]


def test_a_batch_of_more_words_than_are_remembered(monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 40)
    model = langid.Model(["p", "q"], np.random.default_rng(1).random((len(langid.vocabulary()), 2)) / 1e5, "piece_bpe_32k.model")
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(m)) for m in (3, 1500, 0, 2500)]
    score = model.scorer()
    assert score(texts) == [score([t])[0] for t in texts] and score([None, "12"]) == [("und", 0.0)] * 2


def test_own_columns_stay(spark):
    d = spark.createDataFrame([(1, "aa bb", "x", "y"), (2, None, "z", None)], "doc_id long, text string, made string, _p string")
    model = langid.Model(["p"], np.full((len(langid.vocabulary()), 1), 1e-5), "piece_bpe_32k.model")
    got = langid.predicted(d, model)
    assert got.columns == ["doc_id", "text", "made", "_p", "lang_pred", "score"]
    assert [tuple(r)[:5] for r in got.collect()] == [(1, "aa bb", "x", "y", "p"), (2, None, "z", None, "und")]
    rules = quality.RuleEnsemble(0.0, ())
    assert [tuple(r)[:4] for r in quality.scored(d.withColumnRenamed("made", "_stats"), rules).collect()] == [(1, "aa bb", "x", "y"), (2, None, "z", None)]


def test_language_of_held_out_rows(spark):
    r = random.Random(5)
    syllables = {"xx": ["ka", "to", "mi", "ru"], "yy": ["str", "ung", "ein", "cht"], "zz": ["eau", "ou", "ette", "ique"]}
    docs = []
    for k in range(300):
        lang = r.choice(sorted(syllables))
        text = " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40)))
        docs.append((k, text, lang if k % 17 else None))
    docs += [(900, None, "xx"), (901, "", "xx"), (902, "123 ²½ !!", "yy"), (None, "kato miru", "zz"), (903, "ka" * 50_000, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = langid.train(d, sample=60)
    assert model.langs == ["xx", "yy", "zz"] and np.allclose(model.p.sum(axis=0), 1)
    got = {x.doc_id: x for x in langid.predicted(d, model).withColumn("h", held_out(F.col("doc_id"))).collect()}
    truth = [(k, lang) for k, _, lang in docs[:300] if lang and got[k].h]
    assert len(truth) > 30 and np.mean([got[k].lang_pred == lang for k, lang in truth]) > 0.97
    assert all(got[k].lang_pred == "und" for k in (900, 901, 902)) and got[903].lang_pred == "xx"
    assert all(0 <= x.score <= 1 for x in got.values())


def test_no_labels(spark, no_docs):
    model = langid.train(no_docs)
    d = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert langid.predicted(d, model).first().lang_pred == "und"
