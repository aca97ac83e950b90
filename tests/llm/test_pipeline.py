"""The pipeline against a brute-force version that works on lists, each stage on what the one before kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from arbor.llm import decontaminate, order_minhash, packing, quality, spans  # noqa: E402
from arbor.llm.common import words  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in rows]
    docs += [(2000 + k, " ".join(["SPAM!!"] * (20 + k)), "en", "s", 9) for k in range(40)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1) for r in rows if r[0] is not None and r[1]] + [(2000 + k, 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    bench = [(1, " ".join(w.decode() for w in words(rows[40][1])[:14])), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, bench


def brute_spans(docs):
    seen, out = {}, []
    for doc_id, t, *rest in sorted(docs, key=lambda x: (x[0] is None, x[0])):
        doc = (doc_id is None, t if doc_id is None else doc_id)
        cut = spans.sentences(t) if t else []
        ws = [(k, spans.words(t[a:b])) for k, (a, b) in enumerate(cut) if spans.words(t[a:b])]
        gone, own = set(), set()
        for j in range(len(ws) - 2):
            if sum(len(w) for _, w in ws[j : j + 3]) >= spans.LEAST_WORDS:
                key = tuple(b" ".join(w) for _, w in ws[j : j + 3])
                if key in own or seen.get(key, doc) != doc:
                    gone |= set(range(ws[j][0], ws[j + 2][0] + 1))
                own.add(key)
                seen.setdefault(key, doc)
        new = "".join(t[a:b] for k, (a, b) in enumerate(cut) if k not in gone).rstrip() if gone else t
        out.append((doc_id, new, *rest[:-1], len(new) if gone else rest[-1]))
    return out


def test_run_equals_brute_force(spark, tables):
    d, docs, bench = tables
    frame = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{d}/labels.parquet"))
    stats = quality.statistics(F.col("text"))
    kept = []
    for r in frame.select("*", F.struct(*[c.alias(k) for k, c in stats.items()]).alias("s")).collect():
        total = model.intercept + sum(w for rule, w in model.rules if all((r.s[n] > at) == above for n, above, at in rule))
        if 1 / (1 + np.exp(-total)) >= quality.THRESHOLD:
            kept.append(tuple(r)[:5])
    assert not [r for r in kept if (r[0] or 0) >= 2000] and len(kept) >= len(docs) - 46
    # Near-duplicates, by all pairs.
    ws = {r[0]: words(r[1]) for r in kept if r[0] is not None}
    up = {k: k for k in ws}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(k for k in ws if ws[k])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if order_minhash.similarity_of(ws[a], ws[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    kept = [r for r in kept if r[0] is None or root(r[0]) == r[0]]
    kept = brute_spans(kept)
    windows = {w for _, t in bench for w in decontaminate.windows_of(t)}
    clean = []
    for r in kept:
        own = words(r[1])
        if not any(tuple(own[k : k + len(w)]) == w for w in windows for k in range(len(own) - len(w) + 1)):
            clean.append(r)
    assert len(clean) == len(kept) - 1
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in clean:
        ids = exact.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.update((r[0], k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids), 1024)))
    got = corpus_pipeline.run(spark, d).collect()
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    bins = Counter()
    for g in got:
        bins[g.sequence_id] += g.length
    assert max(bins.values()) <= 1024


def test_stages_keep_the_columns(spark, tables):
    d, _, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("_row", F.lit("clash")).withColumn("predicted", F.lit(0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), d).count() == 0, name
