import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arbor.llm import packing

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcÉß 'st\n\t  0123.,!<|endoftext|>", max_size=80))
def test_ids_are_those_of_the_tokenizer(t):
    assert packing._coder("byte_bpe_50k.json")(t).tolist() == EXACT.encode(t, add_special_tokens=False).ids


def test_pack_round_trip(docs, rows, no_docs):
    got = [r.asDict() for r in packing.pack(docs, 64).collect()]
    by_doc = {}
    for r in rows:
        ids = EXACT.encode(r[1] or "", add_special_tokens=False).ids + [2]
        by_doc[r[0]] = [(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n in packing.pieces_of(len(ids), 64)]
    count = Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got)
    want = Counter((r[0], k, *p) for r in rows for k, p in enumerate(by_doc[r[0]]))
    assert count == want
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    assert packing.pack(no_docs, 64).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_nearly_as_well_as_can_be(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 1024) if seed % 2 else min(1024, int(r.lognormvariate(6, 1)) + 1) for _ in range(20_000)]
    h = Counter(lengths)
    bins = packing.plan(h)
    placed = Counter()
    for own, n in bins:
        assert sum(own) <= 1024
        for x in own:
            placed[x] += n
    assert placed == h
    assert sum(n for _, n in bins) <= 1.01 * (sum(lengths) / 1024) + 2


@given(st.dictionaries(st.integers(1, 50), st.integers(0, 30), max_size=12))
@settings(max_examples=100, deadline=None)
def test_plan_of_any_histogram(h):
    placed = Counter()
    for own, n in packing.plan(h, 50, groups=5):
        assert sum(own) <= 50
        for x in own:
            placed[x] += n
    assert placed == Counter({k: n for k, n in h.items() if n})
    where = packing.places(packing.plan(h, 50, groups=5))
    assert all(runs[:, 2].sum() == h[x] for x, runs in where.items())
