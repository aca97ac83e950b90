import hashlib
import re
from pathlib import Path

import numpy as np
import pytest

from arbor.llm import decontaminate, order_minhash, spans
from arbor.llm.common import WordHashes, mixed, shared_folder, words
from arbor.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_words_are_those_of_the_pattern(rows):
    for t in ["Ab9ÉÀ-x_y z~", *[r[1] for r in rows]]:
        assert [w.decode() for w in words(t)] == plain_words(t)


@pytest.mark.parametrize("block", [400_000, 3])
def test_decontamination_against_brute_force(spark, docs, rows, block):
    some = [r for r in rows if r[1] and len(plain_words(r[1])) > 30]
    items = [(k, " ".join(plain_words(r[1])[5 : 18 + k])) for k, r in enumerate(some[:4])]
    items += [(50, "one"), (51, None), (52, ""), (53, items[0][1].upper()), (54, "nowhere to be found in any of these texts at all really not"), (55, " ".join(plain_words(some[0][1])[:4]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(decontaminate.hit_spans(docs, bench, block=block)).collect()
    windows = [(str(i), tuple(w[k : k + 10])) for i, t in items for w in [plain_words(t)] if w for k in range(max(1, len(w) - 9))]
    want = []
    for r in rows:
        w, hit, found = plain_words(r[1]), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(i)
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = decontaminate.decontaminated(docs, bench, block=block).collect()
    clean = [r for r, w in zip(rows, want) if not w[5]]
    assert sorted(map(tuple, kept), key=str) == sorted(map(tuple, clean), key=str)


def test_decontamination_of_nothing(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(decontaminate.hit_spans(docs, none)).where("contaminated").count() == 0
    assert decontaminate.hit_spans(no_docs, none).count() == 0


def test_sentences_cover_the_text(rows):
    for t in [r[1] or "" for r in rows] + ["a. b! c?\n\n d", "w " * 500, "x, " * 200, "...", "\n"]:
        cut = spans.sentences(t)
        assert "".join(t[a:b] for a, b in cut) == t


def plain_sentences(ws, apart=4):
    """Where sentences start, one after the other by the definition: the least hash first, as far as there is room."""
    h = [int(x) for x in WordHashes().of(ws)]
    rank = {k: int(mixed(np.array([(h[k - 1] * 0x9E3779B97F4A7C15 + h[k]) % 2**64], np.uint64))[0]) for k in range(apart, len(ws) - apart + 1)}
    taken = [0] if ws else []
    for k in sorted(rank, key=lambda k: (rank[k], k)):
        if all(abs(k - t) >= apart for t in taken):
            taken.append(k)
    return sorted(taken)


def test_spans_against_brute_force(docs, rows):
    got = {(r.doc_id, r.text): r.n_sentences for r in spans.deduplicated(docs).collect()}
    seen, want = {}, {}
    for r in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        doc, t = (r[0] is None, r[0] if r[0] is not None else r[1]), r[1]
        ws = spans.words(t)
        starts = plain_sentences(ws)
        cut = spans.sentences(t) if t else []
        assert [len(spans.words(t[a:b])) for a, b in cut if spans.words(t[a:b])] == np.diff([*starts, len(ws)]).tolist()
        own_words = [ws[a:b] for a, b in zip(starts, [*starts[1:], len(ws)])]
        gone, own = set(), set()
        for j in range(len(own_words) - 2):
            some = own_words[j : j + 3]
            if sum(map(len, some)) < spans.LEAST_WORDS:
                continue
            key = tuple(b" ".join(w) for w in some)
            if key in own or seen.get(key, doc) != doc:
                gone |= {j, j + 1, j + 2}
            own.add(key)
            seen.setdefault(key, doc)
        want[r[0], "".join(t[a:b] for k, (a, b) in enumerate(cut) if k not in gone).rstrip() if gone else t] = len(cut)
    assert got == want
    assert any(r.n_removed for r in spans.deduplicated(docs).collect())


def test_texts_are_cut_a_few_at_a_time(rows, monkeypatch):
    texts, read = [r[1] for r in rows], []
    whole = list(spans._cut_words(texts, WordHashes()))
    monkeypatch.setattr(spans, "AT_ONCE", 200)
    few = []
    for found in spans._cut_words((read.append(t) or t for t in texts), WordHashes()):
        few.append(found)
        # Of the texts not yet cut, none but the last is read once the others have the words for a turn.
        assert sum(len(plain_words(t)) for t in read[len(few) : -1]) < 200
    assert len(few) == len(texts) and all(np.array_equal(x, y) for a, b in zip(few, whole) for x, y in zip(a, b))
    assert [n for _, _, n in few] == [len(spans.words(t)) for t in texts]


def test_spans_keep_columns_and_nothing(docs, no_docs):
    out = spans.deduplicated(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert spans.deduplicated(no_docs).collect() == []


def test_hashes_of_spans_are_deleted_before_texts_are_sent(spark, docs):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = spans.deduplicated(docs)
    (left,) = set(folder.iterdir()) - before
    assert not {"h", "g", "first"} & set(spark.read.parquet(str(left)).columns)
    assert len(out.collect()) == docs.count()


def test_rows_of_one_id_are_one_holder(spark):
    some = lambda k, n: " ".join(f"{k}{x * x}" for x in range(n))
    passage = some("p", 54)
    rows = [(1, f"{some('a', 9)} {passage}"), (1, f"{passage} {some('b', 20)}"), (2, some("c", 40)), (2, f"{some('c', 40)} {some('d', 9)}"), (3, f"{passage} {some('e', 20)}")]
    got = [(r.doc_id, r.text, r.n_removed) for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {(i, t) for i, t, n in got if not n} == set(rows[:4])
    assert [(i, len(words(t)) < 40) for i, t, n in got if n] == [(3, True)]


def test_similarity_counts_whole_shingles():
    a = list(range(100))
    assert order_minhash.similarity_of(a, a) == 1
    b = a[:50] + [-1] + a[51:]
    assert order_minhash.similarity_of(a, b) == pytest.approx(91 / (96 + 96 - 91))
    assert order_minhash.similarity_of(a, a[50:] + a[:50]) == 0
    assert order_minhash.similarity_of(a, []) == 0


def test_near_classes_against_brute_force(docs, rows):
    got = order_minhash.near_classes(docs).collect()
    assert len(got) == len(rows)
    ws = {r[0]: words(r[1]) for r in rows if r[0] is not None}
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
    assert {(g.doc_id, g.class_id) for g in got} == {(k, root(k)) for k in ws} | {(None, None)}
    assert len({root(k) for k in (4, 5, 6)}) == 1 and root(13) == 10
    kept = order_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] is None or root(r[0]) == r[0])


def test_a_large_group_of_near_copies_is_one_class(spark):
    import random

    r = random.Random(7)
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    rows = []
    for k in range(120):
        own = list(base)
        for _ in range(4):
            own[r.randrange(200)] = f"x{k}"
        rows.append((1000 - k, " ".join(own)))
    rows.append((5000, " ".join(base)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {x.class_id for x in order_minhash.near_classes(d).collect()}
    assert classes == {881}


def test_near_classes_of_nothing(no_docs):
    assert order_minhash.near_classes(no_docs).collect() == []


def _components_of(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("shape", ["path", "shuffled path", "star", "random", "loops", "none"])
def test_components(spark, shape):
    import random

    r = random.Random(4)
    ids = r.sample(range(10**6), 600)
    edges = {
        "path": [(k, k + 1) for k in range(600)],
        "shuffled path": list(zip(ids, ids[1:])),
        "star": [(10**7, k) for k in ids] + [(3, 5)],
        "random": [(r.randrange(500), r.randrange(500)) for _ in range(330)],
        "loops": [(7, 7), (8, 8), (8, 8), (9, 8), (8, 9)],
        "none": [],
    }[shape]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.label for x in got} == _components_of(edges) and len(got) == len({x.node for x in got})


def test_revisions_of_a_page_are_one_class(spark):
    import random

    r = random.Random(8)
    page, ids, rows = [f"w{k}" for k in range(150)], r.sample(range(1, 10**6), 60), []
    for k, i in enumerate(ids):
        page[(k * 7) % 150] = f"v{k}"
        rows.append((i, " ".join(page)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert order_minhash.similarity_of(rows[0][1].split(), rows[-1][1].split()) == 0
    assert {x.class_id for x in order_minhash.near_classes(d).collect()} == {min(ids)}


def test_alignment_against_the_usual_recurrence():
    import random

    r = random.Random(9)
    for n in (5, 9, 40, 120):
        for _ in range(30):
            a = [r.randrange(n) for _ in range(n)]
            b = [x for x in a if r.random() > 0.02]
            b[r.randrange(len(b)) : 0] = [-1] * r.randrange(2)
            x, y = (order_minhash.labelled_shingles(np.array([k + 2 for k in t], np.uint64)).tolist() for t in (a, b))
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i in range(len(x)):
                for j in range(len(y)):
                    best[i + 1][j + 1] = max(best[i][j] + (x[i] == y[j]), best[i][j + 1], best[i + 1][j])
            want = best[-1][-1] / (len(x) + len(y) - best[-1][-1])
            assert order_minhash.alignment(np.array(x), np.array(y)) == (pytest.approx(want) if want >= 0.8 else 0)


def test_very_long_near_copies(spark):
    words_of = [f"w{k * k % 99991}" for k in range(120_000)]
    other = [w if k % 60 else "x" for k, w in enumerate(words_of)]
    d = spark.createDataFrame([(5, " ".join(words_of)), (4, " ".join(other)), (6, " ".join(other[:50_000]))], "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in order_minhash.near_classes(d).collect()} == {4: 4, 5: 4, 6: 6}


def test_blocks_leave_no_link_out(spark, monkeypatch):
    import random

    monkeypatch.setattr(order_minhash, "BLOCK", 1 << 15)
    monkeypatch.setattr(order_minhash, "PAIRS_UP_TO", 2)
    r = random.Random(11)
    base, rows = [f"b{k}" for k in range(200)], []
    for k in range(90):
        own = list(base)
        for _ in range(r.randrange(2, 5)):
            own[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append(own)
    linked = [(a, b) for a in range(90) for b in range(a) if order_minhash.similarity_of(rows[a], rows[b])]
    want = {k: k for k in range(90)} | _components_of(linked)
    assert 1 < len(set(want.values())) < 90
    d = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(rows)], "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in order_minhash.near_classes(d).collect()} == want


def test_own_columns_of_any_name_stay(spark):
    d = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "z", None), (None, None, "n", "n")], "doc_id long, text string, Gone string, _gone string")
    kept = order_minhash.one_of_each(d)
    assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(map(str, [d.collect()[0], d.collect()[2]]))


def test_a_passage_without_stops_is_found_wherever_it_stands(spark):
    import random

    r = random.Random(1)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    passage = some(80)
    rows = [(1, f"{some(31)} {passage} {some(40)}"), (2, f"{some(44)} {passage} {some(20)}")]
    got = {x.doc_id: x for x in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and len(got[2].text.split()) < 44 + 20 + 40


def test_near_pairs_in_a_bucket_whose_leaders_win_nobody(spark):
    import random

    r = random.Random(3)
    some = lambda k, n: [f"{k}x{r.randrange(10**6)}" for _ in range(n)]
    notice, rows = some("n", 176), []
    for k in range(12):
        own = some(f"p{k}", 5)
        rows += [notice + own + some(f"a{k}", 19), notice + own + some(f"b{k}", 19)]
    rows += [notice + some(f"s{k}", 24) for k in range(40)]
    want = {k: k - k % 2 if k < 24 else k for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            assert (order_minhash.similarity_of(rows[a], rows[b]) > 0) == (want[a] == want[b])
    d = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(rows)], "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in order_minhash.near_classes(d).collect()} == want


def _removed(spark, first, second):
    """Words that the second of two texts loses."""
    d = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    got = {x.doc_id: x for x in spans.deduplicated(d).collect()}
    assert got[1].n_removed == 0
    return len(words(second)) - len(words(got[2].text))


def test_a_passage_of_short_lines_is_found(spark):
    lines = [f"Ab{k} ce{k * k}!!" for k in range(30)]
    assert _removed(spark, "\n".join(lines), "Other text here. " + "\n".join(lines)) >= 48


def test_a_passage_inside_other_sentences_is_found_wherever_it_begins():
    import random

    r = random.Random(5)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) + r.choice(["", "", "", "", ",", "."]) for _ in range(n))

    def keys(t):
        ws = [tuple(words(t[a:b])) for a, b in spans.sentences(t)]
        return set(zip(ws, ws[1:], ws[2:]))

    for _ in range(300):
        passage = some(51)
        assert keys(f"{some(r.randint(5, 60))} {passage} {some(30)}") & keys(f"{some(r.randint(5, 60))} {passage} {some(30)}")
    for t in [some(n) for n in range(1, 80)] + ["w " * 500]:
        sizes = [len(words(t[a:b])) for a, b in spans.sentences(t)]
        assert max(sizes) < 8 and (min(sizes) >= 4 or sum(sizes) < 4)


def test_a_passage_with_other_punctuation_is_found(spark):
    import random

    r = random.Random(6)
    ws = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(80)]
    other = " ".join(w.upper() + r.choice(["", ".", ",", " ***", " &&&", " %%%.\n"]) for w in ws)
    assert _removed(spark, ", ".join(ws), other) == 80


@pytest.mark.parametrize("block", [400_000, 2])
def test_items_without_an_id_contaminate(spark, block):
    ws = [f"w{k}" for k in range(40)]
    d = spark.createDataFrame([(1, " ".join(ws)), (2, "nothing of it"), (3, "alone")], "doc_id long, text string")
    items = [(None, " ".join(ws[:12])), (None, " ".join(ws[20:31])), (7, " ".join(ws[2:12])), (None, "alone")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.hit_spans(d, bench, block=block)).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (23, 2, True) and got[1].items_sha256 == hashlib.sha256(b"7").hexdigest()
    assert (got[3].n_hit, got[3].n_items, got[3].contaminated) == (1, 1, True) and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert not got[2].contaminated
    assert [r.doc_id for r in decontaminate.decontaminated(d, bench, block=block).collect()] == [2]


def test_repeats_in_rows_without_an_id_lose_them(spark):
    some = lambda k, n: " ".join(f"{k}{x * x}" for x in range(n))
    passage = some("p", 54)
    rows = [(None, f"{some('a', 9)} {passage}"), (None, f"{some('b', 30)} {passage}"), (0, f"{passage} {some('c', 20)}"), (None, None), (None, f"{some('a', 9)} {passage}"), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in spans.deduplicated(d).collect()), key=str)
    assert len(got) == 6 and (0, rows[2][1], 0) in got and (None, None, 0) in got and (5, "", 0) in got
    lost = [len(words(t)) for i, t, n in got if n]
    assert len(lost) == 3 and all(x < 45 for x in lost)


def test_a_passage_in_a_script_without_spaces_is_found(spark):
    import random

    r = random.Random(12)
    some = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = some(70)
    rows = [(1, some(40) + "。" + passage), (2, some(33) + passage[:35] + "、" + passage[35:] + "。" + some(31))]
    got = {x.doc_id: x for x in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and 64 <= len(got[2].text) < 90


def test_repeated_passages_lose_no_own_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    d = spark.createDataFrame([(1, text, "KEEP", 1, "x"), (2, text, "KEEP", 2, "y")], "doc_id long, text string, _spans string, Gone int, made string")
    got = {r.doc_id: r for r in spans.deduplicated(d).collect()}
    assert (got[2]["_spans"], got[2]["Gone"], got[2]["made"], got[2].text) == ("KEEP", 2, "y", "") and got[1].text == text
