import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from arbor.llm import license_scan, lz_fingerprint


def plain_parse(t):
    found, start = set(), 0
    for end in range(1, len(t) + 1):
        if t[start:end] not in found:
            found.add(t[start:end])
            start = end
    return found | ({t[start:]} if t[start:] else set())


@given(st.text(alphabet="ab cé", max_size=80), st.integers(0, 80))
def test_parse_equals_the_plain_one_and_can_be_resumed(t, cut):
    assert lz_fingerprint.finished(t, 0, set()) == plain_parse(t)
    phrases = set()
    at = lz_fingerprint.parse(t, 0, min(cut, len(t)), phrases)
    assert lz_fingerprint.finished(t, at, phrases) == plain_parse(t)


def test_fingerprints_against_brute_force(docs, rows):
    got = lz_fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    low = -(1 << 63)
    ring = sorted(((low if r[0] is None else r[0], r[1] or "") for r in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for (k, t), (_, u) in zip(ring, ring[1:] + ring[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = (lz_fingerprint.signature(plain_parse(x)) for x in (t, edited, u))
        want.append((None if k == low else k, len(t), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.as_text(a), lz_fingerprint.as_text(b), lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_single_and_no_document(spark, no_docs):
    assert lz_fingerprint.fingerprints(no_docs).collect() == []
    (r,) = lz_fingerprint.fingerprints(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_likeness_of_extremes():
    f = lz_fingerprint.fingerprint
    assert lz_fingerprint.likeness(f(""), f(None)) == 1 and lz_fingerprint.likeness(f(""), f("abc")) == 0 and lz_fingerprint.likeness(f("abc"), f("abc")) == 1


def test_licenses(spark, docs):
    t = license_scan.TEMPLATES
    rows = [
        (1, "Some words.\nLicensed under the Apache License, Version 2.0."), (2, "x\nReleased under the MIT License.\ny"), (3, t["MIT-text"].replace("hereby granted", "hereby kindly granted")),
        (4, "He asked for a driver's license and permission to leave."), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (8, "Licensed under CC BY 4.0."), (9, "a\n\n" + t["Apache-2.0-header"].replace(". ", ".\n") + "\n\nb"),
        (10, "filler word " * 3000 + t["GPL-3.0"] + " more filler" * 3000),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scanned(d).collect()}
    names = {k: list(r.licenses) for k, r in got.items()}
    assert names[1] == ["Apache-2.0"] and names[2] == ["MIT"] and names[3] == ["MIT-text"] and names[7] == ["CC-BY-NC-4.0"] and names[8] == ["CC-BY-4.0"]
    assert names[4] == names[5] == names[6] == [] and "Apache-2.0-header" in names[9] and names[10] == ["GPL-3.0"]
    (m,) = got[3].notices
    assert not m.exact and m.added == ["kindly"] and m.missing == []
    assert got[7].notices[0].exact and rows[0][1][got[1].notices[0].start : got[1].notices[0].end] == "Licensed under the Apache License, Version 2.0."
    assert license_scan.scanned(docs).count() == docs.count()


def test_notices_inside_a_paragraph_are_all_found():
    scanner, t = license_scan.Scanner(), license_scan.TEMPLATES
    for name in ("MIT", "GPL-3.0"):
        for n in (20, 80, 500):
            text = "some other words " * n + t[name] + " and still more of them" * n
            (found,) = scanner.scan(text)[1]
            assert found["license"] == name and found["exact"] and text[found["start"] : found["end"]] == t[name]
    line = f"The code is {t['MIT']} The text is {t['CC-BY-4.0'].upper()} Old parts: {t['GPL-2.0']}"
    assert [f["license"] for f in scanner.scan(line)[1]] == ["MIT", "CC-BY-4.0", "GPL-2.0"]
    (lesser,) = scanner.scan(t["LGPL-3.0"].replace("This work", "This small work"))[1]
    assert lesser["license"] == "LGPL-3.0" and lesser["added"] == ["small"]


def test_each_template_alone_is_found():
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        found = {f["license"]: f for f in scanner.scan(f"Words.\n{text}\nWords.")[1]}
        assert found[name]["exact"] and set(found) <= {name, "Apache-2.0"}


def test_savings_of_blocks_select_the_templates():
    scanner, t = license_scan.Scanner(), license_scan.TEMPLATES
    for name, text in t.items():
        ranked = scanner.ranked(license_scan.words(f"some words {text.upper()} and more"))
        assert ranked[0][1] == name or name == "Apache-2.0" and ranked[0][1] == "Apache-2.0-header"
        assert sorted(x[1] for x in ranked) == sorted(t) and ranked == sorted(ranked, key=lambda x: (-x[0], x[1]))
    (low,), (up,) = (scanner.scan(x)[1] for x in (t["MIT"], t["MIT"].upper()))
    assert low["reduction"] == up["reduction"] > 0.5
    # Without a saving no template is aligned, whatever the wording.
    scanner.given["MIT"] = scanner.alone
    assert scanner.scan(t["MIT"])[1] == [] and scanner.scan(t["GPL-3.0"])[1]


def test_licenses_against_all_templates_on_all_stretches():
    scanner, r = license_scan.Scanner(), random.Random(4)
    own = {k: w for k, w in scanner.words.items() if len(w) <= 14}
    for name, ws in own.items():
        for _ in range(4):
            notice = list(ws)
            for _ in range(r.randint(0, scanner.most[name])):
                notice.insert(r.randrange(1, len(ws)), b"odd") if r.random() < 0.5 else notice.pop(r.randrange(1, len(ws) - 1))
            text = b" ".join([b"prose"] * r.randint(0, 20) + notice + [b"more"] * r.randint(0, 20))
            every = license_scan.words(text.decode())
            close = {}
            for k, w in own.items():
                for a in range(len(every)):
                    for b in range(a + 1, min(len(every), a + len(w) + scanner.most[k]) + 1):
                        missing, added, lo, hi = scanner.differences(every[a:b], k)
                        if (lo, hi) == (0, b - a):
                            close[k] = min(close.get(k, 99), len(missing) + len(added))
            want = {k for k, n in close.items() if n == 0} or {k for k, n in close.items() if n <= scanner.most[k]}
            found = scanner.scan(text.decode())[1]
            assert name in want and {f["license"] for f in found} <= want and want - {f["license"] for f in found} <= {k for k in want if len(want) > 1 and close[k]}
            assert all(len(f["missing"]) + len(f["added"]) == close[f["license"]] for f in found) and found


def test_very_many_rows_without_an_id_are_split(spark):
    low = -(1 << 63)
    rows = [(None, f"none {k} " * (k % 7 + 1)) for k in range(150)] + [(k, f"text {k}") for k in range(40)] + [(low, "the lowest id"), (7, "text 7 again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    buckets = lz_fingerprint.in_ring(d).where("none and not ghost").groupBy("bucket").count().collect()
    assert len(buckets) > 5 and max(b["count"] for b in buckets) < 60
    got = lz_fingerprint.fingerprints(d).collect()
    after = {}
    for t in [t for _, t in rows]:
        for u in [u for _, u in rows]:
            half = len(t) // 2
            after.setdefault(hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest(), set()).add((t, u))
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    # Every row has a next one that the edit shows, and ids descend, the lowest before those without one.
    assert all(r.edited_sha256 in after for r in got)
    (last,) = [r for r in got if r.doc_id == low]
    assert any(u.startswith("none") for _, u in after[last.edited_sha256])
    (eight,) = [r for r in got if r.doc_id == 8]
    assert ("text 8", "text 7") in after[eight.edited_sha256]
