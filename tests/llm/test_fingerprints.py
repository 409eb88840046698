import hashlib
import random

import numpy as np
import pytest

from claimloom.llm import fingerprints as fp

MASK = (1 << 64) - 1


def plain_mix(h):
    h = ((h ^ (h >> 33)) * 0xFF51AFD7ED558CCD) & MASK
    return h ^ (h >> 29)


def plain_hash(chunk):
    return plain_mix(sum((c + 1) * pow(fp._BASE, i, 1 << 64) for i, c in enumerate(chunk)) & MASK)


def plain_fingerprint(data):
    """Byte by byte: a chunk ends behind a window whose hash has ``level`` zero bits."""
    if not data:
        return ""
    zeros = {}
    for i in range(fp.WINDOW, len(data)):
        h = plain_hash(data[i - fp.WINDOW : i])
        zeros[i] = 64 if h == 0 else (h & -h).bit_length() - 1

    def ends(level):
        return [i for i in zeros if zeros[i] >= level] + [len(data)]

    level = fp.LOWEST
    while len(ends(level)) > fp.CHUNKS:
        level += 1

    def signature(level):
        out, start = "", 0
        for e in ends(level):
            code = plain_hash(data[start:e]) >> 52
            out += fp._SYMBOLS[code >> 6] + fp._SYMBOLS[code & 63]
            start = e
        return out

    return f"{level}:{signature(level)}:{signature(level + 1)}"


def plain_likeness(x, y):
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    (kx, *sx), (ky, *sy) = x.split(":"), y.split(":")
    best = 0.0
    for i in range(2):
        for j in range(2):
            if int(kx) + i == int(ky) + j:
                a, b = ([s[p : p + 2] for p in range(0, len(s), 2)] for s in (sx[i], sy[j]))
                d = [[max(p, q) if not p or not q else 0 for q in range(len(b) + 1)] for p in range(len(a) + 1)]
                for p in range(1, len(a) + 1):
                    for q in range(1, len(b) + 1):
                        d[p][q] = min(d[p - 1][q] + 1, d[p][q - 1] + 1, d[p - 1][q - 1] + (0 if a[p - 1] == b[q - 1] else 2))
                best = max(best, 1 - d[-1][-1] / (len(a) + len(b)))
    return best


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(n))


def test_fingerprints_equal_the_byte_by_byte_form():
    rnd = random.Random(3)
    cases = ["", "a", "ab" * 3, "abcdefg", "abcdefgh", "x" * 3000, "é" * 40, *[words(rnd, n) for n in (3, 8, 20, 80, 300, 900)]]
    for text in cases:
        want = plain_fingerprint(text.encode())
        assert fp.Fingerprinter().of(text.encode()) == want
        assert fp.Fingerprinter(block=64).of(text.encode()) == want


def test_likeness_equals_the_full_table_and_tells_edits_from_strangers():
    rnd = random.Random(5)
    make = fp.Fingerprinter()
    near, far = [], []
    for n in (10, 40, 150, 600, 2500):
        a, b = words(rnd, n), words(rnd, n)
        fa, fb, fe = (make.of(t.encode()) for t in (a, b, fp.edited(a, b)))
        for x, y in ((fa, fb), (fa, fe), (fe, fb)):
            assert fp.likeness(x, y) == pytest.approx(plain_likeness(x, y))
        near.append(fp.likeness(fa, fe))
        far.append(fp.likeness(fa, fb))
    assert min(near) > 0.3 and max(far) < 0.1
    long = words(rnd, 200_000)
    assert fp.likeness(make.of(long.encode()), make.of(fp.edited(long, "").encode())) > 0.4


def test_rows_equal_brute_force(spark):
    rnd = random.Random(7)
    texts = [words(rnd, rnd.randint(0, 60)) for _ in range(200)] + [None, "", "x", "yz", "z" * 5000, "日本語 テキスト 😀 " * 30, "zz " * 9]
    rows = [(None if i == 7 else i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string, part int")
    want = []
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for r, after in zip(order, order[1:] + order[:1]):
        t, o = r[1] or "", after[1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + o[:half]
        fa, fe, fo = (plain_fingerprint(x.encode()) for x in (t, e, o))
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fa, fe, plain_likeness(fa, fe), plain_likeness(fa, fo)))
    got = fp.fingerprint_next(df.repartition(5)).collect()
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=lambda r: (r[0] is None, -(r[0] or 0))), want):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:])


def test_ties_repeated_rows_one_row_and_no_rows(spark):
    schema = "doc_id long, text string"
    rows = [(5, "same text of some words here")] * 3 + [(5, "other"), (4, None), (4, "same text of some words here")]
    got = fp.fingerprint_next(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == sorted((i, len(t or "")) for i, t in rows)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 5) >= 2
    assert len({r.fingerprint for r in got if r.n_chars == 28}) == 1
    one = fp.fingerprint_next(spark.createDataFrame([(1, "abcdef")], schema)).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert fp.fingerprint_next(spark.createDataFrame([], schema)).collect() == []
    nulls = fp.fingerprint_next(spark.createDataFrame([(None, None), (None, "")], schema)).collect()
    assert [(r.n_chars, r.fingerprint, r.near_edited, r.near_next) for r in nulls] == [(0, "", 1.0, 1.0)] * 2
