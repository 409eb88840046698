import hashlib
import random

import numpy as np

from claimloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, th string, ord int"


def brute(rows, length):
    seen, out = {}, []
    texts = [((-(2**63) if i is None else i), (t or "").encode()) for i, t, *_ in rows]
    for doc, raw in texts:
        for s in range(len(raw) - length + 1):
            k = raw[s : s + length]
            seen[k] = min(seen.get(k, (doc, s)), (doc, s))
    for (i, *_), (doc, raw) in zip(rows, texts):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] < (doc, s):
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefé ñ") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 60))) for _ in range(8)]
    rows = []
    for i in rnd.sample(range(-50, 900), 120):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40))))
        rows.append((i, rnd.choice(["", "\n", " "]).join(parts), "x", 1))
    base = " ".join(rnd.choice(vocab) for _ in range(150))
    for i in range(1000, 1025):
        cut = rnd.randrange(len(base))
        rows.append((i, base[:cut] + rnd.choice("xyz") + base[cut + 1 :], "near", 1))
    rows += [(2000, None, "x", 1), (2001, "", "x", None), (None, base, None, 1), (None, passages[0] * 3, "x", 1), (2002, "ab" * 4000, "x", 1), (2003, "a" * 777, "x", 1)]
    rows += [rows[5], rows[5], (rows[5][0], rows[6][1], "same id", 1), (2004, "é" * 99, "x", 1), (2005, "\x00" * 300 + base[:60], "x", 1)]
    return rows


def test_equals_brute_force(spark):
    for seed, length, gram, hot in ((1, 100, 24, 4000), (2, 30, 7, 4000), (3, 30, 8, 10)):
        rows = cases(seed)
        got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), length=length, gram=gram, parts=5, hot=hot)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, length)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_index_equals_naive_sorting():
    rnd = np.random.default_rng(1)
    for text in (rnd.integers(0, 3, 500), np.tile(rnd.integers(0, 4, 40), 20), np.zeros(50), np.zeros(0), rnd.integers(0, 256, 300)):
        text = text.astype(np.uint8)
        raw = text.tobytes()
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        index = sd.RunIndex(text)
        assert index.suffixes.tolist() == order
        want = np.zeros(len(raw), int)
        for a, b in zip(order, order[1:]):
            n = 0
            while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            want[b] = n
        assert index.matching_statistics(text).tolist() == want.tolist()


def test_chunks_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 300)
    rnd = random.Random(5)
    text = "".join(rnd.choice("abc") for _ in range(500))
    batch = {"ord": [1, 2], "th": [0, 0], "text": [text * 3, text]}
    seen = set()
    for g in sd._chunks(batch, 100):
        for d, s, e, p, h in zip(*sd.anchors([x[3] for x in g])):
            seen |= {(g[d][0], g[d][2] + x) for x in range(s, e + 1)}
    assert seen == {(1, x) for x in range(1401)} | {(2, x) for x in range(401)}
