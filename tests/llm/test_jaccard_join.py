import random
import re

import numpy as np

from claimloom.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, comp string, n int"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    out = []
    for i, (doc, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def cases(seed=1):
    rnd = random.Random(seed)
    vocab = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(400)]
    shared = [rnd.choice(vocab) for _ in range(30)]
    rows = []
    for base in range(25):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 5, 6, 8, 12, 40, 120, 300]))]
        if base % 3 == 0:
            words += shared
        for _ in range(rnd.choice([1, 2, 4, 12])):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(copy) // 60))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows) * 3 % 1009, rnd.choice([" ", "\n", " \t"]).join(copy), "x", 1))
    rows += [(2000, None, "x", 1), (2001, "", "x", 1), (2002, " \n ", None, None), (2003, "ONE two", "x", 1), (2004, "one TWO", "x", 1), (2005, "É two", "x", 1), (2006, "é two", "x", 1)]
    rows += [rows[3], rows[3], (None, rows[7][1], "n", 1), (None, "all alone here", "n", 1), (2010, "long " * 40_000, "l", 1), (2011, "a\x1cb a\x85b", "l", 1)]
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = cases(seed)
        got = jj.link(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=4, block_docs=10)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = cases(3)
    want = {i for i, _, c in brute(rows) if i == c} | {None}
    kept = jj.representatives(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "comp", "n"]
    assert {r.doc_id for r in kept.collect()} == want


def test_empty_table(spark):
    assert jj.link(spark.createDataFrame([], SCHEMA)).collect() == []


def test_forest_connects_what_is_linked_with_few_links():
    rnd = np.random.default_rng(1)
    base = np.unique(rnd.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.r_[base[rnd.random(len(base)) < 0.97], rnd.integers(0, 2**63, 3, dtype=np.uint64)]) for _ in range(200)]
    assert len(jj.forest(sets, jj.Rule())) == 199
