import numpy as np

from claimloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(vectors, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum())), i) for i, x in vectors if i != q and len(x) == len(v))
        out[q] = d[:k]
    return out


def test_recall_ties_and_unusable_vectors(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 32))
    vectors = [(int(i), (centres[i % 12] + 0.4 * rnd.normal(size=32)).astype(np.float32).tolist()) for i in range(3000)]
    vectors += [(5000 + i, vectors[0][1]) for i in range(40)]  # ties at distance 0
    good = list(vectors)
    rows = [(i, v, 1, "x") for i, v in vectors]
    rows += [(7000, None, 1, "x"), (7100, [], 1, "x"), (7200, [0.0] * 32, 1, "x"), (7300, [float("nan")] * 32, 1, "x"), (7400, [1.0] * 31 + [None], 1, "x"), (7500, [float("inf")] + [1.0] * 31, 1, "x"), (None, [1.0] * 32, None, None), (7600, [1.0, 2.0], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 100 = 0"), block_vectors=900, block_queries=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(good, [(i, v) for i, v in good if i % 100 == 0], 10)
    assert set(got) == set(want)
    right = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, i) for _, s, i in rows] == sorted((s, i) for _, s, i in rows)
        right += len({i for _, _, i in rows} & {i for _, i in want[q]})
    assert right >= 0.95 * 10 * len(want)
    assert [i for _, _, i in got[0]] == list(range(5000, 5010))


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, "x"), (1, [1.0, 3.0], 1, "x"), (100, [5.0, 5.0], 1, "x")], SCHEMA)
    got = ann.search(df, df.filter("vec_id % 100 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert ann.search(df.limit(0), df).collect() == [] and ann.search(df, df.limit(0)).collect() == []
