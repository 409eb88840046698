import hashlib

from claimloom.llm import bloom, exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, row int"


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rows = [(i, f"text {i % 37}", "x", i) for i in range(300)]
    rows += [(1000 + i, None if i % 2 else "", "y", 0) for i in range(6)]
    rows += [(None, "lonely", "n", 1), (None, "text 3", "n", 2), (7, "text 7", "again", 3), (2000, "é" * 50_000, "long", 4), (2001, "é" * 3, None, 5)]
    return rows


def test_marks_every_row_like_brute_force(spark):
    for bits in (15, 27):  # a tiny filter only lets more rows through
        got = exact_dedup.mark(spark.createDataFrame(cases(), SCHEMA), log2_bits=bits)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(cases())


def test_keeps_all_columns_even_with_clashing_names(spark):
    rows = cases()
    best = {}
    for doc_id, text, *_ in rows:
        best[text or ""] = max(best.get(text or "", -1), -1 if doc_id is None else doc_id)
    kept = {(None if i < 0 else i, t) for t, i in best.items()}
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "keep_id", "row"]
    assert {(r.doc_id, r.text or "") for r in got.collect()} == kept


def test_empty_table_and_plan(spark):
    assert exact_dedup.mark(spark.createDataFrame([], SCHEMA)).collect() == []
    plan = exact_dedup.mark(spark.createDataFrame(cases(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_filter_has_no_false_negatives(spark):
    df = spark.createDataFrame([(f"k{i % 900}",) for i in range(1000)], "k string")
    hit = bloom.maybe_repeated(df, "k", bloom.repeated(df, "k", 20), "hit", 20).filter("hit").select("k").distinct().collect()
    assert {f"k{i}" for i in range(100)} <= {r.k for r in hit}
    assert len(hit) < 150
