"""Registered queries: names, twins and plans."""

import __spark_entry__ as driver
from claimloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_registry():
    queries, twins = driver.queries(), driver.oracle_sql()
    assert len(queries) > 200
    assert set(twins) <= set(queries)
    assert catalog.FLAGSHIP in queries


def test_flagship_runs(spark):
    df = driver.entry(spark)
    assert df.columns == ["claim_id", "passage_id", "reference_id", "hybrid_rank", "hybrid_score", "semantic_score"]
    assert df.count() > 0


def test_native_plans_stay_in_the_jvm(spark):
    for name in ("k12_keyword_prefilter", "f07_mine_facts", "e03_rank_evidence", "v06_compare_pages", "g05_scorecard", "c03_best_citation", "p10_lines_from_items"):
        text = plan(driver.queries()[name](spark, SMALL))
        assert "CartesianProduct" not in text, name
        assert "EvalPython" not in text and "InPandas" not in text, name


def test_scan_reads_only_the_needed_columns(spark):
    text = plan(driver.queries()["g03_duration_summary"](spark, SMALL))
    assert "ReadSchema: struct<user_id:bigint,value:double>" in text


def test_pattern_strength_slices_agree(spark):
    import random

    from claimloom.operators import history as hs

    rnd = random.Random(1)
    steps = [(k, i, rnd.choice([-2, -1, 1, 1])) for k in range(5) for i in range(40)]
    df = spark.createDataFrame(steps, "k long, i long, delta int")
    from pyspark.sql import functions as F

    want = {}
    for k, _, delta in steps:
        want[k] = max(0, want.get(k, 0) + delta)
    for cut in (None, F.floor(F.col("i") / 7)):
        got = {r.k: r.strength for r in hs.pattern_strength(df, ["k"], ["i"], cut).collect()}
        assert got == want


def documents(spark, folder, *texts):
    rows = [(i, text, "en", "src0", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_powers_of_ten_are_no_references(spark, tmp_path):
    d = documents(spark, tmp_path, "counts grew to 10\nx\nx\nmean was 5 x 10 \nx\nx\nseen in 10 patients\nx\nx\nsteady at 100")
    assert [r.sup_no for r in driver.queries()["a03_associate_sups"](spark, d).collect()] == [25, 37]  # the seventh and the tenth line
    assert {r.sup_no for r in driver.queries()["a02_sup_parent"](spark, d).collect()} == {1, 13, 25, 37}


def test_snippets_come_from_the_page(spark, tmp_path):
    d = documents(spark, tmp_path, "\n".join(f"word{c * 5} {'filler ' * 30}end{c}" for c in "abcdef"))
    got = {r.line_no: r.value for r in driver.queries()["t27_snippet"](spark, d).collect()}
    assert len(got) == 6 and all(len(v) <= 363 for v in got.values())
    assert [v.startswith("...") for _, v in sorted(got.items())].count(True) >= 4
    # 80 characters of the line before, then the statement's own first keyword
    assert got[5].startswith("...") and got[5].find("wordfffff") == 83
