"""Segments of facts are scored once."""

from claimloom.operators import facts as fa


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_segments_scores_once(spark):
    pages = spark.createDataFrame([(1, 1, "Patients improved by 12% versus placebo in the trial. Adverse events were 3% in all adults.")], "doc_id long, page int, text string")
    got = fa.fact_segments(fa.fact_blocks(pages))
    assert plan(got).count("hazard ratio|odds ratio") <= plan(got.limit(1000)).count("hazard ratio|odds ratio") <= 4
    assert got.count() == 3
