from pyspark.sql import functions as F

from claimloom.operators import retrieval as rt


def test_fact_sets_are_made_once(spark):
    sets = spark.range(4).select(
        F.col("id").alias("reference_id"), F.lit("a").alias("brand"), F.array(F.col("id") + 1.0, F.lit(2.0)).alias("embedding"),
        F.array(F.struct(F.lit("alpha beta 5 mg").alias("text"), F.lit(1).alias("page"))).alias("facts"))
    claims = spark.createDataFrame([(7, "a", "alpha beta", [2.0, 2.0])], "claim_id long, brand string, text string, embedding array<double>")
    got = rt.fact_anchor(claims, sets)
    # the search and the texts read what was stored
    assert "Range (" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.claim_id, r.reference_id, r.keyword_hits) for r in got.collect()] == [(7, 1, 2)]
