"""A scope named by columns finds what the listed pairs find, and lists none."""

from pyspark.sql import functions as F

from claimloom.operators import retrieval as rt


def test_scope_by_columns_equals_listed_pairs(spark):
    vec = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") * 1.7 + i * (F.col("id") % 13 + 1)))
    claims = spark.range(40).select(F.col("id").alias("claim_id"), (F.col("id") % 2).cast("string").alias("brand"), (F.col("id") % 7).alias("slot"), vec.alias("embedding"))
    passages = spark.range(100, 400).select(
        F.col("id").alias("passage_id"), (F.col("id") % 150).alias("reference_id"), (F.col("id") % 2).cast("string").alias("brand"), (F.col("id") % 150 % 6).alias("slot"), vec.alias("embedding"))
    pairs = claims.select("claim_id", "slot").join(passages.select("reference_id", "slot").distinct(), "slot")
    got = rt.scoped_knn(claims, passages, ["brand", "slot"], 5)
    want = rt.scoped_knn(claims, passages, pairs, 5).select(*got.columns)
    rows = lambda df: sorted((r.claim_id, r["rank"], r.passage_id, round(r.similarity, 6), r.scoped) for r in df.collect())
    assert rows(got) == rows(want)
    assert {r.scoped for r in got.collect()} == {True, False}
