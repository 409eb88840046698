"""Joins of sides that grow with the input send neither side whole through the driver, however small the optimiser takes it for."""

from pyspark.sql import functions as F

from claimloom.operators import citations as ct
from claimloom.operators import topk
from claimloom.operators.postings import substring_hits
from claimloom.session import durable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def library(spark):
    return spark.range(8).select(
        F.col("id").alias("reference_id"), F.lit("b").alias("brand"), F.concat(F.lit("Roe Brain "), F.col("id").cast("string")).alias("display_alias"),
        F.lit("Published 2001").alias("content_text"))


def test_citation_tier_broadcasts_nothing(spark):
    claims = spark.createDataFrame([(1, 1, "b", 1, "slide", 5.0, [1, 2])], "claim_id long, doc long, brand string, page int, region string, y double, ref_numbers array<int>")
    pool = spark.createDataFrame([(1, 1, "slide", 1, "Roe AB et al. Brain. 2001;3(1):5-9."), (1, 1, "slide", 2, "Doe AB et al. Brain. 1990;3(1):5-9.")],
                                 "doc long, page int, region string, ref_no int, citation_text string")
    settled, narrowed = ct.citation_tier(claims, pool, library(spark), keep=0.1)
    assert "Broadcast" not in plan(settled) and "Broadcast" not in plan(narrowed)
    assert [(r.claim_id, r.reference_id, r.ref_no) for r in settled.collect()] == [(1, 3, 1)]
    assert narrowed.count() == 0


def test_best_citation_broadcasts_nothing(spark):
    c = spark.createDataFrame([("1", "b", "Roe AB et al. Brain. 2001;3(1):5-9.")], "citation_id string, brand string, citation_text string")
    best = ct.best_citation(c, library(spark))
    assert "Broadcast" not in plan(best)
    assert [(r.citation_id, r.reference_id) for r in best.collect()] == [("1", 3)]


def test_match_citations_broadcasts_nothing(spark):
    c = spark.createDataFrame([(1, "Roe AB et al. Brain. 2001"), (2, "Outcome of Doe paper")], "citation_id long, citation_text string")
    meta = spark.createDataFrame([(7, "Roe", "2001", None, ["Roe"], ["outcome"], ["brain"])],
                                 "reference_id long, first_author string, year string, doi string, author_tokens array<string>, title_tokens array<string>, journal_tokens array<string>")
    names = spark.createDataFrame([(7, "Roe 2001", "roe.pdf")], "reference_id long, name string, original_name string")
    index = ct.library_index(meta, names)
    assert "Broadcast" not in plan(index)
    for mode in ("server", "ui"):
        best = ct.match_citations(c, index, mode)
        assert "Broadcast" not in plan(best)
        assert [(r.citation_id, r.reference_id, r.score) for r in best.collect()] == [(1, 7, 0.9)]


def test_postings_and_topk_broadcast_nothing(spark):
    texts = spark.createDataFrame([(1, "b", "alpha beta"), (2, "b", "beta")], "item long, brand string, text string")
    needles = spark.createDataFrame([(5, "b", "beta", "beta", 1.0), (5, "b", "alpha b", "alpha b", 1.0)], "query_id long, brand string, needle string, part string, weight double")
    hits = substring_hits(texts, ["item", "brand"], "text", needles.select("brand", "needle"), ("brand",))
    assert "Broadcast" not in plan(hits)
    p = durable(hits)
    score = topk.held_weight(needles, p, ["brand"])
    assert "Broadcast" not in plan(topk.rare_first(needles, p, ["brand"]))
    assert "Broadcast" not in plan(topk.best(needles, p, score, 1, ["brand"]))
    assert {(r.query_id, r.item, r.score) for r in topk.best(needles, p, score, 1, ["brand"]).collect()} == {(5, 1, 2.0)}
