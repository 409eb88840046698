"""Reranking without texts in the result equals reranking the pool."""

from claimloom.operators import retrieval as rt


def test_rerank_ranked_equals_rerank_of_the_pool(spark):
    ranked = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.5, 2), (2, 11, 0.4, 1)], "claim_id long, passage_id long, similarity double, rank int")
    passages = spark.createDataFrame([(10, 1, 1, "nothing"), (11, 2, 1, "relapse fell by 12%"), (12, 3, 1, "unasked")], "passage_id long, reference_id long, page int, passage_text string")
    claims = spark.createDataFrame([(1, "relapse fell"), (2, "12 patients")], "claim_id long, text string")
    want = rt.rerank_hybrid(rt.rank_pool(ranked, passages, 1, 2), claims).drop("passage_text")
    got = rt.rerank_ranked(ranked, passages, claims, 1, 2).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
