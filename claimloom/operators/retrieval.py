"""Passage retrieval, hybrid rerank and the tier cascade (survey group K).

Column contract: claims have claim_id, brand, text and, where vectors are used, embedding; passages have
passage_id, reference_id, brand, passage_text and embedding.  Similarities are rounded to 9 places before
they rank rows, so the order does not hang on the summation order of a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as tx
from claimloom.functions import vectors as vx
from claimloom.operators.holding import Held, Pick, best_held, blocks
from claimloom.operators.joins import fetch, salted_join, shuffled
from claimloom.operators.nearest import RANK_DIGITS, knn, knn_lsh, knn_shared, top_rows  # noqa: F401
from claimloom.operators.postings import distinct_words
from claimloom.session import durable


def knn_within(claims: DataFrame, passages: DataFrame, scope: DataFrame, pool: int = config.CANDIDATE_POOL) -> DataFrame:
    """Nearest passages of a claim among the references named for it in ``scope`` (claim_id, reference_id)."""
    wanted = scope.select("claim_id", "reference_id").distinct().join(
        claims.select("claim_id", F.col("brand").alias("c_brand"), F.col("embedding").alias("c_vec")), "claim_id"
    )
    rows = passages.select("passage_id", "reference_id", "brand", "embedding").filter(F.col("embedding").isNotNull())
    pairs = fetch(wanted, rows, ["reference_id"]).filter(F.col("brand") == F.col("c_brand"))
    scored = pairs.select("claim_id", "passage_id", F.round(vx.cosine(F.col("c_vec"), F.col("embedding")), RANK_DIGITS).alias("similarity"))
    return top_rows(scored, pool)


def scoped_knn(claims: DataFrame, passages: DataFrame, scope: DataFrame | list[str], pool: int = config.CANDIDATE_POOL) -> DataFrame:
    """Narrowed search where a scope exists and is not empty, the whole brand for the other claims.

    ``scope`` lists claims and references (claim_id, reference_id), or names the columns on which claims and passages of one scope
    agree; the second needs no pairs and suits wide scopes.
    """
    found = knn_shared(claims, passages, scope, pool) if isinstance(scope, list) else knn_within(claims, passages, scope, pool)
    narrowed = durable(found)
    rest = claims.join(narrowed.select("claim_id").distinct(), "claim_id", "left_anti")
    return narrowed.withColumn("scoped", F.lit(True)).unionByName(
        knn(rest, passages, pool).withColumn("scoped", F.lit(False))
    )


def rank_pool(ranked: DataFrame, passages: DataFrame, k: int, pool: int) -> DataFrame:
    """Mark the top k of the pool and fetch texts for pool rows only."""
    size = max(k, pool)
    kept = ranked.filter(F.col("rank") <= size).withColumn("is_top_k", F.col("rank") <= k)
    info = passages.select("passage_id", "reference_id", "page", "passage_text")
    return fetch(kept, info, ["passage_id"])


def share_contained(needles: Column, text: Column) -> Column:
    """Share of needles that occur in the lower-cased text; 0 where there are none."""
    hits = tx.bind(F.lower(text), lambda t: F.size(F.filter(needles, lambda n: F.contains(t, n))))
    return F.when((F.size(needles) == 0) | text.isNull(), 0.0).otherwise(hits / F.size(needles))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _terms(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", tx.keywords(F.col("text")).alias("kw"), tx.numeric_tokens(F.col("text")).alias("nums"))


def _score_overlaps(rows: DataFrame, weights: dict) -> DataFrame:
    """Hybrid score of pool rows that carry the terms of their claim and the passage text."""
    scored = (
        rows.withColumn("semantic_score", clamp01(F.col("similarity")))
        .withColumn("keyword_overlap", share_contained(F.col("kw"), F.col("passage_text")))
        .withColumn("numeric_overlap", share_contained(F.col("nums"), F.col("passage_text")))
        .drop("kw", "nums")
    )
    hybrid = (
        F.col("semantic_score") * weights["semantic"]
        + F.col("keyword_overlap") * weights["keyword"]
        + F.col("numeric_overlap") * weights["numeric"]
    )
    return scored.withColumn("hybrid_score", F.round(clamp01(hybrid), RANK_DIGITS))


def rerank_hybrid(pool: DataFrame, claims: DataFrame, weights: dict = config.HYBRID_WEIGHTS) -> DataFrame:
    """Hybrid score of pool rows (with passage_text) and their new order."""
    return order_hybrid(_score_overlaps(pool.join(_terms(claims), "claim_id"), weights))


def rerank_ranked(ranked: DataFrame, passages: DataFrame, claims: DataFrame, k: int, pool: int, weights: dict = config.HYBRID_WEIGHTS) -> DataFrame:
    """``rank_pool`` and ``rerank_hybrid`` without the texts in the result: the terms of a claim travel to the texts, so that a text is
    shuffled once however many claims it answers, and only scores are ordered."""
    kept = ranked.filter(F.col("rank") <= max(k, pool)).withColumn("is_top_k", F.col("rank") <= k)
    info = passages.select("passage_id", "reference_id", "page", "passage_text").join(ranked.select("passage_id").distinct(), "passage_id", "left_semi")
    rows = kept.join(_terms(claims), "claim_id").join(info, "passage_id")
    return order_hybrid(_score_overlaps(rows, weights).drop("passage_text"))


def rerank_semantic(pool: DataFrame) -> DataFrame:
    """Semantic order only: overlaps 0, hybrid equals semantic."""
    return order_hybrid(
        pool.withColumn("semantic_score", clamp01(F.col("similarity")))
        .withColumn("keyword_overlap", F.lit(0.0))
        .withColumn("numeric_overlap", F.lit(0.0))
        .withColumn("hybrid_score", clamp01(F.col("similarity")))
    )


def order_hybrid(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("claim_id").orderBy(F.desc("hybrid_score"), F.desc("semantic_score"), F.asc("rank"))
    return scored.withColumn("hybrid_rank", F.row_number().over(w))


def group_by_reference(reranked: DataFrame, max_refs: int = config.MAX_REFERENCES) -> DataFrame:
    """Best passage per reference, then the first ``max_refs`` references of each claim."""
    best = reranked.groupBy("claim_id", "reference_id").agg(
        F.min(F.struct("hybrid_rank", "hybrid_score", "semantic_score", "passage_id")).alias("b")
    )
    w = Window.partitionBy("claim_id").orderBy(F.desc("best_hybrid"), F.asc("hybrid_rank"))
    return (
        best.select(
            "claim_id", "reference_id", F.col("b.hybrid_rank"), F.col("b.hybrid_score").alias("best_hybrid"),
            F.col("b.semantic_score").alias("best_semantic"), F.col("b.passage_id"),
        )
        .withColumn("ref_rank", F.row_number().over(w))
        .filter(F.col("ref_rank") <= max_refs)
        .drop("hybrid_rank")
    )


def search_facts(claims: DataFrame, fact_sets: DataFrame, k: int = 5) -> DataFrame:
    """Top fact sets per claim by cosine: claim_id, reference_id, similarity, rank."""
    sets = fact_sets.select(F.col("reference_id").alias("passage_id"), "brand", "embedding")
    return knn(claims, sets, k).withColumnRenamed("passage_id", "reference_id")


def fact_anchor(claims: DataFrame, fact_sets: DataFrame, min_similarity: float = config.FACT_MIN_SIMILARITY,
                min_keywords: int = config.FACT_MIN_KEYWORDS) -> DataFrame:
    """Claims anchored in the facts of their nearest fact set, with the best fact of the set."""
    # read for the search and again for the texts: mined facts are dear
    fact_sets = durable(fact_sets.select("reference_id", "brand", "embedding", "facts"))
    top = search_facts(claims, fact_sets, 1).filter(F.col("similarity") >= min_similarity)
    terms = claims.select("claim_id", tx.keywords(F.col("text")).alias("kw"), tx.numeric_tokens(F.col("text")).alias("nums"))
    rows = fetch(top.join(terms, "claim_id"), fact_sets.select("reference_id", "facts"), ["reference_id"])
    joined = F.lower(F.array_join(F.transform("facts", lambda f: F.coalesce(f["text"], F.lit(""))), " "))

    def hits(needles: Column, text: Column) -> Column:
        return tx.bind(text, lambda t: F.size(F.filter(needles, lambda n: F.contains(t, n))))

    scored = F.transform(
        "facts",
        lambda f, i: F.struct(
            hits(F.col("kw"), F.lower(f["text"])).alias("score"), (-i).alias("order"), f["page"].alias("page"),
            f["text"].alias("text"),
        ),
    )
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))
    out = (
        rows.withColumn("keyword_hits", hits(F.col("kw"), joined))
        .withColumn("numeric_hits", hits(F.col("nums"), joined))
        .filter((F.col("keyword_hits") >= min_keywords) | (F.col("numeric_hits") > 0))
        .withColumn("best", best)
    )
    return out.select(
        "claim_id", "reference_id", "similarity", "keyword_hits", "numeric_hits", F.col("best.page").alias("page"),
        F.coalesce(F.col("best.text"), F.get("facts", F.lit(0))["text"]).alias("excerpt"),
    )


def keyword_needles(claims: DataFrame) -> DataFrame:
    """query_id, brand, needle, n_kw of the keywords of each claim."""
    kw = claims.select(F.col("claim_id").alias("query_id"), "brand", tx.keywords(F.col("text")).alias("kw")).filter(F.size("kw") > 0)
    return kw.select("query_id", "brand", F.size("kw").alias("n_kw"), F.explode("kw").alias("needle"))


def _best_holders(needles: DataFrame, items: DataFrame, k: int, inside: bool) -> DataFrame:
    """The k items that hold most keywords of a claim; counts are whole numbers until the share is taken."""
    asked = needles.groupBy("query_id", "brand").agg(F.collect_list("needle").alias("needles"))
    sizes = needles.select("query_id", "n_kw").distinct()
    return best_held(asked, items, k, ["brand"], inside).join(sizes, "query_id").select(
        F.col("query_id").alias("claim_id"), F.col("item").alias("reference_id"), (F.col("hits") / F.col("n_kw")).alias("score"), "rank"
    )


def best_by_keywords(needles: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """claim_id, reference_id, score, rank: the k references that hold most of a claim's keywords.

    postings: brand, needle, reference_id.  Keywords that nearly every reference holds do not list every pair (see holding.py).
    """
    # one group is the asked keywords of one reference
    held = postings.groupBy("brand", F.col("reference_id").alias("item")).agg(F.collect_set("needle").alias("words"), F.sum(F.length("needle")).alias("chars"))
    return _best_holders(needles, held, k, False)


def keyword_prefilter(claims: DataFrame, references: DataFrame, k: int = 5) -> DataFrame:
    """References of the brand that share keywords with a claim, best ``k`` by share."""
    text = F.col("content_text")
    items = references.select("brand", F.col("reference_id").alias("item"), distinct_words(text).alias("words"), F.length(text).alias("chars"))
    return _best_holders(keyword_needles(claims), items, k, True)


def semantic_fallback(reranked: DataFrame, min_semantic: float = config.FALLBACK_MIN_SEMANTIC,
                      min_hybrid: float = config.FALLBACK_MIN_HYBRID, min_margin: float = config.FALLBACK_MIN_MARGIN,
                      bypass: float = config.FALLBACK_BYPASS) -> DataFrame:
    """Best passage of a claim where its scores and its lead over the runner-up pass the gates."""
    w = Window.partitionBy("claim_id").orderBy("hybrid_rank")
    top = (
        reranked.filter(F.col("hybrid_rank") <= 2)
        .withColumn("runner_up", F.lead("hybrid_score").over(w))
        .filter(F.col("hybrid_rank") == 1)
        .withColumn("margin", F.round(F.col("hybrid_score") - F.coalesce("runner_up", F.lit(0.0)), RANK_DIGITS))
    )
    s, h = F.col("semantic_score"), F.col("hybrid_score")
    gate = (s >= min_semantic) | (h >= min_hybrid)
    lead = (F.col("margin") >= min_margin) | (s >= min_semantic + bypass) | (h >= min_hybrid + bypass)
    return top.filter(gate & lead).drop("runner_up")


def match_distinct(claims: DataFrame, match, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Match each distinct claim once and copy the result to its duplicates.

    ``match`` maps claims to rows with claim_id.  Returns the matched rows of all claims and one row of counts.
    ``key`` names further columns that make two claims different (page, region, reference numbers).
    """
    keyed = claims.withColumn("memo", F.sha2(F.concat_ws("\x1f", tx.norm_memo(F.col("text")), *[
        F.col(k).cast("string") for k in ["brand", *(key or [])]]), 256))
    first = keyed.groupBy("memo").agg(F.min("claim_id").alias("claim_id"))
    unique = keyed.join(first.select("claim_id"), "claim_id", "left_semi")
    results = match(unique.drop("memo"))
    by_memo = results.join(first, "claim_id").withColumnRenamed("claim_id", "source_claim_id")
    out = salted_join(keyed.select("claim_id", "memo"), by_memo, ["memo"], ["claim_id"]).drop("memo")
    per_memo = keyed.groupBy("memo").agg(F.count("*").alias("n"))
    counts = per_memo.agg(
        F.sum("n").alias("total_claims"), F.count("*").alias("unique_claims"),
        F.sum(F.col("n") - 1).alias("duplicate_claims"),
    )
    return out, counts


def apply_match_confidence(matched: DataFrame, limit: float = 0.90) -> DataFrame:
    """Lower the claim confidence to the match confidence of weak matches."""
    lowered = clamp01(F.least("confidence", "match_confidence"))
    weak = F.col("matched") & (F.col("match_confidence") < limit) & F.col("confidence").isNotNull()
    return matched.withColumn("confidence", F.when(weak, lowered).otherwise(F.col("confidence")))


def _pick_facts(min_share: float) -> Pick:
    """Of each claim the fact set of the block that scores best; of equal ones the first.

    Claims without a rare keyword of a set are looked at only where its frequent ones could be enough.
    """

    def pick(held: Held, sets: pa.Table, needles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, of, shared = np.zeros(held.n), np.full(held.n, -1), np.zeros(held.n, np.int64)
        n_kw, wanted, weight = (sets[c].to_pylist() for c in ("n_kw", "wanted", "weight"))
        starts, sizes = (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()
        order = pc.sort_indices(sets, sort_keys=[("reference_id", "ascending"), ("fact_no", "ascending")], null_placement="at_start")
        for q in order.to_pylist():
            codes = needles[starts[q] : starts[q] + sizes[q]].tolist()
            rare = [j for j in codes if held.rare(j)]
            if sizes[q] - len(rare) >= wanted[q]:
                near = np.arange(held.n)
                hits = held.add(codes, np.zeros(held.n, np.int32))
            elif rare:
                near = np.unique(np.concatenate([held.of(j) for j in rare]))
                hits = held.among(codes, near)
            else:
                continue
            enough = np.flatnonzero(hits >= wanted[q])
            near, hits = near[enough], hits[enough]
            score = np.round(hits / n_kw[q] * weight[q], RANK_DIGITS)
            better = (score >= min_share) & (score > best[near])
            best[near[better]], of[near[better]], shared[near[better]] = score[better], q, hits[better]
        some = np.flatnonzero(of >= 0)
        return of[some], some, shared[some]

    return pick


def fact_keyword_tier(claims: DataFrame, facts: DataFrame, feedback: DataFrame, min_share: float = 0.75) -> DataFrame:
    """Facts whose keywords mostly occur in a claim, weighted by reviewer feedback on the fact set.

    facts: reference_id, brand, fact_no, text, keywords; feedback: reference_id, confirmed, rejected.

    Facts of one brand, keyword set and weight score alike, so the first of them stands for all.  Sets and claims meet in blocks (see
    holding.py), and a block passes on the best set of each claim.
    """
    weight = (
        F.when((F.col("confirmed") > 0) & (F.col("rejected") == 0), 1.1)
        .when(F.col("rejected") > F.col("confirmed"), 0.8)
        .otherwise(1.0)
    )
    rows = facts.withColumn("keywords", F.array_sort(F.array_distinct("keywords"))).filter(F.size("keywords") > 0)
    rows = rows.join(feedback, "reference_id", "left").na.fill({"confirmed": 0, "rejected": 0}).withColumn("weight", weight)
    sets = rows.groupBy("brand", "keywords", "weight").agg(F.min(F.struct("reference_id", "fact_no")).alias("first"))
    n = F.size("keywords")
    sets = durable(sets.select(F.md5(F.concat_ws("\x1f", "brand", F.col("weight").cast("string"), "keywords")).alias("set_id"), "brand", "weight", "first", "keywords", n.alias("n_kw"),
                               F.ceil(F.lit(min_share) / F.col("weight") * n - 1e-9).cast("int").alias("wanted")).filter("wanted <= n_kw"))
    queries = sets.select(F.col("set_id").alias("query_id"), "brand", F.array_compact("keywords").alias("needles"), "weight", "n_kw", "wanted", "first.*")
    # a keyword may be two words
    texts = claims.filter(F.col("text").isNotNull()).select(F.col("claim_id").alias("item"), "brand", F.array(F.lower(F.col("text"))).alias("words"), F.length("text").alias("chars"))
    hits = blocks(queries, texts, _pick_facts(min_share), ["brand"]).select(F.col("query_id").alias("set_id"), F.col("item").alias("claim_id"), "hits")
    scored = hits.join(shuffled(sets.select("set_id", "n_kw", "weight", "first")), "set_id").withColumn("share", F.col("hits") / F.col("n_kw")).withColumn(
        "score", F.round(F.col("share") * F.col("weight"), RANK_DIGITS)).filter(F.col("score") >= min_share)
    best = scored.groupBy("claim_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("first"), F.col("share"))).alias("b"))
    return best.select("claim_id", "b.first.reference_id", "b.first.fact_no", "b.share", (-F.col("b.s")).alias("score"))


def select_candidate(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate a model response names: the only one, by 1-based index, by name, or by contained name.

    responses: claim_id, matched, reference_index, reference_name; candidates: claim_id, position, name, reference_id.
    """
    sizes = candidates.groupBy("claim_id").agg(F.count("*").alias("n"))
    digits = F.regexp_extract(tx.text_or_empty(F.col("reference_index")), r"\d+", 0).try_cast("int")
    wanted = tx.norm_alias(F.col("reference_name"))
    rows = (
        responses.filter("matched")
        .join(sizes, "claim_id")
        .withColumn("idx", F.when((digits >= 1) & (digits <= F.col("n")), digits))
        .withColumn("wanted", wanted)
        .join(candidates, "claim_id")
    )
    name = tx.norm_alias(F.col("name"))
    tier = (
        F.when(F.col("n") == 1, 0)
        .when(F.col("idx").isNotNull(), F.when(F.col("idx") == F.col("position"), 1))
        .when(F.col("wanted") == "", None)
        .when(name == F.col("wanted"), 2)
        .when(F.contains(name, F.col("wanted")) | F.contains(F.col("wanted"), name), 3)
    )
    w = Window.partitionBy("claim_id").orderBy("tier", "position")
    return (
        rows.withColumn("tier", tier).filter("tier IS NOT NULL")
        .withColumn("rn", F.row_number().over(w)).filter("rn = 1")
        .select("claim_id", "reference_id", "position", "tier")
    )
