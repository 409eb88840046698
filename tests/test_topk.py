"""Early termination over posting lists: results against brute force, and how few rows meet."""

import math
import random

from pyspark.sql import functions as F

from claimloom.operators import citations as ct
from claimloom.operators import retrieval as rt
from claimloom.operators import topk
from claimloom.session import durable


def plain(needles, postings, k):
    held, out = {}, set()
    for brand, needle, item in postings:
        held.setdefault((brand, item), set()).add(needle)
    for q in {n[0] for n in needles}:
        mine = [(b, n, w) for x, b, n, _, w in needles if x == q]
        scores = {}
        for b, item in held:
            s = sum(w for brand, n, w in mine if brand == b and n in held[b, item])
            if s > 0:
                scores[item] = s
        for rank, item in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k], 1):
            out.add((q, item, scores[item], rank))
    return out


def frames(spark, needles, postings):
    n = spark.createDataFrame(needles, "query_id long, brand string, needle string, part string, weight double")
    return n, durable(spark.createDataFrame(postings, "brand string, needle string, item long"))


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    needles = [(q, "ab"[q % 2], w, w, 1.0) for q in range(30) for w in rnd.sample(words, rnd.randint(1, 6))]
    postings = [(b, w, i) for b in "ab" for i in range(40) for w in words if rnd.random() < (int(w[1:]) + 1) / 13]
    n, p = frames(spark, needles, postings)
    for k in (1, 5, 100):
        got = topk.best(n, p, topk.held_weight(n, p, ["brand"]), k, ["brand"])
        assert {(r.query_id, r.item, r.score, r["rank"]) for r in got.collect()} == plain(needles, postings, k)


def test_a_word_of_every_document_and_claim_is_not_expanded(spark):
    docs, claims, k = 2000, 300, 5
    postings = [("a", w, i) for i in range(docs) for w in ("the", "study")] + [("a", f"rare{i % 50}", i) for i in range(0, docs, 3)]
    needles = [(q, "a", w, w, 1.0) for q in range(claims) for w in ("the", "study", *([f"rare{q % 50}"] if q % 2 else []))]
    n, p = frames(spark, needles, postings)
    score = topk.held_weight(n, p, ["brand"])
    ordered = durable(topk.rare_first(n, p, ["brand"]))
    first = topk.seed_pairs(ordered, p, k, ["brand"])
    assert first.count() <= claims * 3 * k
    later = topk.open_pairs(ordered, p, durable(score(first)), k, ["brand"])
    # all pairs are 600,000; claims with a rare word meet its list, the others next to nothing
    assert later.count() <= claims * (docs // 50)
    got = topk.best(n, p, score, k, ["brand"])
    assert {(r.query_id, r.item, r.score, r["rank"]) for r in got.collect()} == plain(needles, postings, k)


def test_keyword_prefilter_with_a_hot_word(spark):
    rnd = random.Random(6)
    words = [f"{a}{b}{c}x" for a in "bcd" for b in "aeo" for c in "lmn"]
    refs = [(i, "ab"[i % 2], "common " + " ".join(rnd.sample(words, 5))) for i in range(60)]
    claims = [(i, "ab"[i % 2], "common " + " ".join(rnd.sample(words, 3)) + (" common" if i % 3 else " ")) for i in range(25)] + [(90, "a", "common"), (91, "a", "of"), (92, "z", "common")]
    got = rt.keyword_prefilter(spark.createDataFrame(claims, "claim_id long, brand string, text string"), spark.createDataFrame(refs, "reference_id long, brand string, content_text string"))
    want = set()
    for c, brand, text in claims:
        kw = {w for w in text.split() if len(w) > 2}
        scores = {r: sum(w in t for w in kw) / len(kw) for r, b, t in refs if b == brand and kw}
        best = sorted((r for r in scores if scores[r] > 0), key=lambda r: (-scores[r], r))[:5]
        want |= {(c, r, round(scores[r], 9), n) for n, r in enumerate(best, 1)}
    assert {(r.claim_id, r.reference_id, round(r.score, 9), r["rank"]) for r in got.collect()} == want


def test_fact_keywords_with_a_hot_word(spark):
    rnd = random.Random(8)
    words = [f"{a}{b}q" for a in "bcdfg" for b in "aeiou"]
    facts = [(i % 30, "a", i, "", ["common", *rnd.sample(words, rnd.choice([0, 1, 2, 4]))]) for i in range(120)]
    claims = [(i, "a", "common " + " ".join(rnd.sample(words, 10))) for i in range(40)]
    votes = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(30)]
    got = rt.fact_keyword_tier(
        spark.createDataFrame(claims, "claim_id long, brand string, text string"),
        spark.createDataFrame(facts, "reference_id long, brand string, fact_no int, text string, keywords array<string>"),
        spark.createDataFrame(votes, "reference_id long, confirmed long, rejected long"))
    want = set()
    for c, _, text in claims:
        best = []
        for r, _, no, _, kw in facts:
            _, yes, no_votes = votes[r]
            weight = 1.1 if yes and not no_votes else 0.8 if no_votes > yes else 1.0
            share = sum(w in text for w in set(kw)) / len(set(kw))
            if round(share * weight, 9) >= 0.75:
                best.append((-round(share * weight, 9), r, no))
        if best:
            want.add((c, min(best)[1], min(best)[2]))
    assert {(r.claim_id, r.reference_id, r.fact_no) for r in got.collect()} == want


def test_citations_whose_parts_all_documents_share(spark):
    """Year, volume and journal are everywhere; author and the tie by id decide."""
    refs = [(i, "b", f"Author{chr(97 + i % 26)}{chr(97 + i // 26)} Brain", "Published 2001 vol 12") for i in range(300)]
    cites = [(str(i), "b", f"Author{chr(97 + i % 26)}{chr(97 + i // 26)} AB et al. Brain. 2001;12(3):7-9.") for i in range(0, 300, 7)] + [("x", "b", "Nobody AB et al. Brain. 2001;12(3):7-9.")]
    df = spark.createDataFrame(cites, "citation_id string, brand string, citation_text string")
    got = {r.citation_id: r.reference_id for r in ct.best_citation(df, spark.createDataFrame(refs, "reference_id long, brand string, display_alias string, content_text string")).collect()}
    assert got == {**{str(i): i for i in range(0, 300, 7)}, "x": 0}
    parsed = df.withColumn("p", ct.parse_citation(F.col("citation_text")))
    needles = ct.citation_needles(parsed)
    assert abs(max(r.w for r in needles.groupBy("query_id").agg(F.sum("weight").alias("w")).collect()) - 1.0) < 1e-9


def test_average_durations_do_not_depend_on_the_order_of_rows(spark):
    from claimloom.operators import reports as rp

    # 15.0 over six rows rounds up to 3; as doubles in this order the average is 2.4999999999999996
    values = [4.27, 5.79, 2.59, 1.34, 0.09, 0.92]
    for rows in (values, values[::-1], [*values, None]):
        df = spark.createDataFrame([(1, v) for v in rows], "run int, ms double").coalesce(1)
        assert rp.duration_summary(df, ["run"]).head().avg == 3
    # too small or too large for the decimals
    df = spark.createDataFrame([(1, 1e-30), (1, 3.0), (2, 1e25), (2, 1e25), (3, 9e17), (3, 9e17), (4, math.inf)], "run int, ms double")
    assert {r.run: r.s for r in df.groupBy("run").agg(rp.exact_sum(df.ms).alias("s")).collect()} == {1: 3.0, 2: 2e25, 3: 1.8e18, 4: math.inf}
