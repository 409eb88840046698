"""Counts of needles in blocks against brute force."""

import random

from pyspark.sql import functions as F

from claimloom.operators import retrieval as rt


def table(spark, rows, columns):
    """Rows that a plan shows as a local table."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def test_keywords_are_counted_without_listing_pairs_or_storing_postings(spark):
    rnd = random.Random(3)
    words = [a + b + c for a in "bcd" for b in "aeo" for c in ("l", "m", "lm", "lmn")]
    refs = [(i % 50, "ab"[i % 2], "Common " + " ".join(rnd.sample(words, 8)) + "-x") for i in range(60)]
    claims = [(i, "ab"[i % 2], "common " + " ".join(rnd.sample(words, 4))) for i in range(30)]
    texts = table(spark, [f"({r}L, '{b}', '{t}')" for r, b, t in refs] + ["(70L, 'a', NULL)", "(71L, NULL, 'common')"], "reference_id, brand, content_text")
    asked = table(spark, [f"({c}L, '{b}', '{t}')" for c, b, t in claims] + ["(80L, 'a', NULL)", "(81L, NULL, 'common')"], "claim_id, brand, text")
    got = rt.keyword_prefilter(asked, texts, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan  # stored postings
    assert "Generate explode(array_distinct(filter(split" not in plan  # a row per word
    want = set()
    for c, b, t in claims:
        kw = t.split()
        held = {r: sum(any(w in x.lower() for q, y, x in refs if (q, y) == (r, b)) for w in kw) for r, y, _ in refs if y == b}
        best = sorted((r for r in held if held[r]), key=lambda r: (-held[r], r))[:3]
        want |= {(c, r, held[r] / len(kw), n) for n, r in enumerate(best, 1)}
    assert {(r.claim_id, r.reference_id, r.score, r["rank"]) for r in got.collect()} == want


def test_blocks_of_any_size_agree(spark):
    from claimloom.operators.holding import best_held

    rnd = random.Random(4)
    names = [f"w{i}" for i in range(30)]
    items = [(i, "s", ws := rnd.sample(names, rnd.randint(1, 12)), sum(map(len, ws))) for i in range(80)]
    queries = [(i, "s", rnd.sample(names, 6) + [names[0]] * (300 if i == 7 else 0)) for i in range(40)]
    i = spark.createDataFrame(items, "item long, scope string, words array<string>, chars long")
    q = spark.createDataFrame(queries, "query_id long, scope string, needles array<string>")
    for inside in (True, False):
        want = set()
        for n, _, needles in queries:
            hits = {k: sum(any(x in w for w in ws) if inside else x in ws for x in needles) for k, _, ws, _ in items}
            best = sorted((k for k in hits if hits[k]), key=lambda k: (-hits[k], k))[:4]
            want |= {(n, k, hits[k], r) for r, k in enumerate(best, 1)}
        for size in ({}, {"block_queries": 7, "block_chars": 200}):
            got = best_held(q, i, 4, ["scope"], inside, **size)
            assert {(r.query_id, r.item, r.hits, r["rank"]) for r in got.collect()} == want
    assert best_held(q.filter("false"), i, 4, ["scope"]).isEmpty() and best_held(q, i.filter("false"), 4, ["scope"]).isEmpty()
    assert best_held(q, i.withColumn("words", F.expr("CAST(NULL AS ARRAY<STRING>)")), 4, ["scope"]).isEmpty()


def test_best_citations_are_those_of_all_pairs(spark):
    from claimloom.operators import citations as ct

    rnd = random.Random(5)
    names, journals = [f"Autor{c}" for c in "abcdefgh"], ["Brain", "Nat Rev", "Muscle Nerve"]
    refs = [(i, "ab"[i % 2], f"{rnd.choice(names)} {rnd.choice(journals)}", f"Published {rnd.choice([2001, 2002])} vol {rnd.choice([5, 12])} gamma delta") for i in range(60)]
    refs += [(100, "a", "Ref 100", "alpha\u00a0beta epsilon"), (101, "a", "Ref 101", "epsilon")]
    cites = [(str(i), "ab"[i % 2], f"{rnd.choice(names + ['Nobody'])} AB et al. {rnd.choice(journals)}. {rnd.choice([2001, 2003])};{rnd.choice([5, 12])}(3):7-9.") for i in range(40)]
    # no part of its own: the words count, also one that a wider blank holds together
    cites += [("w", "a", "alpha\u00a0beta gammadelta"), ("g", "b", "gamma delta gamma omega"), ("short", "a", "brain"), ("none", "a", "nothing shared")]
    df = spark.createDataFrame(cites, "citation_id string, brand string, citation_text string")
    rf = spark.createDataFrame(refs, "reference_id long, brand string, display_alias string, content_text string")
    pairs = df.withColumn("p", ct.parse_citation(F.col("citation_text"))).filter("p IS NOT NULL").join(rf.withColumn("head", ct.reference_head(rf.display_alias, rf.content_text)), "brand")
    scored = pairs.withColumn("s", ct.score_citation(F.col("p"), F.col("head"))).filter("s > 0").collect()
    for least in (0.0, 0.6):
        want = {}
        for r in sorted(scored, key=lambda r: (-r.s, r.reference_id)):
            if r.s >= least:
                want.setdefault(r.citation_id, (r.reference_id, r.s))
        assert {r.citation_id: (r.reference_id, r.confidence) for r in ct.best_citation(df, rf, least).collect()} == want
        assert (want.get("w") == (100, 0.5)) == (least == 0.0)


def test_facts_of_frequent_keywords_meet_claims_in_blocks(spark):
    rnd = random.Random(9)
    common, rare = ["alpha", "beta", "alpha beta"], [f"w{c}{d}" for c in "abcdef" for d in "gh"]
    facts = [(i % 20, "ab"[i % 2], i, rnd.sample(common, rnd.randint(0, 3)) + rnd.sample(rare, rnd.randint(1, 3))) for i in range(90)] + [(21, "a", 0, ["beta", "alpha"]), (3, None, 0, ["beta"])]
    claims = [(i, "ab"[i % 2], " ".join(rnd.sample(["Alpha beta", "beta"], 1) + rnd.sample(rare, 4))) for i in range(30)] + [(40, "a", None), (41, "b", "nothing")]
    votes = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(20)]
    got = rt.fact_keyword_tier(
        spark.createDataFrame(claims, "claim_id long, brand string, text string"),
        spark.createDataFrame(facts, "reference_id long, brand string, fact_no int, keywords array<string>"),
        spark.createDataFrame(votes, "reference_id long, confirmed long, rejected long"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "needle#" not in plan  # no row per keyword
    want = {}
    for c, brand, text in claims:
        for r, b, no, kw in facts:
            yes, no_votes = votes[r][1:] if r < 20 else (0, 0)
            weight = 1.1 if yes and not no_votes else 0.8 if no_votes > yes else 1.0
            share = sum(w in text.lower() for w in kw) / len(kw) if text and b == brand else 0
            if round(share * weight, 9) >= 0.75:
                want[c] = min(want.get(c, (0, 0, 0)), (-round(share * weight, 9), r, no))
    assert {(r.claim_id, -r.score, r.reference_id, r.fact_no) for r in got.collect()} == {(c, *x) for c, x in want.items()} and want
