"""Claim de-duplication: literal cases, and the walk against a plain model."""

import random

from pyspark.sql import functions as F

from claimloom.functions import unicode as un
from claimloom.operators import dedup as dd

SCHEMA = "doc long, page int, ord long, claim_id string, text string, region string, ref_numbers array<int>, confidence double, x double, y double"


def rows(spark, items):
    return spark.createDataFrame([(1, p, i, f"claim_{i + 1:03d}", t, None, None, 0.9, 1.0, 1.0) for i, (p, t) in enumerate(items)], SCHEMA)


def kept(spark, items, **kw):
    return sorted(r.claim_id for r in dd.dedup_claims(rows(spark, items), **kw).collect())


def test_literal_cases(spark):
    assert kept(spark, [(1, "Patients achieved a 47% reduction†"), (1, "“Patients achieved a 47% reduction.”")]) == ["claim_002"]
    assert len(kept(spark, [(1, "Common safety profile"), (2, "Common safety profile")])) == 2
    assert len(kept(spark, [(3, "46% reduction in events"), (3, "32% fewer discontinuations")])) == 2
    long = "Drug X demonstrated a 42% reduction in annualized relapse rate versus placebo in adults with relapsing disease."
    assert kept(spark, [(2, "Reduction in annualized relapse rate vs placebo"), (2, long)]) == ["claim_002"]
    base = "Drug X improved response rate versus placebo"
    assert kept(spark, [(4, base), (4, base + " (p<0.01; 95% CI 1.2-2.4; N=314).")]) == ["claim_002"]
    conflict = [(1, "Drug X reduced risk by 42% vs placebo (p<0.01)."), (1, "Drug X reduced risk by 28% vs placebo (p=0.04).")]
    assert len(kept(spark, conflict)) == 2
    pair = [(5, "Drug X improved outcomes versus placebo."), (5, "Drug X improved outcomes vs placebo in adults.")]
    assert len(kept(spark, pair, strategy="exact")) == 2


def test_dedup_form(spark):
    df = spark.createDataFrame([("Patients​ achieved⁠ a 47% reduction",), ("Patients achieved a 47% reduction",)], "t string")
    assert len({r[0] for r in df.select(un.norm_dedup(F.col("t"))).collect()}) == 1


def test_walk_equals_the_plain_loop(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    items = [(rnd.randint(1, 3), " ".join(rnd.choices(words, k=rnd.randint(3, 9)))) for _ in range(150)]
    exact = dd.dedup_exact(dd.features(rows(spark, items))).cache()
    got = sorted((r.page, r.claim_id, r.pos) for r in dd.dedup_near(exact).collect())
    rules = dd.near_rules()
    feats = sorted(exact.collect(), key=lambda r: (r.page, r.pos))

    def same(a, b):
        ta, tb = set(a.key_text.split()), set(b.key_text.split())
        s = len(ta & tb)
        o, j = s / min(len(ta), len(tb)), s / len(ta | tb)
        c = a.key_text in b.key_text or b.key_text in a.key_text
        return any((c or not n) and s >= k and abs(len(ta) - len(tb)) >= d and o >= mo and j >= mj for n, k, d, mo, mj in rules)

    slots = []
    for r in feats:
        for slot in slots:
            if slot[0].page == r.page and same(slot[0], r):
                if tuple(r.pref)[:4] > tuple(slot[0].pref)[:4]:
                    slot[0] = r
                break
        else:
            slots.append([r, r.pos])
    assert got == sorted((s[0].page, s[0].claim_id, s[1]) for s in slots)


def test_a_crowded_page_is_many_components(spark):
    """10^5 claims of one page hold one common token; only the planted pairs share a rare one."""
    n = 100_000
    df = spark.range(n).selectExpr(
        "1L AS doc", "1 AS page", "id AS ord",
        "concat('common w', id, 'a ', CASE WHEN id >= 99000 THEN array_join(transform(sequence(1, 5), i -> concat('p', i, 'x', id div 2)), ' ') ELSE concat('w', id, 'b w', id, 'c') END) AS key_text")
    parts = dd.partner_components(df, dd.min_overlap(0.85, 0.72))
    sizes = {r["count"] for r in parts.groupBy("component").count().collect()}
    assert parts.count() == 1000 and sizes == {2}


def test_components_join_whatever_shares_a_key(spark):
    from claimloom.operators.components import components

    rnd = random.Random(1)
    edges = [(g, i, rnd.randint(0, 60)) for g in (1, 2) for i in range(60) for _ in range(rnd.choice([1, 1, 2]))] + [(3, i, i // 2 * 2 + d) for i in range(400) for d in (0, 1 + i % 2)]
    got = {(r.g, r.i): r.component for r in components(spark.createDataFrame(edges, "g long, i long, k long"), ["g"], "i", "k").collect()}
    label = {(g, i): i for g, i, _ in edges}
    for _ in range(500):
        best = {}
        for g, i, k in edges:
            best[g, k] = min(best.get((g, k), 1 << 60), label[g, i])
        new = dict(label)
        for g, i, k in edges:
            new[g, i] = min(new[g, i], best[g, k])
        if new == label:
            break
        label = new
    assert got == label


def test_percentiles_equal_sorting(spark):
    from claimloom.operators import reports as rp

    rnd = random.Random(4)
    data = [("hot", rnd.choice([rnd.random(), 0.5, rnd.gauss(0, 1e6)])) for _ in range(3000)] + [("one", 7.0)] + [("two", float(x)) for x in (1, 2)] + [("two", None)]
    ps = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in rp.nearest_rank(spark.createDataFrame(data, "k string, v double"), ["k"], "v", ps).collect()}
    for k in ("hot", "one", "two"):
        v = sorted(x for key, x in data if key == k and x is not None)
        for name, p in ps.items():
            assert got[k][name] == v[max(1, -int(-(len(v) * p - 1e-9) // 1)) - 1], (k, name)


def test_training_examples_equal_the_plain_rule(spark):
    from claimloom.operators import placement as pl

    rnd = random.Random(5)
    rows = sorted({(b, f"doc{d}", s, p, f"text {rnd.randint(0, 60)}") for b in range(4) for d in range(6) for s in range(2) for p in range(rnd.choice([1, 2, 9]))})
    seen, merged = set(), []
    for b, d, s, p, t in rows:
        if (b, d, t) not in seen:
            seen.add((b, d, t))
            merged.append((b, d, s, p, t, t.upper(), "Claim"))
    df = spark.createDataFrame(merged, "brand_id long, document_key string, session_id long, pos int, text_key string, text string, type string")
    asked = [(b, f"doc{d}") for b in range(4) for d in range(6)] + [(2, "new document"), (9, "other brand")]
    for cap in (3, 12):
        out = pl.training_examples(df, spark.createDataFrame(asked, "brand_id long, document_key string"), cap)
        got = {}
        for r in out.collect():
            got.setdefault((r.brand_id, r.current), []).append((r.place, r.text_key, r.source_brand_id))
        for b, d in asked:
            tiers = sorted(((0 if (x, y) == (b, d) else 1) if x == b else 2, x if x != b else 0, y, s, p, t) for x, y, s, p, t, *_ in merged)
            want, used = [], set()
            for tier, src, *_, t in tiers:
                if t not in used and len(want) < cap:
                    used.add(t)
                    want.append((len(want) + 1, t, src if tier == 2 else None))
            assert sorted(got.get((b, d), [])) == want, (cap, b, d)
