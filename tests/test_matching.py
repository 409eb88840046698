"""Retrieval, citations, quotes and postings against literal cases and brute force."""

import random

from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import citations as ct
from claimloom.operators import passages as ps
from claimloom.operators import postings as po
from claimloom.operators import quotes as qt
from claimloom.operators import retrieval as rt


def test_postings_equal_contains(spark):
    rnd = random.Random(5)
    texts = [(i, " ".join("".join(rnd.choices("abc", k=rnd.randint(1, 9))) for _ in range(8))) for i in range(30)]
    needles = list({"".join(rnd.choices("abc", k=rnd.randint(1, 8))) for _ in range(40)}) + ["ab ca", "a b"]
    t = spark.createDataFrame(texts, "id long, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = {(r.id, r.needle) for r in po.substring_hits(t, ["id"], "text", n).collect()}
    assert got == {(i, x) for i, s in texts for x in needles if x in s}


def test_quotes(spark):
    ref = (
        "In the trial, 47% reduction in seizure frequency compared to placebo was seen.\nThe result was significant (p<0.001) with n=500 patients.\n\n"
        "Adverse events were 3.2% and 2.8%.\n\nSeizure frequency fell by 47% (p<0.001) in adults.\nOther rates were 12%, 8% and 6%."
    )
    quotes = [
        ("47% reduction in seizure frequency compared to placebo", "verified"), ("47%  reduction in seizure frequency compared to placebo", "verified"),
        ("Drug Y showed 83% improvement in cognitive function", "unverified"), ("", "unverified"),
    ]
    df = spark.createDataFrame([(i, q, ref) for i, (q, _) in enumerate(quotes)], "pair_id long, quote string, reference_text string")
    got = {r.pair_id: r.status for r in qt.verify_quotes(df).collect()}
    assert [got[i] for i in range(len(quotes))] == [s for _, s in quotes]


def test_window_search_equals_plain_lcs():
    rnd = random.Random(2)

    def lcs(a, b):
        prev = [0] * (len(b) + 1)
        for x in a:
            cur = [0]
            for j, y in enumerate(b, 1):
                cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[-1]))
            prev = cur
        return prev[-1]

    for _ in range(60):
        q = "".join(rnd.choices("abcd", k=rnd.randint(1, 12)))
        t = "".join(rnd.choices("abcd", k=rnd.randint(1, 60)))
        size, step, best, at, s = min(len(q) * 2, len(t)), max(1, len(q) // 4), 0.0, 0, 0
        while s <= len(t) - len(q) / 2:
            r = lcs(q, t[s : s + size]) / len(q)
            if r > best:
                best, at = r, s
            s += step
        assert qt.best_window(q, t) == (best, at)


def test_windows_side_by_side_equal_single_ones(monkeypatch):
    """Quotes of one, two and three words of bits, in blocks of few windows."""
    rnd = random.Random(4)
    monkeypatch.setattr(qt, "_WINDOWS", 37)

    def lcs(a, b):
        masks, v = {}, (1 << len(a)) - 1
        for i, ch in enumerate(a):
            masks[ch] = masks.get(ch, 0) | 1 << i
        for ch in b:
            u = v & masks.get(ch, 0)
            v = ((v + u) | (v - u)) & ((1 << len(a)) - 1)
        return len(a) - v.bit_count()

    for _ in range(8):
        text = "".join(rnd.choices("abcdé ", k=rnd.randint(0, 900)))
        quotes = ["".join(rnd.choices("abcdxé ", k=k)) for k in (1, 5, 63, 64, 65, 128, 150)] + [text[100:270] or "a"]
        for floor in (0.0, 0.6):
            for q, got in zip(quotes, qt.best_windows(quotes, text, floor)):
                want = (0.0, 0)
                for s in range(0, int(len(text) - len(q) / 2) + 1, max(1, len(q) // 4)):
                    r = lcs(q, text[s : min(s + min(len(q) * 2, len(text)), len(text))]) / len(q)
                    if r > want[0]:
                        want = (r, s)
                assert got == want if want[0] >= floor else got[0] <= want[0]


def test_quotes_of_a_reference_share_its_text(spark):
    n = qt.QUOTES_PER_TEXT * 2
    text = "Relapse fell by 47% in adults. Placebo did nothing at all."
    c = spark.createDataFrame([(i, 9, 1) for i in range(n)], "claim_id long, reference_id long, ref_rank int")
    q = spark.createDataFrame([(i, 9, 1, "relapse fell by 47% in adults", "text_quote") for i in range(n)], "claim_id long, reference_id long, position int, quote string, evidence_type string")
    out = qt.extraction_tier(c, q, spark.createDataFrame([(9, text)], "reference_id long, content_text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.index("collect_list") > plan.index("Generate explode")  # texts join what was collected
    assert {(r.status, r.match_tier) for r in out.collect()} == {("verified", "verified-extraction")} and out.count() == n


LIBRARY = [
    (11, "Leonhard 2019", "leonhard", "2019", ["leonhard", "mandarakas", "gondim"], ["diagnosis", "management", "guillain"], ["nat", "rev", "neurol"]),
    (54, "van den Berg 2014", "van", "2014", ["berg", "walgaard", "drenthen", "fokke", "jacobs", "doorn"], ["guillain", "pathogenesis"], ["nat", "rev", "neurol"]),
    (22, "Harms 2011", "harms", "2011", ["harms"], ["inpatient", "management", "guillain"], ["neurohospitalist"]),
]


def test_library_citations(spark):
    meta = spark.createDataFrame([(i, f, y, None, a, t, j) for i, _, f, y, a, t, j in LIBRARY],
                                 "reference_id long, first_author string, year string, doi string, author_tokens array<string>, title_tokens array<string>, journal_tokens array<string>")
    names = spark.createDataFrame([(i, n, n + ".pdf") for i, n, *_ in LIBRARY], "reference_id long, name string, original_name string")
    cases = [
        ("1. Harms M. Inpatient management of", 22), ("1. Leonhard SE, Mandarakas MR, Gondim FAA, et al. Diagnosis and management of Guillain", 11),
        ("2. v an den Berg B, Walgaard C, Drenthen J, Fokke C, Jacobs BC, van Doorn PA", 54), ("1. Harms M. Neurohospitalist. 2011;1(2):78-84.", 22),
        ("Leonhard SE et al. Nat Rev Neurol . 2019;15(11):671-683.", 11), ("5. Data on file. Annexon Biosciences. 2024.", None), ("", None),
    ]
    c = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "citation_id long, citation_text string")
    index = ct.library_index(meta, names)
    for mode in ("ui", "server"):
        got = {r.citation_id: r.reference_id for r in ct.match_citations(c, index, mode).collect()}
        assert [got.get(n) for n in range(len(cases))] == [w for _, w in cases]


def test_pages(spark):
    cases = [("Nat. 2019;15(11):680-690.", 680, 690), ("Nat. 2019;12:680-90.", 680, 690), ("Nat. 2019;9:681.", 681, 681)]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string")
    got = [(r.r.start, r.r.end) for r in df.select(tx.page_range(F.col("t")).alias("r")).collect()]
    assert got == [(a, z) for _, a, z in cases]
    bounds = [(1, 2, 5000), (2, 5002, 12000), (3, 12002, 18000)]
    offs = [(100, 1), (5002, 2), (15000, 3), (99999, 3), (0, 1), (5000, 1), (5001, 1), (12000, 2), (12001, 2)]
    df = spark.createDataFrame([(o, bounds) for o, _ in offs], "o int, b array<struct<page:int,start_char:int,end_char:int>>")
    assert [r[0] for r in df.select(ps.offset_to_page(F.col("o"), F.col("b"))).collect()] == [p for _, p in offs]
    pages = [("3", 14, 3.0), ("22", 14, 14.0), ("0", 14, 1.0), ("-5", 14, 1.0), (None, 14, None), ("abc", 14, None), ("5", None, 5.0), ("3.7", 14, 4.0)]
    df = spark.createDataFrame([(p, n) for p, n, _ in pages], "p string, n int")
    assert [r[0] for r in df.select(ps.sanitize_page(F.col("p"), F.col("n"))).collect()] == [w for _, _, w in pages]


def test_fact_anchor_needs_a_partner(spark):
    c = spark.createDataFrame([(1, "b", "relapse rate fell by 47%", [1.0, 0.0]), (2, "b", "unrelated words entirely", [1.0, 0.0])], "claim_id long, brand string, text string, embedding array<float>")
    f = spark.createDataFrame([(9, "b", [("other thing", 1), ("The relapse rate fell", 4)], [1.0, 0.0])], "reference_id long, brand string, facts array<struct<text:string,page:int>>, embedding array<float>")
    got = rt.fact_anchor(c, f).collect()
    assert [(r.claim_id, r.page, r.excerpt) for r in got] == [(1, 4, "The relapse rate fell")]


def test_short_prefixes_inside_words(spark):
    from claimloom.operators import placement as pl

    lines = [(1, 1, i, t) for i, t in enumerate(["the alpha beta gamma", "xalpha betax", "alpha", "gamma alphabet", "nothing here"])] + [(2, 1, 0, "alpha beta")]
    claims = [(1, 1, 1, "Alpha"), (2, 1, 1, "alpha beta"), (3, 1, 1, "gamma"), (4, 2, 1, "nothing"), (5, 1, 1, "a")]
    got = pl.prefix_anchor(spark.createDataFrame(claims, "claim_id long, doc long, page int, text string"), spark.createDataFrame(lines, "doc long, page int, line_no int, text string"))
    # a line counts if it holds the prefix and most of its words in order
    assert {(r.claim_id, r.line_no) for r in got.collect()} == {(1, 0), (2, 0), (3, 0)}


def test_many_pairs_of_one_document_share_its_texts(spark):
    from claimloom.operators import evidence as ev

    n = ev.PAIRS_PER_TEXT * 2
    pairs = [(i, 1, f"relapse fell by {i}% in adults") for i in range(n)] + [(9999, 2, "no such document")]
    p = spark.createDataFrame(pairs, "pair_id long, doc long, claim_text string")
    pages = spark.createDataFrame([(1, 1, "Relapse in 7% of ADULTS", 1), (1, 2, "", 1), (1, 1, "old", 0)], "doc long, page int, page_text string, seq int")
    got = {(r.pair_id, r.page): r.page_score for r in ev.page_scores(p, pages).collect()}
    alone = {(r.pair_id, r.page): r.page_score for i in (7, 8) for r in ev.page_scores(p.filter(f"pair_id = {i}"), pages).collect()}
    assert len(got) == 2 * n and got[7, 1] > got[8, 1] > got[8, 2] == 0.0 and alone == {k: got[k] for k in alone}
