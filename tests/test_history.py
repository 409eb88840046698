"""Lineage walks of any shape."""

from claimloom.operators import history as hs

SCHEMA = "document_hash long, parent_hash long, similarity_score double, created_at long, edge_id long"


def walk(parent, doc):
    out, at, depth = {}, parent.get(doc), 1
    while at is not None and at != doc and at not in out:
        out[at] = depth
        at, depth = parent.get(at), depth + 1
    return out


def test_long_chains_and_cycles_end(spark):
    parent = {i: i - 1 for i in range(1, 3000)}  # a chain deeper than any fixed limit
    parent |= {5000: 5001, 5001: 5002, 5002: 5000, 5003: 5001, 5004: 5003, 5005: 5005}
    edges = spark.createDataFrame([(d, p, 0.5, 1, d) for d, p in parent.items()], SCHEMA)
    asked = [2999, 1500, 1, 5000, 5001, 5003, 5004, 5005]
    got = {}
    for r in hs.ancestors(edges, spark.createDataFrame([(d,) for d in asked], "document_hash long")).collect():
        got.setdefault(r.document_hash, {})[r.ancestor] = r.depth
    assert got == {d: w for d in asked if (w := walk(parent, d))}
    small = edges.filter("document_hash >= 5000")
    assert {(r.document_hash, r.ancestor, r.depth) for r in hs.ancestors(small).collect()} == {(d, a, k) for d in parent if d >= 5000 for a, k in walk(parent, d).items()}


def test_most_similar_pages_of_long_documents(spark):
    import random

    from claimloom.operators import topk

    rnd = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    common = [f"every{i}" for i in range(6)]
    old = {p: [*common, *rnd.sample(vocabulary, 20)] for p in range(1, 41)}
    new = {p: [w if rnd.random() < 0.9 else rnd.choice(vocabulary) for w in old[p]] for p in range(1, 31)}
    new |= {31: ["nothing", "alike"], 32: [], 33: list(old[7])}
    rows = [(1, p, " ".join(w)) for p, w in old.items()] + [(2, p, " ".join(w)) for p, w in new.items()] + [(3, 1, "lonely words here"), (4, 1, "more words")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, page_text string")
    pairs = spark.createDataFrame([(1, 2), (9, 3), (4, 3)], "old_doc long, new_doc long")
    want = {}
    for p, w in new.items():
        sims = {o: len(set(w) & set(x)) / len(set(w) | set(x)) for o, x in old.items()}
        o = min(sims, key=lambda k: (-sims[k], k))
        want[2, p] = (round(sims[o], 9), o if sims[o] else None)
    for small in (0, 10**6):
        got = {(r.new_doc, r.new_page): (round(r.similarity, 9), r.old_page) for r in hs.compare_pages(pairs.filter("old_doc = 1"), pages, small).collect()}
        assert got == want
    got = {(r.old_doc, r.new_page): r.similarity for r in hs.compare_pages(pairs, pages, 0).filter("new_doc = 3").collect()}
    assert got == {(9, 1): 0.0, (4, 1): 0.25}
    # how many page pairs meet
    words = hs.page_words(pages, "page_text")
    asked = words.filter("doc_id = 2").selectExpr("1L AS old_doc", "2L AS new_doc", "page AS new_page", "filter(words, w -> w <> '') AS nw")
    needles, postings, score = hs.similar_pages(asked, words.filter("doc_id = 1").selectExpr("doc_id AS old_doc", "page AS old_page", "words AS ow"))
    ordered = topk.rare_first(needles, postings, ["old_doc"], "each")
    seeds = topk.seed_pairs(ordered, postings, 1, ["old_doc"])
    later = topk.open_pairs(ordered, postings, score(seeds), 1, ["old_doc"])
    assert seeds.count() + later.count() < 0.6 * len(old) * len(new)
