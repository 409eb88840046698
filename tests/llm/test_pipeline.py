import collections
import re

import corpus_pipeline as cp
from claimloom.llm import toxicity
from tests.llm.test_jaccard_join import brute as linked
from tests.llm.test_jaccard_join import cases

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), 0, 5)
    rows = docs.collect()
    clean = [r for r, p in zip(rows, model.token_marginals([r.text or "" for r in rows])) if model.document_score(p) < 0.5]
    best = {}
    for r in clean:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    unique = [r for r in clean if best[r.text or ""] == r.doc_id]
    single = {i for i, _, c in linked([(r.doc_id, r.text) for r in unique]) if i == c}
    kept = docs
    seen = []
    for name, stage in cp.STAGES[:3]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        seen.append(sorted(r.doc_id for r in kept.collect()))
    assert seen == [sorted(r.doc_id for r in clean), sorted(r.doc_id for r in unique), sorted(single)]
    mixed = cp.mix_sources(spark, kept, SF)
    assert mixed.columns == docs.columns
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= single and max(times.values()) <= 3
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    assert abs(sum(n * words[i] for i, n in times.items()) / sum(words[i] for i in single) - 1) < 0.2
    packed = cp.pack_sequences(spark, mixed, SF).collect()
    assert sum(r.piece == 0 for r in packed) == sum(times.values())
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert sum(n for _, n in parts) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))


def test_stages_take_odd_rows_and_empty_tables(spark):
    odd = spark.createDataFrame([(i, t, "xx", s, 1) for (i, t, *_), s in zip(cases(4), [None, "a", "b", "row", ""] * 500)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
            if name != "packing":
                assert docs.columns == odd.columns, name
        docs.collect()
