import itertools
import random
import zlib

import numpy as np

from claimloom.llm import quality, toxicity

SCHEMA = "doc_id long, text string, score string, held_out int"


def corpus(bad, n=500, seed=1, every=0):
    rnd = random.Random(seed)
    plain = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(3, 60))]
        y = i % 4 == 0
        if y:
            words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice(["", ",", "!"])
            for k in range(0, len(words), every) if every else ():
                words[k] = bad[0]
        docs.append((i, " ".join(words), "x", 1))
        labels.append((i, 0 if y else 1, int(y)))
    docs += [(9001, None, "x", 1), (9002, "", None, None), (None, "w1 awful w2", "n", 0), (9003, "w1 " * 30_000 + "awful", "l", 1), (9004, "w1 w2", "x", 1), (9004, "w1 w2", "x", 1)]
    labels += [(None, 1, 1), (3, None, None), (5, 1, 0), (5, 1, 0)]
    return docs, labels


def held_out(docs, residue, modulus):
    return {d[0]: zlib.crc32(str(d[0]).encode()) % modulus == residue for d in docs if d[0] is not None}


def test_toxicity_finds_planted_words_and_their_places(spark):
    docs, labels = corpus(["awful", "rotten"])
    got = toxicity.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 0, 5).collect()
    assert len(got) == len(docs)
    want = held_out(docs, 0, 5)
    truth = {i: y for i, _, y in labels if y is not None}
    texts = {d[0]: d[1] for d in docs}
    for r in got:
        assert r.held_out == want.get(r.doc_id, False) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(right) > 0.97
    for r in got:
        for s in r.spans:
            assert texts[r.doc_id][s.start : s.end].strip(",!") in ("awful", "rotten")
    assert next(r for r in got if r.doc_id == 9003).n_toxic == 1
    assert next(r for r in got if r.doc_id is None).predicted == 1


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(["awful"], 200)
    hidden = held_out(docs, 2, 4)
    flipped = [(i, None if q is None else 1 - q, t) if hidden.get(i) else (i, q, t) for i, q, t in labels]
    runs = [
        sorted(map(str, quality.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(x, "doc_id long, quality int, toxic int"), 2, 4, 0.7).collect()))
        for x in (labels, flipped)
    ]
    assert runs[0] == runs[1]


def test_quality_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(["zzz", "qqq"], 800, every=5)
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(frame, marks, 2, 4, 0.7).collect()
    truth = {i: q for i, q, _ in labels if q is not None}
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.9
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    for module, extra in ((quality, (2, 4, 0.7)), (toxicity, (0, 5))):
        assert module.classify(frame.limit(0), marks, *extra).collect() == []
        none = module.classify(frame.limit(9), marks.limit(0), *extra).collect()
        assert len(none) == 9 and all(0 <= r.score <= 1 for r in none)


def test_recursions_equal_the_sum_over_all_taggings():
    rnd = np.random.default_rng(4)
    lengths = np.array([3, 0, 7, 1, 4])
    emission, move = rnd.normal(size=15), rnd.normal(size=(2, 2))
    for segment in (1, 2, 3, 256):
        packed = toxicity.Packed(lengths, segment)
        e = np.empty(15)
        e[packed.at] = emission
        p, pairs = packed.marginals(e, move)
        check_taggings(lengths, emission, move, p[packed.at], pairs)


def check_taggings(lengths, emission, move, p, pairs):
    want_pairs, at = np.zeros((2, 2)), 0
    for n in lengths:
        total, on, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emission[at + i] * t for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            on += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                moves[a, b] += w
        assert np.allclose(p[at : at + n], on / total)
        want_pairs += moves / total
        at += n
    assert np.allclose(pairs, want_pairs)
