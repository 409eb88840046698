import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from claimloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "Hello, world's  end of it", "  two   blanks\tand\n\nlines ", "á é ﬁ ½ x́", "<|endoftext|> is <s>plain</s> <unk> text", "日本語 テキスト 😀",
    "a ▁ mark", "can't we'll 12345 !!!???", "Über\x0bstraße\x0c", "x\x00y", "word " * 4000, "z" * 3000, "Hello, world's  end of it", "the cat sat on the mat",
]


def brute(texts):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = alignment.byte_alphabet()
    spell_a = lambda i: bytes(alphabet[c] for c in tok.id_to_token(i))

    def spell_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    out, pairs, per_text = [], Counter(), []
    for t in texts:
        if not t or b"".join(spell_a(i) for i in tok.encode(" " + t, add_special_tokens=False).ids) != (" " + t).encode() or b"".join(spell_b(i) for i in sp.encode(t)) != (" " + t).encode():
            out.append((0, 0, 0, 0, ""))
            per_text.append([])
            continue
        sides = []
        for ids, spell in ((tok.encode(" " + t, add_special_tokens=False).ids, spell_a), (sp.encode(t), spell_b)):
            at, ranges = 0, []
            for i in ids:
                ranges.append((at, at + len(spell(i)), i))
                at = ranges[-1][1]
            sides.append(ranges)
        a, b = sides
        cuts = sorted({r[1] for r in a} & {r[1] for r in b})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low < e <= c) for side in (a, b)) if len(t) < 2000 else "")
            low = c
        links, j = [], 0
        for s, e, i in a:
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                links.append((i, b[k][2]))
                k += 1
        pairs.update(links)
        per_text.append(links)
        out.append((len(a), len(b), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if len(t) < 2000 else None))
    top = {}
    for (_, j), n in pairs.items():
        top[j] = max(top.get(j, 0), n)
    return [(*o[:4], sum(pairs[x] == top[x[1]] for x in links), sum(pairs[x] for x in links), o[4]) for o, links in zip(out, per_text)]


def row(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


@pytest.mark.parametrize("limits", [{}, {"radix": 3, "run_links": 300, "run_documents": 2, "fan_in": 2, "slice_bytes": 500}])
def test_equals_brute_force(spark, limits):
    want = brute(TEXTS)
    rows = [(i if i != 5 else None, t, "clash", i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, run int").repartition(3)
    got = {r.doc_id: row(r) for r in alignment.align(df, A, B, **limits).collect()}
    assert len(got) == len(TEXTS)
    for i, w in enumerate(want):
        g = got[i if i != 5 else None]
        assert g == w or (w[-1] is None and g[:-1] == w[:-1]), i


def test_empty_table_and_texts_only_null(spark):
    schema = "doc_id string, text string"
    assert alignment.align(spark.createDataFrame([], schema), A, B).collect() == []
    got = alignment.align(spark.createDataFrame([("a", None), ("a", ""), (None, None)], schema), A, B).collect()
    assert sorted(map(row, got)) == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_merge_sums_equal_pairs_and_marks_every_highest():
    rnd = np.random.default_rng(1)
    runs, want = [], Counter()
    for _ in range(9):
        keys = np.unique(rnd.integers(0, 40_000, 9_000))
        totals = rnd.integers(1, 4, len(keys))
        want.update(dict(zip(keys.tolist(), totals.tolist())))
        runs.append(alignment._frames(keys, totals))
    keys, counts, best = (np.concatenate(x) for x in zip(*alignment.with_maxima(alignment.merge_runs(runs), 4)))
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys) > 0).all()
    top = {}
    for k, n in want.items():
        top[k >> 4] = max(top.get(k >> 4, 0), n)
    assert best.tolist() == [want[k] == top[k >> 4] for k in keys.tolist()]


def test_one_pair_in_every_document_is_dealt_out(spark):
    """A token that all documents hold: its bodies lie in several slices, none beyond its size."""
    df = spark.createDataFrame([(i, "the the the") for i in range(2000)], "doc_id long, text string").repartition(2)
    got = alignment.align(df, A, B, run_documents=50, slice_bytes=1000).collect()
    assert {row(r)[:6] for r in got} == {(3, 3, 3, 3, 3, 3 * 6000)}
