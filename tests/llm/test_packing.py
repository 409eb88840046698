import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "Hello, world's  end of it", "á é", "ΣΑΣ ΟΔΟΣ.", "x\x1cy\x1fz", "<|endoftext|>mid <|startoftext|>",
    "日本語 テキスト", "don't can't we'll 12345 !!!???", "Über\x0bstraße\x0cÉÇ", "word " * 5000, "z" * 9000, "Hello, world's  end of it",
]


def test_ids_equal_those_of_whole_texts(spark):
    tok = Tokenizer.from_file(PATH)
    want = set()
    for i, t in enumerate(TEXTS):
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), 128):
            want.add((i, k // 128, k, len(ids[k : k + 128]), zlib.crc32(ids[k : k + 128].tobytes())))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, piece string")
    assert {tuple(r) for r in packing.pieces(df, PATH, 128).collect()} == want


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rnd = np.random.default_rng(2)
    lengths = np.sort(rnd.integers(1, 101, 3000))[::-1]
    bins, offsets = packing.best_fit(lengths, 100, 5, 6000.0 + 4000, (1, 0.2, 0.2), rule)
    for b in range(bins.max() + 1):
        mine = np.flatnonzero(bins == b)
        assert 0 < len(mine) <= 5 and lengths[mine].sum() <= 100 and (lengths[mine].astype(float) ** 2).sum() <= 10000
        assert (offsets[mine] == np.r_[0, np.cumsum(lengths[mine])[:-1]]).all()
    plain, _ = packing.best_fit(lengths, 100, 100, 1e9, rule=rule)
    assert plain.max() + 1 <= 1.02 * lengths.sum() / 100 + 1


def test_pack_places_each_piece_once(spark):
    rows = [(None if i == 3 else i % 900, 0, 0, i * 7919 % 60 + 1, 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df, 64, shard_pieces=300).collect()
    assert sorted(str((r.doc_id, r.length)) for r in got) == sorted(str((r[0], r[3])) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(df.limit(0), 64).collect() == []
