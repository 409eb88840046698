"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths).  Pieces are placed from
the longest to the shortest; of the open sequences that can take a piece under every capacity, the one with the largest
weighted dot product of demand and residual, or with the smallest weighted norm of what would be left, gets it.
Packing runs in shards of a bounded number of pieces: a shard wastes at most a part of a few sequences.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_map, kept_by_worker, words_of
from claimloom.session import durable

SHARD_PIECES = 20_000
# Words a worker remembers the ids of; it starts anew beyond that, so its memory is bounded.
CACHE_WORDS = 500_000
# Texts a worker holds as Python strings at a time.
BATCH_TEXTS = 1000
# Pre-tokens of printable ASCII text without apostrophes and special tokens.
_PARTS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
_PRINTABLE = re.compile(r"[!-&(-~]+")
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


class _Ids(dict):
    """Little-endian 32-bit ids of blank-free words.

    The tokenizer lowers case and splits at blanks and between letters, single digits and other characters; so parts of a word
    are looked up on their own, and only new ones go through the model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if _PRINTABLE.fullmatch(word) and "<|" not in word:
            parts = _PARTS.findall(word.lower())
            ids = self._encode([t.id for t in self.model.tokenize(parts[0])]) if parts == [word] else b"".join(self[p] for p in parts)
        else:
            core = word.rstrip(_TAIL)
            if core != word and core and core[-1].isalpha():
                ids = self[core] + self[word[len(core) :]]
            else:
                ids = self._encode(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    @staticmethod
    def _encode(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


def pieces(df: DataFrame, tokenizer: str, max_tokens: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """id, piece, start, length, ids_crc32: each document's ids and the end id, cut at ``max_tokens``.

    ``tokenizer`` is a file of the `tokenizers` library that every executor has.  It must split at blanks, as word-level
    pre-tokenizers do.  A null or empty text is the end id alone.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * max_tokens

    def run(batches):
        known = kept_by_worker(("packing", tokenizer), lambda: _Ids(tokenizer))
        for b in batches:
            out = {"id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, text in zip(b["id"], b["text"]):
                ids = b"".join(map(known.__getitem__, words_of(text))) + end
                for i, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    for name, value in zip(out, (doc, i, at // 4, len(cut) // 4, zlib.crc32(cut))):
                        out[name].append(value)
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"id {kind}, piece int, start long, length long, ids_crc32 long", BATCH_TEXTS).withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: float, weights=(1.0, 1e-3, 1e-3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; ``lengths`` fall and each fits into an empty bin."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    caps = np.array([tokens, documents, cost], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    least = lengths[-1] if n else 0
    left = np.empty((3, 1024))
    ids = np.empty(1024, np.int64)
    open_bins = made = 0
    for i, length in enumerate(lengths):
        need = np.array([length, 1, float(length) * length])
        best = -1
        if open_bins and length < tokens:
            room = left[:, :open_bins]
            fits = np.flatnonzero((room[0] >= need[0]) & (room[1] >= need[1]) & (room[2] >= need[2]))
            if len(fits):
                rest = room[:, fits]
                if rule == "dot":
                    score = -((w * need / caps / caps) @ rest)
                else:
                    score = w @ ((rest - need[:, None]) / caps[:, None]) ** 2
                best = fits[np.argmin(score)]
        if best < 0:
            if open_bins == left.shape[1]:
                keep = np.flatnonzero(left[0, :open_bins] >= least)
                left[:, : len(keep)], ids[: len(keep)], open_bins = left[:, keep], ids[keep], len(keep)
                if open_bins > left.shape[1] // 2:
                    left, ids = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([ids, np.empty_like(ids)])
            bins[i] = made
            if tokens - length >= least:
                left[:, open_bins], ids[open_bins] = caps - need, made
                open_bins += 1
            made += 1
        else:
            bins[i], offsets[i] = ids[best], tokens - left[0, best]
            left[:, best] -= need
            if left[0, best] < least or left[1, best] < 1:
                open_bins -= 1
                left[:, best], ids[best] = left[:, open_bins], ids[open_bins]
    return bins, offsets


def pack(parts: DataFrame, tokens: int, documents: int | None = None, cost: float | None = None, id_col: str = "doc_id",
         weights=(1.0, 1e-3, 1e-3), rule: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``tokens`` tokens.

    ``documents`` and ``cost`` default to values that never bind.  Ties are settled by id and piece; pieces that repeat both are
    separate pieces.  A null id is an id.  An empty table gives an empty result.
    """
    documents = tokens if documents is None else documents
    cost = float(tokens) ** 2 if cost is None else cost
    parts = durable(parts)
    shards = max(1, -(-parts.count() // shard_pieces))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable").drop(columns="shard")
        bins, offsets = best_fit(rows["length"].to_numpy(), tokens, documents, cost, weights, rule)
        return rows.assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    shard = F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards)).cast("int")
    return parts.withColumn("shard", shard).groupBy("shard").applyInPandas(run, schema)
