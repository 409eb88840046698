"""Fingerprints of texts by context-triggered piecewise hashing.

A rolling hash of the last few bytes sets the chunk ends: at level k a chunk ends where the k lowest bits of the hash are zero, so the ends of
a level are among those of every lower one and an edit moves only the ends beside it.  Each chunk gives one symbol of a signature.
A fingerprint is the lowest level with at most ``CHUNKS`` chunks, the signature there and the signature one level up; two fingerprints
are compared by edit distance where a level of one is a level of the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_map
from claimloom.session import durable

# Bytes the rolling hash sees, most chunks of a signature, lowest level (mean chunk 2^level bytes).
WINDOW = 7
CHUNKS = 64
LOWEST = 2
# Bytes hashed at a time: very long texts take nine times their size, no more.
BLOCK = 1 << 18
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_WIDTH = 2

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Fingerprinter:
    """Hashes of one text after the other; powers of the base are kept for one block."""

    def __init__(self, block: int = BLOCK):
        self.block, self.up, self.down = block, _powers(_BASE, block), _powers(_INVERSE, block)

    def _prefix(self, data: bytes) -> np.ndarray:
        """Sums of byte times power of the base: the hash of any stretch is a difference of two, shifted by its start."""
        n = len(data)
        out = np.zeros(n + 1, np.uint64)
        for lo in range(0, n, self.block):
            part = np.frombuffer(data, np.uint8, min(self.block, n - lo), lo).astype(np.uint64) + np.uint64(1)
            terms = part * self.up[: len(part)] * np.uint64(pow(_BASE, lo, 1 << 64))
            terms[:1] += out[lo]
            np.cumsum(terms, out=out[lo + 1 : lo + 1 + len(part)])
        return out

    def _shift(self, starts: np.ndarray) -> np.ndarray:
        blocks = np.array([pow(_INVERSE, lo, 1 << 64) for lo in range(0, int(starts[-1]) + 1, self.block)], np.uint64)
        return self.down[starts % self.block] * blocks[starts // self.block]

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * _MIX
        return h ^ (h >> np.uint64(29))

    def of(self, data: bytes) -> str:
        """``level:signature:signature one level up``; the empty text has the empty fingerprint."""
        n = len(data)
        if not n:
            return ""
        prefix = self._prefix(data)
        ends, levels = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n > WINDOW:
            found = []
            for lo in range(0, n - WINDOW, self.block):
                hi = min(lo + self.block, n - WINDOW)
                down = self.down[: hi - lo] * np.uint64(pow(_INVERSE, lo, 1 << 64))
                rolling = self._mix((prefix[lo + WINDOW : hi + WINDOW] - prefix[lo:hi]) * down)
                at = np.flatnonzero((rolling & np.uint64((1 << LOWEST) - 1)) == 0)
                found.append((at + lo + WINDOW, rolling[at]))
            ends, hits = (np.concatenate(x) for x in zip(*found))
            # trailing zeros of the hash: all levels at which a chunk ends here
            low = hits & (~hits + np.uint64(1))
            levels = np.where(hits == 0, 64, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64)
        per_level = np.cumsum(np.bincount(levels, minlength=66)[::-1])[::-1]
        level = LOWEST + int(np.argmax(per_level[LOWEST:] < CHUNKS))
        return ":".join([str(level), *(self._signature(prefix, ends[levels >= k], n) for k in (level, level + 1))])

    def _signature(self, prefix: np.ndarray, ends: np.ndarray, n: int) -> str:
        stops = ends if len(ends) and ends[-1] == n else np.append(ends, n)
        starts = np.concatenate([[0], stops[:-1]])
        codes = (self._mix((prefix[stops] - prefix[starts]) * self._shift(starts)) >> np.uint64(64 - 6 * _WIDTH)).tolist()
        return "".join(_SYMBOLS[c >> 6] + _SYMBOLS[c & 63] for c in codes)


def _longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine word per row of the table."""
    where: dict[str, int] = {}
    for i, s in enumerate(a):
        where[s] = where.get(s, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for s in b:
        hit = row & where.get(s, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def likeness(x: str, y: str) -> float:
    """0 to 1: one less the edit distance (insertions and deletions) over the length of both signatures.

    Fingerprints whose levels lie more than one apart have no signature in common: 0, as has an empty one with another.
    """
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    (kx, *sx), (ky, *sy) = x.split(":"), y.split(":")
    best = 0.0
    for i in range(2):
        j = int(kx) + i - int(ky)
        if 0 <= j < 2:
            a, b = ([s[p : p + _WIDTH] for p in range(0, len(s), _WIDTH)] for s in (sx[i], sy[j]))
            # the same signature of different texts (one symbol may stand for two chunks) is as near as signatures tell
            best = max(best, 2.0 * _longest_common(a, b) / (len(a) + len(b)))
    return best


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def fingerprint_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row of a row comes after it by falling id (the last is followed by the first): rows are range-partitioned once and
    walked in order; only the last row of each partition waits for the first text of the partition that follows.

    A null text is empty.  Null ids come last.  Ties: rows of one id come by a hash of their texts; equal
    rows follow each other.  A single row
    is its own next.  Very long texts are read whole.  An empty table gives an empty result.  Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    # the hash splits an id that many rows share
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys)

    def walk(batches: Iterator[dict]):
        from pyspark import TaskContext

        make, part = Fingerprinter(), TaskContext.get().partitionId()
        waiting = first = None
        for batch in batches:
            out = {n: [] for n in names}
            for doc, text in zip(batch["id"], batch["text"]):
                mine = make.of(text.encode("utf-8", "surrogatepass"))
                if waiting is None:
                    first = text
                else:
                    _append(out, (waiting[0], None, None, None, *_compared(make, *waiting[1:], text, mine)))
                waiting = doc, text, mine
            yield out
        if waiting is not None:
            out = {n: [] for n in names}
            _append(out, (waiting[0], part, first, waiting[1], *[None] * len(_NAMES)))
            yield out

    def close(batches: Iterator[dict]):
        make = Fingerprinter()
        for batch in batches:
            out = {n: [] for n in ("id", *_NAMES)}
            for doc, text, following in zip(batch["id"], batch["last"], batch["following"]):
                mine, near = (make.of(t.encode("utf-8", "surrogatepass")) for t in (text, following))
                _append(out, (doc, *_compared(make, text, mine, following, near)))
            yield out

    names = ("id", "part", "first", "last", *_NAMES)
    walked = durable(arrow_map(ordered, walk, f"id {kind}, part int, first string, last string, {_FIELDS}"))
    open_ends = walked.filter("part IS NOT NULL").select("id", "part", "first", "last")
    # one number per partition that has rows
    parts = sorted(r.part for r in open_ends.select("part").collect())
    follows = dict(zip(parts, parts[1:] + parts[:1])) or {0: 0}
    next_part = F.element_at(F.create_map(*[F.lit(x) for kv in follows.items() for x in kv]), F.col("part"))
    heads = open_ends.select(F.col("part").alias("next_part"), F.col("first").alias("following"))
    closed = open_ends.withColumn("next_part", next_part).join(heads, "next_part").select("id", "last", "following")
    out = walked.filter("part IS NULL").select("id", *_NAMES).unionByName(arrow_map(closed, close, f"id {kind}, {_FIELDS}"))
    return out.withColumnRenamed("id", id_col)


def _append(out: dict[str, list], row: tuple) -> None:
    for column, value in zip(out.values(), row):
        column.append(value)


def _compared(make: Fingerprinter, text: str, mine: str, following: str, near: str) -> tuple:
    """The fields of one row from its text, the next text and the fingerprints of both."""
    changed = edited(text, following).encode("utf-8", "surrogatepass")
    other = make.of(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), mine, other, likeness(mine, other), likeness(mine, near)
