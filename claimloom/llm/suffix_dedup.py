"""Removal of repeated byte strings with run-length indexes of repetitive text.

1. Every string of ``length`` bytes names the smallest hash among its k-grams, its anchor; equal strings have equal anchors.
   Anchors that occur once in the corpus cannot belong to a repeated string.
2. Around every other anchor the bytes of its strings are one context.  Contexts go to the task of their anchor; equal
   ones are one context from the start, of which the first occurrence counts.
3. A task joins the contexts of its anchors and builds the run-compressed Burrows-Wheeler transform.  Longest common
   prefixes are computed at the sampled run ends only; between them the matching statistics of the text follow by counting down
   as the text streams by.  Long matches fall into classes of equal strings, and all but the first of a class are removed.
4. Anchors with very many contexts (at most HOT_ANCHORS of them) are dealt out string by string instead.

Whole copies of a document need none of this: they are removed as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import bloom
from claimloom.llm.common import arrow_map
from claimloom.session import durable

LENGTH = 100
GRAM = 24
# Bytes of text that go through the hashing together, and bytes of one index: both bound the memory of a task.
CHUNK = 2_000_000
INDEX = 500_000
# An anchor counted more often than this may be dealt out string by string; no more anchors than this are, so that their set
# is small enough to broadcast.
HOT, HOT_ANCHORS = 20_000, 100_000
# Contexts that a task holds while it looks for equal ones.
HELD = 50_000
# Largest filter of repeated anchors in bits; fuller filters let more contexts through and change no result.
MAX_LOG2 = 29

_CONTEXT = np.dtype([("hash", "<u8"), ("ord", "<i8"), ("th", "<i8"), ("start", "<i8"), ("off", "<i4"), ("len", "<i4")])
_STRING = np.dtype([("hash", "<u8"), ("ord", "<i8"), ("th", "<i8"), ("start", "<i8")])
_SPAN = np.dtype([("ord", "<i8"), ("th", "<i8"), ("from", "<i8"), ("to", "<i8")])
_PACKED = "part int, kind int, meta binary, blob binary"


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all grams, by doubling."""
    with np.errstate(over="ignore"):
        factor, width, h = np.uint64(0x9E3779B97F4A7C15), 1, buf.astype(np.uint64) + np.uint64(1)
        total, done, lift = None, 0, factor
        while True:
            if gram & width:
                part = h[done : len(buf) - gram + 1 + done]
                total = part if total is None else total * lift + part
                done += width
            if done == gram:
                break
            h = h[:-width] * lift + h[width:]
            lift, width = lift * lift, width * 2
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return total ^ (total >> np.uint64(29))


def anchors(docs: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of neighbouring strings with one anchor: document number, first and last start, anchor place, anchor hash."""
    sizes = np.array([len(d) for d in docs], np.int64)
    buf = np.frombuffer(b"".join(docs), np.uint8)
    if len(buf) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    h = _gram_hashes(buf, gram)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    window, width = length - gram + 1, 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(buf) - length + 1], low[window - width : window - width + len(buf) - length + 1])
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    base = np.cumsum(sizes) - sizes
    inside = np.zeros(len(buf) + 1, np.int64)
    some = sizes >= length
    np.add.at(inside, base[some], 1)
    np.add.at(inside, (base + sizes - length + 1)[some], -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    doc = np.searchsorted(base + sizes, starts, side="right")
    place = place[starts]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:] - 1, len(starts) - 1]
    d, p = doc[new], place[new]
    return d, starts[new] - base[d], starts[last] - base[d], p - base[d], h[p]


def _chunks(batch: dict, length: int):
    """(ord, th, shift, bytes) of documents, in groups of about CHUNK bytes; longer documents in overlapping parts."""
    group, size = [], 0
    for i, th, text in zip(batch["ord"], batch["th"], batch["text"]):
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) < length:
            continue
        for at in range(0, len(raw) - length + 1, CHUNK):
            part = raw[at : at + CHUNK + length - 1]
            group.append((i, th, at, part))
            size += len(part)
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts of hashes; anchors are small hashes by their choice, so they are mixed once more."""
    with np.errstate(over="ignore"):
        mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (mixed * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _runs(x: np.ndarray):
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[starts], starts, np.r_[starts[1:], len(x)].astype(np.int64)


def _count_anchors(parts: int, length: int, gram: int):
    """Anchors of each batch with their number (up to 65535), dealt out by anchor."""

    def run(batches):
        for b in batches:
            found = [anchors([x[3] for x in g], length, gram)[4] for g in _chunks(b, length)]
            h, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            out = {"part": [], "kind": [], "meta": [], "blob": []}
            part = _parts_of(h, parts)
            order = np.argsort(part, kind="stable")
            h, n, part = h[order], n[order], part[order]
            for p, a, e in zip(*_runs(part)):
                out["part"].append(int(p))
                out["kind"].append(0)
                out["meta"].append((h[a:e] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                out["blob"].append(np.minimum(n[a:e], 65535).astype("<u2").tobytes())
            yield out

    return run


def _repeated_anchors(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rest = np.concatenate([np.frombuffer(x, "<u4") for x in rows["meta"]])
    count = np.concatenate([np.frombuffer(x, "<u2") for x in rows["blob"]]).astype(np.float64)
    values, code = np.unique(rest, return_inverse=True)
    total = np.bincount(code, count)
    many = total > 1
    return pd.DataFrame({"part": int(key[0]), "rest": values[many].astype(np.int64), "n": total[many].astype(np.int64)})


class _Contexts:
    """Contexts of a task, equal ones as one: the earliest is kept, the others are spans that repeat it."""

    def __init__(self):
        self.first: dict[bytes, tuple] = {}
        self.spans: list[tuple] = []

    def add(self, key: bytes, ordinal: int, th: int, start: int, size: int) -> None:
        old = self.first.get(key)
        if old is None:
            self.first[key] = (ordinal, th, start, size)
            return
        gone = (ordinal, th, start)
        if (ordinal, start) < (old[0], old[2]):
            gone, self.first[key] = old, (ordinal, th, start, size)
        if (old[0], old[2]) != (ordinal, start):
            self.spans.append((gone[0], gone[1], gone[2], gone[2] + size))

    def pack(self, parts: int, strings: np.ndarray, gone: np.ndarray) -> dict:
        entries = [(int.from_bytes(k[:8], "little"), *v[:3], int.from_bytes(k[8:12], "little", signed=True), v[3]) for k, v in self.first.items()]
        return _pack(parts, np.array(entries, _CONTEXT), [k[12:] for k in self.first], strings, np.concatenate([np.array(self.spans, _SPAN), gone]))


def _hot_strings(group: list, doc: np.ndarray, start: np.ndarray, last: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of hot anchors in a group of texts: the first of equal ones, and the spans of the others."""
    many = last - start + 1
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    which, at = np.repeat(doc, many), np.repeat(start, many) + step
    sizes = np.array([len(x[3]) for x in group], np.int64)
    hashes = _gram_hashes(np.frombuffer(b"".join(x[3] for x in group), np.uint8), length)
    out = np.zeros(len(which), _STRING)
    with np.errstate(over="ignore"):
        out["hash"] = hashes[(np.cumsum(sizes) - sizes)[which] + at] * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.repeat(h, many)
    ords, ths, shifts = (np.array([x[k] for x in group], np.int64) for k in range(3))
    out["ord"], out["th"], out["start"] = ords[which], ths[which], shifts[which] + at
    out = out[np.lexsort((out["start"], out["ord"], out["hash"]))]
    later = _later(out["hash"], out)
    return out[np.r_[True, out["hash"][1:] != out["hash"][:-1]] | ~later], _spans(out[later], np.full(int(later.sum()), length))


def _deal_contexts(parts: int, length: int, gram: int, bits, log2: int, hot):
    """Contexts of repeated anchors by anchor, strings of hot anchors by string, and the spans that are known to repeat
    because the task itself has an earlier equal one."""

    def run(batches):
        table, hot_keys = bits.value, hot.value
        for b in batches:
            held, strings, gone = _Contexts(), [np.zeros(0, _STRING)], [np.zeros(0, _SPAN)]
            for g in _chunks(b, length):
                doc, start, last, place, h = anchors([x[3] for x in g], length, gram)
                spot = (h & np.uint64((1 << log2) - 1)).astype(np.int64)
                known = ((table[spot >> 3] >> (spot & 7)) & 1).astype(bool)
                keys = (_parts_of(h, parts) << 32) + (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
                is_hot = known & np.isin(keys, hot_keys)
                if is_hot.any():
                    kept, others = _hot_strings(g, doc[is_hot], start[is_hot], last[is_hot], h[is_hot], length)
                    strings.append(kept)
                    gone.append(_union(others))
                for i in np.flatnonzero(known & ~is_hot).tolist():
                    ordinal, th, shift, raw = g[doc[i]]
                    s, e = int(start[i]), int(last[i]) + length
                    key = int(h[i]).to_bytes(8, "little") + (s - int(place[i])).to_bytes(4, "little", signed=True) + raw[s:e]
                    held.add(key, ordinal, th, shift + s, e - s)
                if len(held.first) + len(held.spans) > HELD or len(strings) > 1:
                    yield held.pack(parts, np.concatenate(strings), np.concatenate(gone))
                    held, strings, gone = _Contexts(), [np.zeros(0, _STRING)], [np.zeros(0, _SPAN)]
            yield held.pack(parts, np.concatenate(strings), np.concatenate(gone))

    return run


def _pack(parts: int, contexts: np.ndarray, blobs: list[bytes], strings: np.ndarray, spans: np.ndarray) -> dict:
    out = {"part": [], "kind": [], "meta": [], "blob": []}

    def add(part, kind, meta, blob=b""):
        for name, value in zip(out, (int(part), kind, meta.tobytes(), blob)):
            out[name].append(value)

    part = _parts_of(contexts["hash"], parts)
    order = np.argsort(part, kind="stable")
    for p, a, e in zip(*_runs(part[order])):
        add(p, 0, contexts[order[a:e]], b"".join(blobs[i] for i in order[a:e]))
    for kind, rows, part in ((1, strings, _parts_of(strings["hash"], parts)), (2, spans, (spans["th"] % parts))):
        order = np.argsort(part, kind="stable")
        for p, a, e in zip(*_runs(part[order])):
            add(p, kind, rows[order[a:e]])
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a byte text by prefix doubling that starts with seven bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # nine bits a byte: 0 stands for the end of the text, which is smaller than any byte
    symbols = np.zeros(n + 7, np.int64)
    symbols[:n] = text
    symbols[:n] += 1
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key |= symbols[k : k + n]
    rank = np.empty(n, np.int64)
    depth = 7
    while True:
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: max(0, n - depth)] += rank[depth:] + 1
        depth *= 2


class RunIndex:
    """Run-compressed Burrows-Wheeler transform: the heads and starts of the runs and the suffixes at the run ends."""

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        self.suffixes = suffix_array(text)
        before = np.where(self.suffixes > 0, text[self.suffixes - 1].astype(np.int64), -1)
        self.starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]) if self.size else np.zeros(0, np.int64)
        self.heads = before[self.starts]
        # sampled run ends: the first suffix of each run, and the last one of the run before
        self.first = self.suffixes[self.starts]
        self.above = np.where(self.starts > 0, self.suffixes[self.starts - 1], -1)

    def matching_statistics(self, text: np.ndarray) -> np.ndarray:
        """For each place the longest common prefix with its predecessor in suffix order.

        Where a run goes on, the letter before is the same as that of the predecessor, and the match is one shorter than that of
        the place before; so only the run ends need a comparison of bytes.
        """
        if not self.size:
            return np.zeros(0, np.int64)
        sampled = np.zeros(self.size, np.int64)
        sampled[self.first] = _common_prefix(text, self.first, self.above)
        is_sample = np.zeros(self.size, bool)
        is_sample[self.first] = True
        at = np.arange(self.size)
        latest = np.maximum.accumulate(np.where(is_sample, at, 0))
        return np.maximum(sampled[latest] - (at - latest), 0)


def _common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffix pairs (-1: no partner), eight bytes a step."""
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(b >= 0)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        room = n - np.maximum(x, y)
        ok = room > 0
        live, x, y, room = live[ok], x[ok], y[ok], room[ok]
        same = words[x] == words[y]
        step = np.minimum(np.where(same.all(1), 8, same.argmin(1)), room)
        out[live] += step
        live = live[step == 8]
    return out


def _later_strings(meta: np.ndarray, blob: bytes, length: int) -> np.ndarray:
    """Spans of strings in contexts that equal a string that starts earlier; the contexts of an anchor are all here."""
    sizes = meta["len"].astype(np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.uint8)
    inside = np.ones(len(text), bool)
    inside[base + sizes] = False
    text[inside] = np.frombuffer(blob, np.uint8)
    index = RunIndex(text)
    match = index.matching_statistics(text)
    rows = index.suffixes
    owner = np.repeat(np.arange(len(meta)), sizes + 1)
    step = np.arange(len(text)) - base[owner]
    whole = step + length <= sizes[owner]
    group = np.cumsum(match[rows] < length)
    valid = whole[rows]
    rows, group = rows[valid], group[valid]
    _, docs = np.unique(meta["ord"], return_inverse=True)
    start = meta["start"][owner[rows]] + step[rows]
    order = np.lexsort((start, docs[owner[rows]], group))
    rows, group, start = rows[order], group[order], start[order]
    doc = docs[owner[rows]]
    _, begin, end = _runs(group)
    head = np.repeat(begin, end - begin)
    later = (doc != doc[head]) | (start != start[head])
    gone = np.zeros(len(text) + 1, bool)
    gone[rows[later]] = True
    edge = np.diff(np.r_[False, gone[:-1] & whole].astype(np.int8), append=0)
    at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros(len(at), _SPAN)
    who = owner[at]
    out["ord"], out["th"] = meta["ord"][who], meta["th"][who]
    out["from"] = meta["start"][who] + step[at]
    out["to"] = out["from"] + (to - at) + length - 1
    return out


def _resolve(parts: int, length: int):
    """Repeated spans of one part, dealt out by document."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(x, _SPAN) for x in rows.loc[rows["kind"] == 2, "meta"]]
        contexts = rows[rows["kind"] == 0]
        if len(contexts):
            found += _resolve_contexts(np.concatenate([np.frombuffer(x, _CONTEXT) for x in contexts["meta"]]), b"".join(contexts["blob"]), length)
        strings = rows.loc[rows["kind"] == 1, "meta"]
        if len(strings):
            s = np.concatenate([np.frombuffer(x, _STRING) for x in strings])
            s = s[np.lexsort((s["start"], s["ord"], s["hash"]))]
            found.append(_spans(s[_later(s["hash"], s)], np.full(len(s), length)[_later(s["hash"], s)]))
        spans = _union(np.concatenate(found)) if found else np.zeros(0, _SPAN)
        part = spans["th"] % parts
        order = np.argsort(part, kind="stable")
        out = {"part": [], "meta": []}
        for p, a, e in zip(*_runs(part[order])):
            out["part"].append(int(p))
            out["meta"].append(spans[order[a:e]].tobytes())
        return pd.DataFrame(out)

    return run


def _later(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of rows sorted by group, document and start: those that do not start where the first of the group does."""
    _, begin, end = _runs(group)
    head = np.repeat(begin, end - begin)
    return (rows["ord"] != rows["ord"][head]) | (rows["start"] != rows["start"][head])


def _spans(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), _SPAN)
    out["ord"], out["th"], out["from"], out["to"] = rows["ord"], rows["th"], rows["start"], rows["start"] + sizes
    return out


def _resolve_contexts(meta: np.ndarray, blob: bytes, length: int) -> list[np.ndarray]:
    at = np.cumsum(meta["len"].astype(np.int64)) - meta["len"]
    digest = np.fromiter((xxhash.xxh3_64_intdigest(blob[a : a + n]) for a, n in zip(at.tolist(), meta["len"].tolist())), np.uint64, len(meta))
    order = np.lexsort((meta["start"], meta["ord"], digest, meta["off"], meta["hash"]))
    meta, at, digest = meta[order], at[order], digest[order]
    # equal contexts: the first occurrence stands for all, the others repeat it as a whole
    new = np.r_[True, (meta["hash"][1:] != meta["hash"][:-1]) | (meta["off"][1:] != meta["off"][:-1]) | (digest[1:] != digest[:-1])]
    later = _later(np.cumsum(new), meta)
    found = [_spans(meta[later], meta["len"][later].astype(np.int64))]
    meta, at = meta[new], at[new]
    # an anchor with a single context has no further repeats
    _, begin, end = _runs(meta["hash"])
    several = np.repeat(end - begin > 1, end - begin)
    meta, at = meta[several], at[several]
    _, begin, end = _runs(meta["hash"])
    size = np.add.reduceat(meta["len"].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    batch = np.cumsum(size) // INDEX
    for _, a, e in zip(*_runs(batch)):
        rows = slice(int(begin[a]), int(end[e - 1]))
        pieces = b"".join(blob[i : i + n] for i, n in zip(at[rows].tolist(), meta["len"][rows].tolist()))
        found.append(_later_strings(meta[rows], pieces, length))
    return found


def _union(spans: np.ndarray) -> np.ndarray:
    """Joins overlapping and touching spans of each document."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["from"], spans["th"], spans["ord"]))]
    doc = np.cumsum(np.r_[0, (spans["ord"][1:] != spans["ord"][:-1]) | (spans["th"][1:] != spans["th"][:-1])])
    # a running maximum that starts anew with each document
    shift = int(spans["to"].max()) + 1
    reach = np.maximum.accumulate(spans["to"] + doc * shift)
    new = np.r_[True, spans["from"][1:] + doc[1:] * shift > reach[:-1]]
    new[1:] |= doc[1:] != doc[:-1]
    begin = np.flatnonzero(new)
    out = spans[begin].copy()
    out["to"] = reach[np.r_[begin[1:] - 1, len(spans) - 1]] - doc[begin] * shift
    return out


def _document_spans(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    spans = _union(np.concatenate([np.frombuffer(x, _SPAN) for x in rows["meta"]]))
    new = np.flatnonzero(np.r_[True, (spans["ord"][1:] != spans["ord"][:-1]) | (spans["th"][1:] != spans["th"][:-1])])
    ends = np.r_[new[1:], len(spans)]
    pairs = np.stack([spans["from"], spans["to"]], 1)
    return pd.DataFrame({"ord": spans["ord"][new], "th": spans["th"][new], "spans": [pairs[a:e].tobytes() for a, e in zip(new, ends)]})


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """(ord, th, spans) for documents (ord, th, text): the byte ranges that repeat an earlier string, as packed pairs."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = arrow_map(docs, _count_anchors(parts, length, gram), _PACKED)
    repeated = durable(counted.groupBy("part").applyInPandas(_repeated_anchors, "part int, rest long, n long"))
    log2 = min(MAX_LOG2, max(16, (16 * repeated.count()).bit_length()))
    spot = F.pmod(F.col("rest"), F.lit(1 << log2))
    bitmap = repeated.groupBy(F.floor(spot / bloom.BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg((spot % bloom.BLOCK_BITS).cast("long")).alias("bits"))
    table = np.zeros(1 << (log2 - 3), np.uint8)
    for r in bitmap.toLocalIterator():  # at most 2**MAX_LOG2 bits
        at = r["block"] * bloom.BLOCK_BITS // 8
        table[at : at + len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), np.uint8)[: len(table) - at]
    top = repeated.filter(F.col("n") >= hot).orderBy(F.desc("n"), "part", "rest").limit(HOT_ANCHORS).collect()
    hot_keys = np.array(sorted((r["part"] << 32) + r["rest"] for r in top), np.int64)
    context = spark.sparkContext
    dealt = arrow_map(docs, _deal_contexts(parts, length, gram, context.broadcast(table), log2, context.broadcast(hot_keys)), _PACKED)
    # one task per part: the work of a part is large for its bytes, so parts are not put together
    by_document = dealt.repartition(parts, "part").groupBy("part").applyInPandas(_resolve(parts, length), "part int, meta binary")
    return by_document.groupBy("part").applyInPandas(_document_spans, "ord long, th long, spans binary")


def _cut(batches):
    for b in batches:
        out = {"ord": [], "th": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for ordinal, th, text, packed in zip(b["ord"], b["th"], b["text"], b["spans"]):
            raw, pairs = text.encode("utf-8", "surrogatepass"), np.frombuffer(packed, np.int64).reshape(-1, 2)
            kept, at = hashlib.sha256(), 0
            for begin, end in pairs.tolist():
                kept.update(raw[at:begin])
                at = end
            kept.update(raw[at:])
            for name, value in zip(out, (ordinal, th, int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs), kept.hexdigest())):
                out[name].append(value)
        yield out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   parts: int | None = None, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller id or before in
    the same one.  Ids are integers; a null id is smaller than any other.  Null texts count as empty; texts shorter than
    ``length`` lose nothing.  Rows of one id are one document given several times: their strings do not repeat each
    other at the same place.  Other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("ord"), text.alias("text"),
    ).withColumn("th", F.xxhash64("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    narrow = rows.select("no_id", "ord", "th", sha.alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    firsts = narrow.groupBy("sha").agg(F.min("ord").alias("first"))
    info = durable(narrow.join(firsts, "sha").withColumn("copy", F.col("ord") > F.col("first")))

    key = F.xxhash64("ord", "th")
    originals = bloom.repeated(info.filter("not copy and n_bytes >= " + str(length)).select(key.alias("k")), "k", least=1)
    heavy = bloom.maybe_repeated(rows.withColumn("k", key), "k", originals, "maybe").filter("maybe").select("ord", "th", "text")
    cuts = durable(spans(heavy, length, gram, parts, hot))
    with_cuts = bloom.repeated(cuts.select(key.alias("k")), "k", least=1)
    touched = bloom.maybe_repeated(heavy.withColumn("k", key), "k", with_cuts, "maybe").filter("maybe").select("ord", "th", "text")
    done = arrow_map(touched.join(cuts, ["ord", "th"]).select("ord", "th", "text", "spans"), _cut, "ord long, th long, n_removed long, n_spans long, kept_sha256 string")
    done = done.dropDuplicates(["ord", "th"])
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return info.join(done, ["ord", "th"], "left").select(
        F.when(~F.col("no_id"), F.col("ord")).cast(kind).alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
