"""Toxicity by a linear-chain conditional random field.

The tables label documents, the field needs labelled tokens: words that occur in toxic documents more often than
chance explains, and hardly elsewhere, mark the toxic tokens.  The field learns them from the word, its beginnings and its two neighbours, runs
forward and backward over every token of every text, and its marginals give the document score and the offending offsets.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import WORD, arrow_map, fold, give_back, kept_by_worker, lower_ascii, words_of
from claimloom.llm.labelled import SAMPLE, fitted

# Lengths of the word beginnings that are features besides the whole word.
PREFIXES = (3, 5, 7)
EPOCHS = 6
RATE = 0.5
L2 = 1e-4
# Words of the documents that go through the recursions together: bounds the memory of a task.
TOKENS_AT_ONCE = 400_000
# Tokens of one segment of a document.
SEGMENT = 256
_EDGE = re.compile(r"^\W+|\W+$")


def shape(word: str) -> str:
    """Lower case without punctuation at the ends."""
    if word.isascii():
        return word.lower().strip(punctuation) or word
    return _EDGE.sub("", lower_ascii(word)) or word


def features(word: str) -> tuple[str, ...]:
    """The word and its beginnings, each with its length as a mark (0: the whole word)."""
    w = shape(word)
    return ("0" + w, *(f"{n}{w[:n]}" for n in PREFIXES if len(w) > n))


def distinct_documents(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without those that share a minimum hash of word triples with an earlier one: copies would vote together."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in rows:
        w = words_of(text)
        hashes = np.array([zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 2))], np.uint32)
        mins = {(k, int((hashes ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)).min())) for k in range(4)}
        if seen.isdisjoint(mins):
            out.append((text, y))
        seen |= mins
    return out


def toxic_words(rows: list[tuple[str, int]], precision: float = 0.9) -> set[str]:
    """Shapes of words that mark toxic documents.

    A word counts if, at equal numbers of toxic and other documents, it would be found in toxic ones with the given precision,
    and if chance does not explain that: its log likelihood ratio exceeds the logarithm of the number of words tried.
    """
    toxic, clean, n = Counter(), Counter(), [0, 0]
    for text, y in distinct_documents(rows):
        (toxic if y else clean).update({shape(w) for w in words_of(text)})
        n[1 if y else 0] += 1
    if not min(n):
        return set()
    rate, share, tried = n[1] / sum(n), n[0] / n[1], np.log(len(toxic.keys() | clean.keys()))
    found = set()
    for w, k in toxic.items():
        c = clean[w]
        p = k / (k + c)
        gain = k * np.log(p / rate) + (c * np.log((1 - p) / (1 - rate)) if c else 0.0)
        if gain > tried and k * share >= precision * (k * share + c):
            found.add(w)
    return found


class Packed:
    """Token arrays of several documents laid out so that one step of a recursion is one slice.

    Documents are cut in segments of at most SEGMENT tokens, the longest first, by place in the segment.  The recursions run over
    all segments at once; what enters a segment comes from the products of the matrices of those before (or after) it, so
    the marginals are those of the whole document.
    """

    def __init__(self, lengths: np.ndarray, segment: int = SEGMENT):
        count = -(-lengths // segment)
        self.place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        sizes = np.minimum(segment, np.repeat(lengths, count) - self.place * segment)
        self.last = self.place == np.repeat(count - 1, count)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        longest = int(self.sizes[0]) if len(sizes) else 0
        self.width = np.searchsorted(-self.sizes, -np.arange(longest), side="left").tolist()
        self.start = np.r_[0, np.cumsum(self.width)].astype(np.int64).tolist()
        self.rank = np.empty(len(sizes), np.int64)
        self.rank[self.order] = np.arange(len(sizes))
        position = np.arange(lengths.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.at = np.array(self.start)[position] + np.repeat(self.rank, sizes)
        self.first = self.place[self.order] == 0
        self.chained = bool(len(count)) and int(count.max()) > 1

    def _entering(self, e: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward vector before and backward vector at the end of each segment, in packed order."""
        n = len(self.order)
        before, behind = np.full((n, 2), 0.5), np.ones((n, 2))
        if not self.chained:
            return before, behind
        product = m[None] * e[:n, None, :]
        for t in range(1, len(self.width)):
            a, w = self.start[t], self.width[t]
            x = (product[:w] @ m) * e[a : a + w, None, :]
            product[:w] = x / x.max((1, 2), keepdims=True)
        product[self.first] = 0
        for step in range(1, int(self.place.max()) + 1):
            now = np.flatnonzero(self.place == step)
            here, prior = self.rank[now], self.rank[now - 1]
            if step == 1:
                x = self._first_segments(e, m, prior)
            else:
                x = (before[prior][:, None, :] @ product[prior])[:, 0]
            before[here] = x / x.sum(1, keepdims=True)
        for step in range(int(self.place.max()), 0, -1):
            now = np.flatnonzero(self.place == step)
            here, prior = self.rank[now], self.rank[now - 1]
            x = (product[here] @ behind[here][:, :, None])[:, :, 0]
            behind[prior] = x / x.sum(1, keepdims=True)
        return before, behind

    def _first_segments(self, e: np.ndarray, m: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Forward vectors at the end of full first segments."""
        x = e[which]
        for t in range(1, len(self.width)):
            x = (x @ m) * e[self.start[t] + which]
            x = x / x.sum(1, keepdims=True)
        return x

    def marginals(self, emission: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each packed token, and the expected number of each of the four tag pairs."""
        total, n = len(emission), len(self.order)
        e = np.ones((total, 2))
        e[:, 1] = np.exp(np.clip(emission, -30, 30))
        m = np.exp(move)
        before, behind = self._entering(e, m)
        forward, backward = np.empty((total, 2)), np.ones((total, 2))
        back = m.T.copy()
        pairs = np.zeros((2, 2))
        for t, w in enumerate(self.width):
            a = self.start[t]
            if t:
                p = self.start[t - 1]
                x = (forward[p : p + w] @ m) * e[a : a + w]
            else:
                x = np.where(self.first[:, None], 1.0, before @ m) * e[:n]
            x /= x[:, :1] + x[:, 1:]
            forward[a : a + w] = x
        if n:
            backward[np.array(self.start)[self.sizes - 1] + np.arange(n)] = behind
        for t in range(len(self.width) - 1, -1, -1):
            a, w = self.start[t], self.width[t]
            x = e[a : a + w] * backward[a : a + w]
            y = x @ back
            f = forward[self.start[t - 1] : self.start[t - 1] + w] if t else before
            scaled = f / ((f * y).sum(1, keepdims=True))
            if t:
                backward[self.start[t - 1] : self.start[t - 1] + w] = y / (y[:, :1] + y[:, 1:])
            else:
                scaled = scaled[~self.first]
                x = x[~self.first]
            pairs += scaled.T @ x * m
        both = forward * backward
        return both[:, 1] / both.sum(1), pairs


# Words that a worker remembers between the tasks of one model: bounds its memory.
KNOWN_WORDS = 250_000


class _Rows(dict):
    """Row number of each word; a new word gets the next row, with the slots of its features and their summed weights."""

    def __init__(self, slot_of: dict[str, int], weight: np.ndarray):
        self.slot_of, self.weight = slot_of, weight
        self.new: list[list[int]] = []
        self.slots = np.zeros((0, 3 + len(PREFIXES)), np.int32)
        self.sums = np.zeros((0, 3))

    def __missing__(self, word: str) -> int:
        own = features(word)
        find = self.slot_of.get
        at = [find(f, 0) for f in own]
        self.new.append(at + [0] * (1 + len(PREFIXES) - len(at)) + [find(">" + own[0], 0), find("<" + own[0], 0)])
        self[word] = len(self.slots) + len(self.new) - 1
        return self[word]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words, document after document, and the lengths of the documents."""
        if len(self) > KNOWN_WORDS:
            self.__init__(self.slot_of, self.weight)
            self.clear()
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        rows = np.concatenate([np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in words] or [np.zeros(0, np.int64)])
        if self.new:
            fresh = np.array(self.new, np.int32)
            self.slots = np.concatenate([self.slots, fresh])
            w = self.weight[fresh]
            self.sums = np.concatenate([self.sums, np.stack([w[:, :-2].sum(1), w[:, -2], w[:, -1]], 1)])
            self.new = []
        return rows, lengths


def _neighbours(values: np.ndarray, before: np.ndarray, after: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token what the words before and after it contribute (0 at the ends of a document)."""
    left, right = np.zeros_like(before[values]), np.zeros_like(after[values])
    if len(values):
        left[1:], right[:-1] = before[values[:-1]], after[values[1:]]
        ends, some = np.cumsum(lengths), lengths > 0
        left[(ends - lengths)[some]] = 0
        right[ends[some] - 1] = 0
    return left, right


class Field:
    """A weight per feature seen in training (slot 0 stands for all others and stays 0), a bias and the tag moves."""

    def __init__(self):
        self.slot_of: dict[str, int] = {}
        self.weight, self.bias, self.move, self.scale = np.zeros(1), -4.0, np.zeros((2, 2)), (0.5, -3.0)

    def token_marginals(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of each word of each text; documents of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        group, size = [], 0
        name = hashlib.sha256(self.weight.tobytes() + "\n".join(self.slot_of).encode("utf-8", "surrogatepass")).hexdigest()
        known = kept_by_worker(("toxicity", name), lambda: _Rows(self.slot_of, self.weight))

        def flush():
            rows, lengths = known.of([texts[i] for i in group])
            left, right = _neighbours(rows, known.sums[:, 1], known.sums[:, 2], lengths)
            packed = Packed(lengths)
            e = np.empty(len(rows))
            e[packed.at] = self.bias + known.sums[rows, 0] + left + right
            p = packed.marginals(e, self.move)[0][packed.at] if len(e) else e
            for i, part in zip(group, np.split(p, np.cumsum(lengths)[:-1])):
                out[i] = part

        for i in order:
            group.append(i)
            size += len(texts[i]) // 4 + 1
            if size > TOKENS_AT_ONCE:
                flush()
                group, size = [], 0
        if group:
            flush()
        return out

    def fit(self, rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> "Field":
        """Gradient steps on the conditional likelihood of the tags (toxic documents and as many others), then a
        logistic curve from the pooled marginals of all rows to the document labels."""
        marked = toxic_words(rows)
        toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
        rnd = np.random.default_rng(seed)
        chosen = toxic + [clean[i] for i in rnd.permutation(len(clean))[: max(len(toxic), 50)]]
        rnd.shuffle(chosen)
        chosen = chosen if marked else []
        seen_in = Counter(f for t in chosen for f in {f for w in set(words_of(t)) for f in features(w)})
        kept = sorted(f for f, n in seen_in.items() if n > 1)
        self.slot_of = {f: i + 1 for i, f in enumerate(kept + [m + f for m in "<>" for f in kept if f[0] == "0"])}
        self.weight = np.zeros(len(self.slot_of) + 1)
        known, ready = _Rows(self.slot_of, self.weight), []
        for b in (chosen[i : i + 40] for i in range(0, len(chosen), 40)):
            words, lengths = known.of(b)
            if len(words):
                slots = np.concatenate([known.slots[words, :-2].T, np.stack(_neighbours(words, known.slots[:, -2], known.slots[:, -1], lengths))])
                tags = np.array([shape(w) in marked for t in b for w in words_of(t)], np.float64)
                ready.append((slots, lengths, Packed(lengths), tags))
        g_weight, g_rest = np.full(len(self.weight), 1e-6), np.full(5, 1e-6)
        for _ in range(epochs):
            for k in rnd.permutation(len(ready)):
                slots, lengths, packed, tags = ready[k]
                e = np.empty(len(tags))
                e[packed.at] = self.bias + self.weight[slots].sum(0)
                p, pairs = packed.marginals(e, self.move)
                miss = (tags - p[packed.at]) / len(lengths)
                seen = np.zeros((2, 2))
                inside = np.ones(len(tags), bool)
                inside[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
                now, last = tags[inside].astype(int), np.r_[0, tags[:-1]][inside].astype(int)
                np.add.at(seen, (last, now), 1)
                g = np.bincount(slots.ravel(), np.tile(miss, len(slots)), len(self.weight)) - L2 * self.weight
                g[0] = 0
                g_weight += g * g
                self.weight += rate * g / np.sqrt(g_weight)
                grad = np.r_[miss.sum(), ((seen - pairs) / len(lengths)).ravel()]
                g_rest += grad * grad
                step = rate * grad / np.sqrt(g_rest)
                self.bias += step[0]
                self.move += step[1:].reshape(2, 2)
        pooled = np.array([pool(p) for p in self.token_marginals([t for t, _ in rows])])
        self.scale = _curve(pooled, np.array([y for _, y in rows], dtype=float))
        return self

    def document_score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] * pool(p) + self.scale[1], -30, 30))))


def pool(p: np.ndarray) -> float:
    """Log odds that at least one token is toxic."""
    none = float(np.log1p(-np.clip(p, 0, 1 - 1e-9)).sum()) if len(p) else 0.0
    return float(np.clip(np.log(max(-np.expm1(none), 1e-12)) - none, -12, 12))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge."""
    a, b = 0.5, 0.0
    if not len(x):
        return a, b
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 0.1 * (a - 0.5), (y - p).sum() - 0.01 * b])
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.0, a + step[0]), b + step[1]
    return float(a), float(b)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, n_toxic (tokens more likely toxic than not), spans (their character offsets; neighbours joined)."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    word = re.compile(WORD)

    def spans(text: str, p: np.ndarray) -> list[dict]:
        found: list[dict] = []
        last = -2
        for i, m in enumerate(word.finditer(text)):
            if p[i] >= 0.5:
                if i == last + 1:
                    found[-1]["end"] = m.end()
                else:
                    found.append({"start": m.start(), "end": m.end()})
                last = i
        return found

    def run(batches):
        f = model.value
        for b in batches:
            texts = [t or "" for t in b["text"]]
            marg = f.token_marginals(texts)
            n = [int((p >= 0.5).sum()) for p in marg]
            yield {
                "doc_id": b["doc_id"], "score": [f.document_score(p) for p in marg], "n_toxic": n,
                "spans": [spans(t, p) if k else [] for t, p, k in zip(texts, marg, n)],
            }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, n_toxic int, spans array<struct<start:int,end:int>>")


def keep_clean(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, in one pass without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([f.document_score(p) < threshold for p in f.token_marginals(texts)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, residue: int, modulus: int, limit: int = SAMPLE) -> Field:
    return fitted(docs, labels, "toxic", residue, modulus, True, lambda rows: Field().fit(rows), limit)


def classify(docs: DataFrame, labels: DataFrame, residue: int, modulus: int, threshold: float = 0.5, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic, spans for every document, trained on labelled rows that are not held out.

    A null or empty text has no tokens and gets the score of a text without toxic tokens.  Without labelled toxic rows all
    scores are low.  Null ids are scored and not held out; repeated rows are scored alike; other columns are
    ignored; an empty table gives an empty result.
    """
    scored = score(docs, train(docs, labels, residue, modulus, limit))
    return scored.select(
        "doc_id", fold("doc_id", residue, modulus).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "n_toxic", "spans",
    )
