"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_map, fold, kept_by_worker, lower_ascii, words_of
from claimloom.llm.labelled import SAMPLE, WordHash, fitted

BITS = 20
# Training makes at least this many updates, in three passes or more.
UPDATES = 18_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1

def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashed words and word pairs of the whole text; slot 0 is the intercept and always there."""
    words = words_of(lower_ascii(text)) if text else []
    known = kept_by_worker("quality", WordHash)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two]) >> np.uint64(64 - bits)
    slots = np.unique(mixed).astype(np.int64)
    return np.r_[0, slots[slots > 0]]


def _value(slots: np.ndarray) -> np.ndarray:
    """Unit-length presence vector; the intercept stays 1."""
    x = np.full(len(slots), 1.0 / np.sqrt(max(1, len(slots) - 1)))
    x[0] = 1.0
    return x


def train(rows: list[tuple[str, int]], bits: int = BITS, updates: int = UPDATES, seed: int = 7) -> np.ndarray:
    """Weights of the 2**bits slots; all zero without rows."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    data = [(features(t, bits), y) for t, y in rows]
    rnd = np.random.default_rng(seed)

    def weights(s):
        zs = z[s]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[s])) / ALPHA + L2)
        return np.where(np.abs(zs) > L1, w, 0.0)

    for _ in range(max(3, -(-updates // max(1, len(data))))):
        for i in rnd.permutation(len(data)):
            s, y = data[i]
            w, x = weights(s), _value(s)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            step = (np.sqrt(n[s] + g * g) - np.sqrt(n[s])) / ALPHA
            z[s] += g - step * w
            n[s] += g * g
    return weights(np.arange(1 << bits)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id, score: a sparse dot product per document.  The model has a fixed size of 4 * 2**bits bytes."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = model.value.astype(np.float64)
        for b in batches:
            scores = []
            for text in b["text"]:
                s = features(text, bits)
                scores.append(float(1 / (1 + np.exp(-np.clip(w[s] @ _value(s), -30, 30)))))
            yield {"doc_id": b["doc_id"], "score": scores}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, residue: int, modulus: int, threshold: float, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; trained on labelled rows that are not held out.

    A null or empty text is scored by the intercept.  Without labelled rows every score is 0.5.  Null ids are scored and not
    held out; repeated rows are scored alike; other columns are ignored; an empty table gives an empty result.
    """
    scored = score(docs, fitted(docs, labels, "quality", residue, modulus, True, train, limit))
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", fold("doc_id", residue, modulus).alias("held_out"), "score", predicted.alias("predicted"))
