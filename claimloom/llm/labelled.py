"""Labelled rows for the trained operators."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import apart, arrow_map, fold

# Most labelled documents a model is fitted on.
SAMPLE = 6000


def fitted(docs: DataFrame, labels: DataFrame, label: str, residue: int, modulus: int, held_out: bool, fit: Callable, limit: int = SAMPLE):
    """``fit`` of the (text, label) list of at most ``limit`` labelled rows, taken in the order of a hash of their ids.

    Rows whose crc32 leaves ``residue`` are the held-out ones if ``held_out``, else the only ones to learn from.  Null ids and
    null labels are passed over; several labels of one id count as the largest.  Only ``limit`` ids are broadcast.  The fit runs in
    one task, so the texts never reach the driver; only the model does.
    """
    usable = fold("doc_id", residue, modulus)
    usable = ~usable if held_out else usable
    seen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    ids = seen.groupBy("doc_id").agg(F.max(label).alias("y")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = ids.orderBy(*order).limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(limit)

    def run(batches):
        labelled = [(t or "", int(y)) for b in batches for t, y in zip(b["text"], b["y"])]
        yield {"model": [pickle.dumps(apart(lambda: fit(labelled)))]}

    models = arrow_map(rows.select("text", "y").coalesce(1), run, "model binary").collect()
    # an empty table may have no task at all
    return pickle.loads(models[0].model) if models else fit([])


class WordHash(dict):
    """crc32 of words, remembered up to a bound."""

    def __init__(self, key=lambda w: w, limit: int = 500_000):
        self.key, self.limit = key, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = zlib.crc32(self.key(word).encode("utf-8", "surrogatepass"))
        return value
