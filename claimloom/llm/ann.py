"""Nearest neighbours by collision counting.

Every vector has one real projection per hash function, kept as sorted arrays.  Around a query's projections windows grow by
virtual rehashing (each radius is ``growth`` times the one before, and only the newly covered ends are visited).  A vector that
falls into the windows of at least ``threshold`` of the functions is verified by its true distance.  A query ends when its
windows are as wide as its k-th nearest verified distance: a nearer vector would have collided often enough by then.

Vectors and queries meet in blocks of a bounded size; each block pair returns k rows per query, and these are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUNCTIONS = 64
# Share of the functions that must collide.  At the last radius a vector at the k-th distance collides with probability
# 0.683 in each, so that it misses the threshold of 64 functions with probability below 0.01.
THRESHOLD = 0.55
GROWTH = 1.3
BLOCK_VECTORS = 32_768
BLOCK_QUERIES = 2_048
SEED = 20_240


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not empty, not zero and have no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class Collisions:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, functions: int = FUNCTIONS, threshold: float = THRESHOLD, growth: float = GROWTH, seed: int = SEED):
        self.vectors, self.growth = vectors, growth
        self.least = max(1, int(np.ceil(threshold * functions)))
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1], functions))
        projected = vectors @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.values = np.sort(projected, axis=0).T.copy()
        spread = (self.values[:, -1] - self.values[:, 0]).max()
        # the first windows hold a few vectors
        self.first = max(spread / 200, np.finfo(float).tiny * 1e10)

    def nearest(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of about the k nearest vectors and all that tie with them; ``skip`` marks positions to leave out."""
        n = len(self.vectors)
        at = query @ self.directions
        low = np.array([np.searchsorted(v, x) for v, x in zip(self.values, at)])
        high = low.copy()
        hits = np.zeros(n, np.int16)
        distance = np.full(n, np.inf)
        waiting = ~skip
        radius, kth = self.first, np.inf
        while True:
            for j, (v, x) in enumerate(zip(self.values, at)):
                a, b = np.searchsorted(v, x - radius, "left"), np.searchsorted(v, x + radius, "right")
                a, b = min(a, low[j]), max(b, high[j])
                if a < low[j]:
                    hits[self.order[j, a : low[j]]] += 1
                if b > high[j]:
                    hits[self.order[j, high[j] : b]] += 1
                low[j], high[j] = a, b
            new = np.flatnonzero(waiting & (hits >= self.least))
            if len(new):
                waiting[new] = False
                distance[new] = np.sqrt(((self.vectors[new] - query) ** 2).sum(1))
                found = distance[~waiting & ~skip]
                if len(found) >= k:
                    kth = np.partition(found, k - 1)[k - 1]
            if radius >= kth or (low == 0).all() and (high == n).all():
                break
            radius *= self.growth
        # the block's k nearest with every tie of the last one, so that the merge can settle ties by id
        verified = np.flatnonzero(~waiting & ~skip)
        keep = verified[distance[verified] <= kth]
        return keep, distance[keep]


def _search(k: int, functions: int, threshold: float, growth: float, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        base, asked = rows[~rows["query"]], rows[rows["query"]]
        if len(base) and len(asked):
            ids = base["vec_id"].to_numpy()
            index = Collisions(np.array(base["vector"].tolist(), np.float64), functions, threshold, growth, seed)
            for q, v in zip(asked["vec_id"], asked["vector"]):
                at, d = index.nearest(np.asarray(v, np.float64), k, ids == q)
                best = np.lexsort((ids[at], d))[:k]
                out += [(q, int(ids[at[i]]), float(d[i])) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, functions: int = FUNCTIONS, threshold: float = THRESHOLD, growth: float = GROWTH,
           seed: int = SEED, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by Euclidean distance and then id; fewer if there are fewer.

    Both tables have vec_id and embedding; other columns are ignored.  Rows with a null id or an unusable vector take no part.
    Rows with a query's id are its own and never its neighbours; other rows of one id are separate neighbours.  Only
    vectors of equal length are compared.  Every vector is indexed.
    """
    def clean(df: DataFrame) -> DataFrame:
        rows = df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("length"))

    base, asked = clean(vectors), clean(queries)
    vector_blocks = max(1, -(-base.count() // block_vectors))
    query_blocks = max(1, -(-asked.count() // block_queries))

    def own(ways: int):
        return F.pmod(F.xxhash64("vec_id", "vector"), F.lit(ways)).cast("int")

    def each(ways: int):
        return F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))

    spread = base.withColumn("query", F.lit(False)).withColumn("v", own(vector_blocks)).withColumn("q", each(query_blocks))
    put = asked.withColumn("query", F.lit(True)).withColumn("q", own(query_blocks)).withColumn("v", each(vector_blocks))
    found = spread.unionByName(put).groupBy("length", "v", "q").applyInPandas(_search(k, functions, threshold, growth, seed), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
