"""Mixing sources to target weights by minimum-cost flow.

A document may belong to several sources.  Documents are added up by membership pattern; the flow routes the tokens of the
patterns to the quotas of the sources, each further repetition of a pattern at a higher cost, so that repeats are used only
where fresh tokens run out.  Only one row per pattern reaches the driver: patterns are sets of catalogue entries and their
number does not follow the number of documents.  Which documents of a pattern are taken is a seeded order, decided in Spark.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import durable

MAX_REPEATS = 3
SEED = "mix-1"
# Documents of a pattern are ordered by a seeded digest; its first three hexadecimal digits name one of 4096 buckets.
DIGITS = 3


def weighted_targets(sizes: dict, weights: dict, cap: int = MAX_REPEATS) -> dict:
    """Shares of the sum of all sizes by weight; none above ``cap`` times its size, the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (cap * sizes[s] / weights[s], s is None, s))
    left, weight = sum(sizes.values()), sum(weights[s] for s in sizes)
    level = 0.0
    for s in order:
        level = left / weight
        if cap * sizes[s] / weights[s] >= level:
            break
        left, weight = left - cap * sizes[s], weight - weights[s]
    return {s: min(float(cap * sizes[s]), level * weights[s]) for s in sizes}


class _Flow:
    """Maximum flow by level graphs; edges added later continue from the flow that is there."""

    def __init__(self, nodes: int):
        self.to, self.room, self.out = [], [], [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def push(self, source: int, sink: int) -> None:
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return
            at = [0] * len(self.out)
            while self._augment(source, sink, level, at):
                pass

    def _augment(self, source, sink, level, at) -> bool:
        path, a = [], source
        while a != sink:
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                if self.room[e] and level.get(self.to[e], -1) == level[a] + 1:
                    break
                at[a] += 1
            else:
                if not path:
                    return False
                a = self.to[path.pop() ^ 1]
                at[a] += 1
                continue
            path.append(e)
            a = self.to[e]
        amount = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= amount
            self.room[e ^ 1] += amount
        return True


def route(patterns: dict, quotas: dict, repeats: int = MAX_REPEATS) -> dict:
    """Tokens that each pattern gives: {pattern: {source: tokens}}.

    ``patterns`` maps a tuple of sources to its size.  Repetition k of a pattern costs more than repetition k - 1 (convex), and
    only edges out of the origin cost anything; so the cheapest flow is found layer by layer: all first copies are
    routed as far as they go, then second copies are allowed, and so on.
    """
    names, sources = sorted(patterns, key=str), sorted(quotas, key=lambda s: (s is None, s))
    at = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    flow = _Flow(2 + len(names) + len(sources))
    for s in sources:
        flow.edge(at[s], 1, int(quotas[s] + 0.5))
    routes = {(p, s): flow.edge(2 + i, at[s], repeats * patterns[p]) for i, p in enumerate(names) for s in p if s in at}
    for _ in range(repeats):
        for i, p in enumerate(names):
            flow.edge(0, 2 + i, patterns[p])
        flow.push(0, 1)
    return {p: {s: flow.room[routes[p, s] ^ 1] for s in p if s in at} for p in names}


def _digest(seed: str):
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))


def take(docs: DataFrame, tokens: DataFrame, seed: str = SEED) -> DataFrame:
    """How much of each document (id, pattern, size) is taken when its pattern gives ``tokens`` (pattern, copies, rest).

    Adds ``copies``, ``part`` and ``taken`` = copies * size + part: all documents of a pattern are taken ``copies`` times, and
    once more those that come first in the seeded order, until ``rest`` tokens are reached; the last gives only its first tokens.
    """
    keyed = docs.withColumn("digest", _digest(seed)).withColumn("bucket", F.substring("digest", 1, DIGITS))
    sums = keyed.groupBy("pattern", "bucket").agg(F.sum("size").alias("bucket_size"))
    # at most 4096 rows per pattern
    earlier = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("pattern", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(tokens, "pattern")
    # one bucket of one pattern: a 4096th of its documents, without their texts
    within = Window.partitionBy("pattern", "bucket").orderBy("digest", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(starts, ["pattern", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.select("id", "pattern", "size", "digest", "copies", part.alias("part"), (F.col("copies") * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, quotas: dict, repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Takes from documents (id, sources array<string>, size) what fills ``quotas`` (source to tokens).

    Returns id, pattern (the sources as a JSON list), size, taken; no document gives more than ``repeats`` times its size.
    Sources may be null entries.  Documents without sources, or of size 0 or null, give nothing.  Rows that repeat
    an id are separate documents.  The same input and seed give the same result.
    """
    named = _named(docs)
    return take(named, _tokens(named, quotas, repeats), seed).select("id", "pattern", "size", "taken")


def _named(docs: DataFrame) -> DataFrame:
    sources = F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))
    return docs.select("id", F.to_json(sources).alias("pattern"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def _tokens(named: DataFrame, quotas: dict, repeats: int) -> DataFrame:
    """(pattern, copies, rest): what the flow takes of each pattern, as whole passes and the rest."""
    # the join needs the text that Spark wrote: other libraries escape control characters otherwise
    written = {tuple(json.loads(r.pattern)): (r.pattern, r.n) for r in named.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    given = route({p: n for p, (_, n) in written.items()}, quotas, repeats)
    rows = [(text, *(divmod(sum(given[p].values()), n) if n else (0, 0))) for p, (text, n) in written.items()]
    return named.sparkSession.createDataFrame(rows, "pattern string, copies long, rest long")


def mixed_rows(docs: DataFrame, id_col: str, sources_col, size_col, quotas: dict, repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Documents stay whole: the one that :func:`take` would cut is taken if at least half of it would be.  Each row decides by
    its own digest and the limit of its pattern, so texts are not shuffled.
    """
    narrow = durable(_named(docs.select(docs[id_col].alias("id"), sources_col.alias("sources"), size_col.alias("size"))))
    tokens = _tokens(narrow, quotas, repeats)
    order = F.struct(F.col("digest"), F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))).alias("i"))
    extra = F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), order)
    limits = take(narrow, tokens, seed).groupBy("pattern").agg(F.first("copies").alias("copies"), F.max(extra).alias("limit"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), sources_col.alias("sources"), F.lit(0).alias("size"))
    rows = rows.select("row", "id", F.to_json(F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))).alias("pattern"))
    times = F.col("copies") + F.coalesce((order <= F.col("limit")).cast("int"), F.lit(0))
    placed = rows.withColumn("digest", _digest(seed)).join(limits, "pattern").withColumn("times", times.cast("int"))
    return placed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
