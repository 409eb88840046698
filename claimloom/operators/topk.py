"""Exact top-k over posting lists with early termination: lists that cannot change a result are not expanded.

A query has weighted needles; an item scores at most the weight of the needles it holds.  Needles are taken from the rarest to
the most frequent, so an item that is first met at the j-th needle can score no more than the needles from j on weigh.
The first items of every list give each query a k-th best score to beat; a list is then expanded whole only where that
bound lies above it, up to the k-th item where it equals it (ties go to smaller items), and not at all below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.joins import salted_join, shuffled
from claimloom.session import durable

# Scores nearer than this count as equal when a bound is compared with them.
_EPS = 1e-7


def rare_first(needles: DataFrame, postings: DataFrame, scope: list[str], combine: str = "sum") -> DataFrame:
    """Needles that occur, with their place from the rarest on and the bound of items first met there.

    needles: query_id, scope, needle, part, weight and, if wanted, ``least``.  Needles of one part weigh once (words of one name), and only
    where at least ``least`` of them are left.  ``combine`` adds the weights of parts (sum), takes the largest (max), or says that every
    needle is a part of its own and all of a query weigh the same (each), which needs no look at the rest of the list.
    """
    lists = postings.groupBy(*scope, "needle").agg(F.count("*").alias("n_items"))
    least = F.col("least") if "least" in needles.columns else F.lit(1)
    # one group is the needles of one query
    rows = needles.join(shuffled(lists), [*scope, "needle"]).groupBy("query_id", *scope).agg(
        F.array_sort(F.collect_list(F.struct("n_items", "needle", "part", "weight", least.alias("least")))).alias("list")
    )

    def bound(j: Column) -> Column:
        if combine == "each":
            return (F.size("list") - j) * F.get("list", F.lit(0))["weight"]
        left = F.slice("list", j + 1, F.size("list"))
        parts = F.array_distinct(F.transform(left, lambda x: F.struct(x["part"].alias("part"), x["weight"].alias("weight"), x["least"].alias("least"))))
        live = F.filter(parts, lambda p: (p["least"] <= 1) | (F.size(F.filter(left, lambda x: x["part"] == p["part"])) >= p["least"]))
        join = (lambda t, x: t + x["weight"]) if combine == "sum" else (lambda t, x: F.greatest(t, x["weight"]))
        return F.aggregate(live, F.lit(0.0), join)

    bounds = F.transform("list", lambda x, j: F.struct(x["needle"].alias("needle"), j.alias("place"), bound(j).alias("bound")))
    return rows.select("query_id", *scope, F.explode(bounds).alias("x")).select("query_id", *scope, "x.*").filter("bound > 0")


def _ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item"))))


def seed_pairs(ordered: DataFrame, postings: DataFrame, k: int, scope: list[str]) -> DataFrame:
    """(query_id, item) of the k first items of each of its needles."""
    w = Window.partitionBy(*scope, "needle").orderBy("item")
    heads = postings.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")
    return ordered.select("query_id", *scope, "needle").join(shuffled(heads), [*scope, "needle"]).select("query_id", "item").distinct()


def open_pairs(ordered: DataFrame, postings: DataFrame, seeds: DataFrame, k: int, scope: list[str], least: float = 0.0) -> DataFrame:
    """(query_id, item) that may still be among the k best, without the scored ``seeds``."""
    kth = _ranked(seeds).filter(F.col("rank") == k).select("query_id", F.col("score").alias("to_beat"), F.col("item").alias("last"))
    rows = ordered.join(shuffled(kth), "query_id", "left").filter(F.col("bound") >= least - _EPS)
    # a query without k seeds has nothing to beat
    rows = rows.filter(F.col("to_beat").isNull() | (F.col("bound") >= F.col("to_beat") - _EPS))
    whole = F.col("to_beat").isNull() | (F.col("bound") > F.col("to_beat") + _EPS)
    met = salted_join(postings, rows.select("query_id", *scope, "needle", "last", whole.alias("whole")), [*scope, "needle"], ["item"])
    met = met.filter(F.col("whole") | (F.col("item") < F.col("last"))).select("query_id", "item").distinct()
    return met.join(shuffled(seeds.select("query_id", "item")), ["query_id", "item"], "left_anti")


def best(needles: DataFrame, postings: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, scope: list[str], least: float = 0.0,
         combine: str = "sum") -> DataFrame:
    """query_id, item, score, rank of the k best items per query; equal scores rank by item.

    postings: scope, needle, item; they are read several times, so callers store them.  ``score`` maps (query_id, item) to rows with
    ``score``, leaving out pairs that do not count; no score exceeds what the needles that the item holds weigh together.  Items that
    score below ``least`` may be left out.
    """
    ordered = durable(rare_first(needles, postings, scope, combine))
    seeds = durable(score(seed_pairs(ordered, postings, k, scope)).select("query_id", "item", "score"))
    rest = score(open_pairs(ordered, postings, seeds, k, scope, least)).select("query_id", "item", "score")
    return _ranked(seeds.unionByName(rest)).filter(F.col("rank") <= k)


def held_weight(needles: DataFrame, postings: DataFrame, scope: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Score of a pair: the summed weight of the query's needles that the item holds, looked up pair by pair."""

    def score(pairs: DataFrame) -> DataFrame:
        asked = pairs.join(shuffled(needles.select("query_id", *scope, "needle", "weight")), "query_id")
        return asked.join(shuffled(postings), [*scope, "needle", "item"]).groupBy("query_id", "item").agg(F.sum("weight").alias("score"))

    return score
