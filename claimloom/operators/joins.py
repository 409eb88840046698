"""Join helpers for keys that may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config


def spread(*cols: str, ways: int = config.SALTS) -> Column:
    """Deterministic salt from the columns that identify a row (safe under task retries)."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(ways)).cast("int")


def shuffled(side: DataFrame) -> DataFrame:
    """Marks a join side that grows with the input: joined with it, both sides are shuffled.

    The optimiser guesses the size of a side from its packed files, exploded and computed columns left out, and would send
    such a side whole through the driver.
    """
    return side.hint("merge")


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", ways: int = config.SALTS
) -> DataFrame:
    """Equi-join where one key of ``big`` may be hot.

    Rows of ``big`` are split ``ways`` ways by the columns ``by``; ``small`` is copied once per way.
    ``how`` may be inner, left, left_semi or left_anti (``big`` is the left side).
    """
    left = big.withColumn("_salt", spread(*by, ways=ways))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.join(shuffled(right), on + ["_salt"], how).drop("_salt")


def salted_agg(df: DataFrame, keys: list[str], by: list[str], partial: list[Column], final: list[Column],
               ways: int = config.SALTS) -> DataFrame:
    """Two-step aggregation: first per (key, salt), then per key."""
    first = df.withColumn("_salt", spread(*by, ways=ways)).groupBy(*keys, "_salt").agg(*partial)
    return first.groupBy(*keys).agg(*final)


def fetch(rows: DataFrame, wide: DataFrame, on: list[str]) -> DataFrame:
    """Adds texts or vectors to ``rows``: the wide side is cut down to the wanted keys first and is never copied; a hot key
    of ``rows`` is split by adaptive execution."""
    return rows.join(wide.join(rows.select(*on).distinct(), on, "left_semi"), on)
