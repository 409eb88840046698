"""Exact de-duplication by two-pass Bloom filtering.

The first pass sets the bits of hashes that occur more than once, the second sends only rows that hit such bits through a
shuffle; all others are known to be unique where they stand.  False passes cost a few rows in the shuffle and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import bloom


# Groups of copies that are broadcast, the largest first.
HOT_GROUPS = 1_000


def _sha(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def _split(rows: DataFrame, log2_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, sha, ...) as unique ones, candidates, and the groups of the candidates."""
    bits = bloom.repeated(rows.select("sha"), "sha", log2_bits)
    probed = bloom.maybe_repeated(rows, "sha", bits, "maybe", log2_bits)
    candidates = probed.filter("maybe").drop("maybe")
    # copies are added up in each task first, so a text that fills a third of the table is one row per task
    groups = candidates.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return probed.filter("not maybe").drop("maybe"), candidates, groups


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2_bits: int = bloom.LOG2_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; the largest id stays.  A null text counts as empty, and all empty texts are one group.  A null
    id is smaller than any other; a group of null ids only has a null keep_id and stays.  Rows that repeat both id and
    text share the decision.  An empty table gives an empty result; other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), _sha(text_col).alias("sha"))
    unique, candidates, groups = _split(rows, log2_bits)
    alone = unique.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    # groups that could fill a task meet their rows by broadcast: no more than HOT_GROUPS rows
    hot = groups.orderBy(F.desc("group_size"), "sha").limit(HOT_GROUPS)
    by_hot = candidates.join(F.broadcast(hot), "sha", "left")
    rest = by_hot.filter("group_size is null").select("id", "sha").join(groups, "sha")
    columns = ["id", "keep_id", "group_size", "sha"]
    grouped = by_hot.filter("group_size is not null").select(columns).unionByName(rest.select(columns))
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2_bits: int = bloom.LOG2_BITS) -> DataFrame:
    """The rows of ``df`` that :func:`mark` keeps, with all their columns, whatever their names."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(id_col).alias("id"), _sha(text_col).alias("sha"))
    unique, candidates, groups = _split(rows, log2_bits)
    winners = groups.select(F.col("sha").alias("won_sha"), "keep_id")
    stay = candidates.join(winners, (F.col("sha") == F.col("won_sha")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return unique.select("row").unionByName(stay.select("row")).select("row.*")
