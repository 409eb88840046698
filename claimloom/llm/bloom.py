"""Filters of repeated hashes, built and probed with SQL functions only.

A filter has 2**log2_bits bits in blocks of 32768; a hash owns two bits of one block.  Only bits that at least two rows
hit are set, so a hash passes when it may be repeated.  The whole filter has at most 2**log2_bits / 8 bytes: that is the
proven bound that allows its broadcast.  More hashes than bits only mean more false passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.joins import shuffled

BLOCK_BITS = 32768
LOG2_BITS = 27


def _block(h: Column, log2_bits: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(1)), F.lit(2 ** (log2_bits - 15))).cast("int")


def _positions(h: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(BLOCK_BITS)).cast("int") for k in (2, 3)]


def repeated(rows: DataFrame, col: str, log2_bits: int = LOG2_BITS, least: int = 2) -> DataFrame:
    """First pass: block and bits of the filter.  Each task adds up its rows per bit before anything moves.

    ``least`` rows must hit a bit to set it: 2 for a filter of repeated values, 1 for a filter of all values.
    """
    hits = rows.select(
        _block(F.col(col), log2_bits).alias("bloom_block"),
        F.explode(F.array_distinct(F.array(*_positions(F.col(col))))).alias("bloom_bit"),
    )
    twice = hits.groupBy("bloom_block", "bloom_bit").count().filter(F.col("count") >= least)
    return twice.groupBy("bloom_block").agg(F.bitmap_construct_agg(F.col("bloom_bit").cast("long")).alias("bloom_bits"))


def _bit(position: Column) -> Column:
    byte = F.conv(F.hex(F.call_function("substring", F.col("bloom_bits"), F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.call_function("shiftright", byte.cast("int"), position % 8).bitwiseAND(F.lit(1)) == 1


def maybe_repeated(rows: DataFrame, col: str, bits: DataFrame, flag: str, log2_bits: int = LOG2_BITS) -> DataFrame:
    """Second pass: ``rows`` with a boolean that is true for every repeated value and false for nearly all others."""
    keyed = rows.withColumn("bloom_block", _block(F.col(col), log2_bits))
    first, second = _positions(F.col(col))
    hit = F.coalesce(_bit(first) & _bit(second), F.lit(False))
    return keyed.join(F.broadcast(bits), "bloom_block", "left").withColumn(flag, hit).drop("bloom_block", "bloom_bits")


def without(df: DataFrame, ids: DataFrame, col: str, log2_bits: int = LOG2_BITS) -> DataFrame:
    """The rows of ``df`` whose ``col`` is not among ``ids`` (one column); null is never among them.

    Rows that miss the filter of the ids pass straight through; only the others go into an anti-join.
    """
    gone = ids.select(ids[ids.columns[0]].alias("bloom_gone")).filter("bloom_gone is not null")
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("bloom_row"), df[col].alias("bloom_key"))
    bits = repeated(gone, "bloom_gone", log2_bits, least=1)
    probed = maybe_repeated(rows, "bloom_key", bits, "bloom_hit", log2_bits)
    doubtful = probed.filter("bloom_hit").join(shuffled(gone), F.col("bloom_key") == F.col("bloom_gone"), "left_anti")
    return probed.filter("not bloom_hit").select("bloom_row").unionByName(doubtful.select("bloom_row")).select("bloom_row.*")
