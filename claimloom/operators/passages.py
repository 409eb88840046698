"""Chunking, page lookup and line building (survey group P)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import config
from claimloom.functions import text as tx

_SENTENCE_END = re.compile(r"[.!?]\s+(?=[A-Z])")


def chunk_options(length: Column, chunk_size: int | None = None, overlap: int | None = None) -> Column:
    """Chunk size and overlap for a text length; long texts get the dense setting."""
    dense = length >= config.DENSE_THRESHOLD
    size = F.lit(chunk_size) if chunk_size else F.when(dense, config.DENSE_CHUNK_SIZE).otherwise(config.CHUNK_SIZE)
    lap = F.when(dense, config.DENSE_CHUNK_OVERLAP).otherwise(config.CHUNK_OVERLAP)
    if overlap is not None and overlap >= 0:
        lap = F.least(F.lit(overlap), F.greatest(size - 1, F.lit(0)))
    return F.struct(size.cast("int").alias("chunk_size"), lap.cast("int").alias("overlap"))


def _cut_points(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    n = len(text)
    if n == 0:
        return []
    if n <= size:
        return [(0, n)]
    spans: list[tuple[int, int]] = []
    start = 0
    while start < n:
        end = min(start + size, n)
        if end < n:
            lo = max(end - config.SENTENCE_LOOKBACK, start)
            last = None
            for last in _SENTENCE_END.finditer(text[lo:end]):
                pass
            if last is not None and last.start() > (end - lo) * 0.35:
                end = lo + last.start() + 1
        spans.append((start, end))
        start += max(end - start - overlap, 1)
        if n - start < overlap:
            spans[-1] = (spans[-1][0], n)
            break
    return spans


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def _chunk_spans(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series(
        [[{"start": s, "end": e} for s, e in _cut_points(t or "", int(z), int(o))] for t, z, o in zip(text, size, overlap)]
    )


def chunk(documents: DataFrame, id_col: str = "reference_id", text_col: str = "content_text",
          chunk_size: int | None = None, overlap: int | None = None, drop_tail: bool = False) -> DataFrame:
    """Overlapping passages cut at sentence ends: id, passage_index, start_char, end_char, passage_text.

    Each cut depends on the one before, so the cut points of one text come from an Arrow UDF; the texts
    themselves stay in the JVM.  ``drop_tail`` leaves out a last chunk that lies inside the one before.
    """
    options = chunk_options(F.length(text_col), chunk_size, overlap)
    spans = _chunk_spans(F.col(text_col), options["chunk_size"], options["overlap"])
    rows = documents.withColumn("_spans", spans)
    if drop_tail:
        rows = rows.withColumn(
            "_spans",
            F.filter("_spans", lambda s, i: (i == 0) | (F.get("_spans", i - 1)["end"] < s["end"])),
        )
    exploded = rows.select("*", F.posexplode("_spans").alias("passage_index", "_span"))
    return exploded.select(
        *[c for c in documents.columns if c != text_col], "passage_index", F.col("_span.start").alias("start_char"),
        F.col("_span.end").alias("end_char"),
        F.substring(F.col(text_col), F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start")).alias("passage_text"),
    )


def stride_chunks(documents: DataFrame, id_col: str, text_col: str, size: int = config.FACT_CHUNK_SIZE,
                  overlap: int = config.FACT_CHUNK_OVERLAP) -> DataFrame:
    """Fixed-stride chunks; a start within the overlap of the end is not opened."""
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    kept = F.filter(starts, lambda s: (s == 0) | ((n > size) & (s + overlap < n)))
    rows = documents.select(id_col, text_col, F.posexplode(kept).alias("chunk_no", "start_char"))
    return rows.select(
        id_col, "chunk_no", "start_char", F.substring(F.col(text_col), F.col("start_char") + 1, F.lit(size)).alias("chunk_text")
    )


def offset_to_page(offset: Column, boundaries: Column) -> Column:
    """Page of an offset: before the first page the first, in a gap the preceding page, past the end the last."""
    before = F.filter(boundaries, lambda b: b["start_char"] <= offset)
    hit = F.array_max(F.transform(before, lambda b: F.struct(b["start_char"].alias("s"), b["page"].alias("page"))))["page"]
    return F.when(F.size(boundaries) > 0, F.coalesce(hit, F.get(boundaries, F.lit(0))["page"]))


def offset_to_page_incl(offset: Column, boundaries: Column) -> Column:
    """Viewer variant: inclusive ends, 1 without boundaries, past the end the last page."""
    hit = F.get(F.filter(boundaries, lambda b: (b["start_char"] <= offset) & (offset <= b["end_char"])), F.lit(0))
    last = F.get(boundaries, F.size(boundaries) - 1)
    return F.when(offset.isNull() | (F.size(F.coalesce(boundaries, F.array())) == 0), 1).otherwise(
        F.coalesce(hit["page"], last["page"])
    )


def chars_per_page(length: Column, page_count: Column) -> Column:
    return F.when(page_count > 0, F.greatest(F.lit(1), F.floor(length / page_count + 0.5))).otherwise(config.CHARS_PER_PAGE)


def estimate_page(offset: Column, per_page: Column) -> Column:
    return (F.floor(offset / per_page) + 1).cast("int")


def sanitize_page(page: Column, page_count: Column) -> Column:
    """Parsed page, rounded and clamped to the page count where that is known; null stays null."""
    raw = page.cast("string")
    number = F.coalesce(raw.try_cast("double"), F.regexp_extract(raw, r"^\s*([-+]?\d+)", 1).try_cast("double"))
    clamped = F.least(F.greatest(F.floor(number + 0.5), F.lit(1)), page_count).cast("double")
    return F.when(number.isNull(), None).when(page_count > 0, clamped).otherwise(number)


def passage_stats(documents: DataFrame, id_col: str = "reference_id", text_col: str = "content_text") -> DataFrame:
    """Documents, characters, passages and passages per document."""
    docs = documents.agg(F.count("*").alias("documents"), F.sum(F.length(text_col)).alias("chars"))
    chunks = chunk(documents.select(id_col, text_col), id_col, text_col).agg(F.count("*").alias("passages"))
    both = docs.withColumn("k", F.lit(1)).join(chunks.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("avg_passages", F.when(F.col("documents") > 0, F.round(F.col("passages") / F.col("documents"), 6)))


def embedding_status(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages and embedded passages per live document."""
    counts = passages.groupBy("reference_id").agg(
        F.count("*").alias("passage_count"), F.count("embedding").alias("embedded_count")
    )
    return (
        documents.filter(F.col("deleted_at").isNull())
        .select("reference_id", "brand", "upload_date")
        .join(counts, "reference_id", "left")
        .na.fill({"passage_count": 0, "embedded_count": 0})
    )


def embedding_status_by_brand(status: DataFrame) -> DataFrame:
    return status.groupBy("brand").agg(
        F.count("*").alias("total_references"),
        F.sum(F.when(F.col("embedded_count") > 0, 1).otherwise(0)).alias("embedded_references"),
        F.sum("passage_count").alias("total_passages"),
    )


def lines_from_items(items: DataFrame, keys: list[str], y_tolerance: float = 4.0) -> DataFrame:
    """Lines from positioned words: rows by y, split at wide x gaps.

    items: keys, item_no, str, x, y, width, height.  A row takes every item within the tolerance of its first y.
    A y gap above the tolerance cuts a page into bands that cannot share a row, so the row starts of
    one band come from a fold over that band's few distinct y values.
    """
    page = Window.partitionBy(*keys).orderBy("y")
    ys = items.select(*keys, "y").distinct()
    new_band = (F.col("y") - F.lag("y").over(page) > y_tolerance).cast("int")
    bands = ys.withColumn("band", F.sum(F.coalesce(new_band, F.lit(0))).over(page))
    starts = bands.groupBy(*keys, "band").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    fold = F.aggregate(
        "ys", F.array().cast("array<double>"),
        lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) > y_tolerance), F.array_append(acc, y)).otherwise(acc),
    )
    row_of = (
        starts.select(*keys, F.explode("ys").alias("y"), fold.alias("starts"))
        .withColumn("row_y", F.array_max(F.filter("starts", lambda s: s <= F.col("y"))))
        .drop("starts")
    )
    rows = items.join(row_of, [*keys, "y"])
    across = Window.partitionBy(*keys, "row_y").orderBy("x", "item_no")
    height = F.greatest(F.lag("height").over(across), F.col("height"))
    limit = F.greatest(F.lit(14.0), F.least(F.lit(40.0), height * 1.6))
    gap = F.col("x") - (F.lag("x").over(across) + F.lag("width").over(across))
    split = rows.withColumn("new", F.coalesce((gap > limit).cast("int"), F.lit(0))).withColumn(
        "cluster", F.sum("new").over(across.rowsBetween(Window.unboundedPreceding, 0))
    )
    # one group is one printed line
    lines = split.groupBy(*keys, "row_y", "cluster").agg(
        F.array_sort(F.collect_list(F.struct("x", "item_no", "str"))).alias("parts"),
        F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"), F.min("y").alias("y"),
        F.max("height").alias("height"),
    )
    return lines.select(
        *keys, tx.norm_inline(F.array_join(F.transform("parts", lambda p: p["str"]), " ")).alias("text"), "x", "y",
        (F.col("right") - F.col("x")).alias("width"), "height", F.size("parts").alias("n_items"),
    )


def group_lines(spans: DataFrame, keys: list[str], tolerance: float = 0.8) -> DataFrame:
    """Lines of spans that follow each other within a y tolerance; parts joined in x order."""
    order = Window.partitionBy(*keys).orderBy("span_no")
    jump = F.coalesce((F.abs(F.col("y") - F.lag("y").over(order)) > tolerance).cast("int"), F.lit(0))
    numbered = spans.withColumn("jump", jump).withColumn("line_no", F.sum("jump").over(order))
    lines = numbered.groupBy(*keys, "line_no").agg(
        F.array_sort(F.collect_list(F.struct("x", "span_no", "text"))).alias("parts"), F.min("y").alias("y"),
        F.min("x").alias("x"),
    )
    return lines.select(
        *keys, "line_no", "y", "x", tx.norm_inline(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("text")
    )


def notes_boundary(spans: DataFrame, keys: list[str]) -> DataFrame:
    """y of the first 'Speaker notes' label of a page, else half the page."""
    label = F.col("text").rlike(r"(?i)^\s*speaker\s+notes?\s*$")
    found = spans.groupBy(*keys).agg(F.min_by("y", F.when(label, F.col("span_no"))).alias("y"))
    return found.withColumn("boundary", F.coalesce("y", F.lit(50.0))).drop("y")
