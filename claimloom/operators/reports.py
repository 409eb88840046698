"""Scorecards, benchmark summaries and listings (survey group G).

Every report takes the columns that name a run (brand, document, ...) as ``keys`` and works on all runs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as tx

# Claim types, and prices in dollars per million tokens with the default row.
CLAIM_TYPES = ("efficacy", "safety", "regulatory", "comparative", "dosage", "ingredient", "testimonial", "pricing")
PRICES = (
    ("gemini-3.1-flash-lite-preview", 0.075, 0.30), ("gemini-3-pro-preview", 1.25, 5.00), ("gemini-2.5-pro", 1.25, 5.00),
    ("gemini-2.5-flash", 0.075, 0.30), ("gemini-2.0-flash", 0.075, 0.30), ("gemini-1.5-flash", 0.075, 0.30),
    ("gemini-1.5-pro", 1.25, 5.00), ("default", 1.25, 5.00),
)
# end of fixed values


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale, null where the denominator is 0."""
    return F.when(den > 0, num / den * scale)


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order or partitions of rows: added up as decimals.

    Keys with a value or sum beyond 18 digits before, or a value beyond 20 after the point, are added up as doubles.
    """
    d = value.try_cast("decimal(38,20)")
    same = F.count(value) == F.count(F.when(d.cast("double") == value, 1))
    return F.coalesce(F.when(same, F.try_sum(d).cast("double")), F.sum(value))


def matching_stats(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per run; the average confidence divides by all matched claims."""
    g = matches.groupBy(*keys).agg(
        F.count("*").alias("total"), count_if(F.col("matched")).alias("matched"),
        exact_sum(F.when(F.col("matched"), F.col("match_confidence"))).alias("conf"),
    )
    return g.select(
        *keys, "total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"),
        F.round(F.coalesce(ratio(F.col("matched"), F.col("total"), 100.0), F.lit(0.0)), 1).alias("match_rate"),
        F.round(F.coalesce(ratio(F.coalesce("conf", F.lit(0.0)), F.col("matched"), 100.0), F.lit(0.0)), 1).alias("avg_confidence"),
    )


def tier_counts(matches: DataFrame, keys: list[str]) -> DataFrame:
    return matches.filter(F.col("matched") & F.col("match_tier").isNotNull()).groupBy(*keys, "match_tier").agg(
        F.count("*").alias("n")
    )


def pipeline_outcome() -> Column:
    """Exclusive outcome of one claim from its tier and diagnostics."""
    tier, sem, ext = F.col("match_tier"), F.col("semantic_result"), F.col("extraction_results")
    return (
        F.when(~F.col("has_diagnostics"), "errors")
        .when(tier == "citation-scoped", "citation_scoped_matched")
        .when(tier == "fact-anchored", "fact_anchored_matched")
        .when(tier.isin("verified-extraction", "partial-extraction"), "extraction_matched")
        .when(tier == "semantic-direct-fallback", "semantic_direct_fallback_matched")
        .when(tier == "keyword-fallback", "keyword_fallback_matched")
        .when(F.col("matched"), None)
        .when(sem == "no-passages", "semantic_no_passages")
        .when(sem == "error", "errors")
        .when(F.array_contains(ext, "unverified"), "extraction_unverified")
        .when(F.array_contains(ext, "not-supported"), "extraction_not_supported")
        .otherwise("no_match")
    )


def pipeline_summary(matches: DataFrame, keys: list[str]) -> DataFrame:
    out = matches.withColumn("outcome", pipeline_outcome()).filter(F.col("outcome").isNotNull())
    return out.groupBy(*keys, "outcome").agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], bins: int = 64) -> DataFrame:
    """Exact nearest-rank percentiles by order statistics.

    Approximate quantiles cut the values of each key into bins of about equal weight; the exact weights of the bins tell which one holds a
    rank, and only the values of that bin are put in order.
    """
    known = df.filter(F.col(value).isNotNull())
    cuts = known.groupBy(*keys).agg(F.percentile_approx(value, [i / bins for i in range(1, bins)], 10_000).alias("cuts"), F.count("*").alias("total"))
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("n"))
    binned = counts.join(cuts.drop("total"), keys).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    # at most ``bins`` entries per key
    weights = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("weights"))

    def place(rank: Column) -> Column:
        """Bin of a rank and the weight of the bins before it."""
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("upto"), F.lit(-1).alias("bin"))
        return F.aggregate("weights", start, lambda at, w: F.when(at["upto"] >= rank, at).otherwise(
            F.struct(at["upto"].alias("before"), (at["upto"] + w["n"]).alias("upto"), w["bin"].alias("bin"))))

    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("total") * p - 1e-9)).cast("long").alias("rank")) for name, p in probabilities.items()])
    asked = weights.join(cuts.select(*keys, "total"), keys).select(*keys, F.explode(F.transform(ranks, lambda r: F.struct(r["name"].alias("name"), r["rank"].alias("rank"), place(r["rank"]).alias("at")))).alias("r"))
    asked = asked.select(*keys, "r.name", "r.rank", "r.at.bin", "r.at.before")
    inside = Window.partitionBy(*keys, "bin", "name").orderBy(value)
    running = binned.join(asked, [*keys, "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    picks = [F.min(F.when((F.col("name") == name) & (F.col("upto") >= F.col("rank")), F.col(value))).alias(name) for name in probabilities]
    return running.groupBy(*keys).agg(*picks)


def duration_summary(durations: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    basic = durations.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), (exact_sum(F.col(value)) / F.count(value)).alias("avg"), F.max(value).alias("max")
    )
    tail = nearest_rank(durations, keys, value, {"p95": 0.95})
    return basic.join(tail, keys).select(
        *keys, "count", *[F.floor(F.col(c) + 0.5).cast("long").alias(c) for c in ("min", "avg", "p95", "max")]
    )


def benchmark_summary(responses: DataFrame, results: DataFrame, keys: list[str], top_k: int = 20) -> DataFrame:
    """Recall at 1, 5 and 20, latency percentiles and result counts per run.

    responses: keys, request_id, ok, duration_ms, expected_reference_id, expected_alias; results: request_id, rank,
    reference_id, display_alias.
    """
    ok = responses.filter("ok")
    hit = F.when(
        F.col("expected_reference_id").isNotNull(), F.col("reference_id") == F.col("expected_reference_id")
    ).otherwise(tx.norm_alias(F.col("display_alias")) == tx.norm_alias(F.col("expected_alias")))
    per_request = (
        ok.join(results, "request_id", "left")
        .groupBy(*keys, "request_id", "expected_reference_id", "expected_alias", "duration_ms")
        .agg(F.count("rank").alias("n_results"), F.min(F.when(hit, F.col("rank"))).alias("first_hit"))
    )
    expected = F.col("expected_reference_id").isNotNull() | F.col("expected_alias").isNotNull()
    recalls = []
    for k in (1, 5, 20):
        hits = count_if(expected & (F.col("first_hit") <= min(k, top_k)))
        recalls.append(F.round(ratio(hits, count_if(expected)), 6).alias(f"recall_at_{k}"))
    summary = per_request.groupBy(*keys).agg(
        F.count("*").alias("successful"), count_if(expected).alias("expected"), *recalls,
        F.min("n_results").alias("results_min"), F.max("n_results").alias("results_max"),
        F.round(F.avg("n_results"), 6).alias("results_avg"), F.max("duration_ms").alias("latency_max"),
        F.round(F.avg("duration_ms"), 6).alias("latency_avg"),
    )
    ranks = nearest_rank(
        ok, keys, "duration_ms",
        {"latency_min": 0.01, "latency_p50": 0.5, "latency_p90": 0.9, "latency_p95": 0.95, "latency_p99": 0.99},
    )
    totals = responses.groupBy(*keys).agg(F.count("*").alias("requests"), count_if(~F.col("ok")).alias("failed"))
    return totals.join(summary, keys, "left").join(ranks, keys, "left")


def scorecard(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and mapping accuracy from review states (status missed = a claim the run did not find)."""
    rejected = F.col("status") == "rejected"
    fp = rejected & (F.coalesce("rejection_type", F.lit("")) == "false_positive")
    corrected = rejected & F.col("rejection_type").isNotNull() & (F.col("rejection_type") != "false_positive")
    g = claims.groupBy(*keys).agg(
        count_if(F.col("status").isin("approved", "rejected")).alias("reviewed"),
        count_if(F.col("status") != "missed").alias("total"), count_if(F.col("status") == "approved").alias("approved"),
        count_if(fp).alias("false_positives"), count_if(corrected).alias("corrected"),
        count_if(F.col("status") == "missed").alias("missed"),
    )
    a, c = F.col("approved"), F.col("corrected")
    return g.select(
        "*", F.round(ratio(a, a + F.col("false_positives"), 100.0), 6).alias("precision"),
        F.round(ratio(a + c, a + c + F.col("missed"), 100.0), 6).alias("recall"),
        F.round(ratio(a, a + c, 100.0), 6).alias("mapping_accuracy"),
    )


def annotation_summary(claims: DataFrame, keys: list[str], on_page: tuple[str, ...] = ("on-page", "layout")) -> DataFrame:
    """Counts by source and state; ``on_page`` names the sources that read the page itself."""
    referenced = F.coalesce("matched", F.lit(False)) & (F.size(F.coalesce("references", F.array().cast("array<string>"))) > 0)
    return claims.groupBy(*keys).agg(
        F.count("*").alias("total"), count_if(F.col("source").isin(*on_page)).alias("on_page"),
        count_if(F.col("source") == "ai-find").alias("ai_finds"),
        count_if(F.coalesce("global_spot", F.lit(False))).alias("global_annotations"),
        count_if(~referenced).alias("unreferenced"),
    )


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def status_bands(claims: DataFrame) -> DataFrame:
    """Counts by review state and confidence band, with all subtotals."""
    rows = claims.withColumn("band", band(F.col("confidence")))
    cube = rows.cube("status", "band").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
    return cube.na.fill("all", ["status", "band"])


def type_counts(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of every claim type, zeros included (the type list is eight rows)."""
    types = F.explode(F.array(*[F.lit(t) for t in CLAIM_TYPES])).alias("type")
    grid = claims.select(*keys).distinct().select(*keys, types)
    counts = claims.groupBy(*keys, "type").agg(F.count("*").alias("n"))
    return grid.join(counts, [*keys, "type"], "left").na.fill(0, ["n"])


def browse_claims(claims: DataFrame, status: str = "all", types: tuple[str, ...] = (), source: str = "all", search: str = "",
                  unmatched_only: bool = False, order: str = "page") -> DataFrame:
    """Filtered and sorted claim list."""
    rows = claims
    if status != "all":
        rows = rows.filter(F.col("status") == status)
    if types:
        rows = rows.filter(F.col("type").isin(*types))
    if source != "all":
        rows = rows.filter(F.col("source") == source)
    if search:
        rows = rows.filter(F.contains(F.lower("text"), F.lit(search.lower())))
    if unmatched_only:
        rows = rows.filter(~F.coalesce("matched", F.lit(False)))
    orders = {
        "page": ["page", "global_index"], "annotation": ["global_index"],
        "confidence-desc": [F.desc("confidence"), "global_index"], "confidence-asc": ["confidence", "global_index"],
    }
    return rows.orderBy(*orders[order])


def claims_by_page(claims: DataFrame, doc: str) -> DataFrame:
    """Claims with their place on the page and the page's size (a row form of the page list)."""
    page = F.greatest(F.lit(1), F.coalesce("page", F.lit(1)))
    rows = claims.withColumn("page", page)
    w = Window.partitionBy(doc, "page")
    return rows.withColumn("page_pos", F.row_number().over(w.orderBy("ord"))).withColumn("page_claims", F.count("*").over(w))


def usage_cost(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Cost of token counts by model; unknown models take the default price."""
    spark = usage.sparkSession
    prices = prices or spark.createDataFrame(list(PRICES), "model string, input_price double, output_price double")
    named = prices.filter(F.col("model") != "default")
    base = prices.filter(F.col("model") == "default").select("input_price", "output_price")
    rows = usage.join(named, "model", "left")
    price_in = F.coalesce("input_price", base.select("input_price").scalar())
    price_out = F.coalesce("output_price", base.select("output_price").scalar())
    return rows.withColumn(
        "cost", F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out
    ).drop("input_price", "output_price")


def run_usage(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost"), 8).alias("cost"),
    )


def run_delta(runs: DataFrame, doc: str) -> DataFrame:
    """Trained run against the baseline run of the same document."""
    base = runs.filter(F.col("variant") == "baseline").select(doc, F.col("claim_count").alias("baseline"))
    trained = runs.filter(F.col("variant") == "trained").select(doc, F.col("claim_count").alias("trained"))
    delta = F.col("trained") - F.col("baseline")
    percent = F.floor(delta / F.greatest(F.col("baseline"), F.lit(1)) * 100 + 0.5).cast("long")
    return base.join(trained, doc).withColumn("delta", delta).withColumn("percent_change", percent)


def run_log(claims: DataFrame, keys: list[str]) -> DataFrame:
    """One log row per run: claim and match counts, average confidence."""
    return claims.groupBy(*keys).agg(
        F.count("*").alias("claim_count"), count_if(F.col("matched")).alias("matched_count"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("avg_confidence"),
    )


def runs_for(runs: DataFrame, document: str, brand=None) -> DataFrame:
    rows = runs.filter(F.col("document_name") == document)
    if brand is not None:
        rows = rows.filter(F.col("brand_id") == brand)
    return rows.orderBy(F.desc("created_at"), F.desc("run_id"))


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def parent_counts(parents: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Documents per brand or folder, soft-deleted ones included."""
    n = docs.groupBy(key).agg(F.count("*").alias("reference_count"))
    return parents.join(n, key, "left").na.fill(0, ["reference_count"])


def compare_runs(found: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """Run output against human marks by dedup text: found, missed, extra."""
    f = found.select(*keys, "dedup_text").distinct().withColumn("in_run", F.lit(True))
    m = marked.select(*keys, "dedup_text").distinct().withColumn("in_marks", F.lit(True))
    both = f.join(m, [*keys, "dedup_text"], "full_outer")
    outcome = (
        F.when(F.col("in_run") & F.col("in_marks"), "found").when(F.col("in_marks"), "missed").otherwise("extra")
    )
    return both.select(*keys, "dedup_text", outcome.alias("outcome"))


def feedback_for(feedback: DataFrame, key: str) -> DataFrame:
    """Feedback of a claim or document, newest first, with the latest decision marked."""
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("feedback_id"))
    return feedback.withColumn("recency", F.row_number().over(w)).withColumn("is_latest", F.col("recency") == 1)


def training_totals(sessions: DataFrame) -> DataFrame:
    """Approved, rejected and missed examples per session, with the overall row (session_id null)."""
    rows = sessions.select("session_id", F.explode("approved_claims").alias("c"))
    kind = F.coalesce(F.col("c.type"), F.lit("Claim"))
    return rows.withColumn("kind", kind).rollup("session_id").agg(
        count_if(~F.col("kind").isin("FalsePositive", "MissedClaim")).alias("approved"),
        count_if(F.col("kind") == "FalsePositive").alias("rejected"), count_if(F.col("kind") == "MissedClaim").alias("missed"),
    )


# ---- reading order of markers ----


def split_markers(markers: DataFrame, min_gap: float = 10.0, touch: float = 5.0) -> DataFrame:
    """Markers over two columns become a left and a right marker.  Input: doc, marker_id, page, rects, text, ord."""
    starts = F.array_sort(F.transform("rects", lambda r: F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"))))
    spans = F.aggregate(
        starts, F.array().cast("array<struct<x0:double,x1:double>>"),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (r["x0"] <= F.element_at(acc, -1)["x1"] + touch),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["x0"].alias("x0"), F.greatest(F.element_at(acc, -1)["x1"], r["x1"]).alias("x1"))),
            ),
        ).otherwise(F.array_append(acc, r)),
    )
    rows = markers.withColumn("_s", spans)
    left, right = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    two = (F.size("_s") == 2) & (right["x0"] - left["x1"] >= min_gap)
    mid = (left["x1"] + right["x0"]) / 2
    rows = rows.withColumn("_m", F.when(two, mid))
    lrects = F.filter("rects", lambda r: r["x1"] <= F.col("_m"))
    rrects = F.filter("rects", lambda r: r["x0"] >= F.col("_m"))

    def part(suffix: str, rects: Column, n: int) -> Column:
        return F.struct(F.concat("marker_id", F.lit(suffix)).alias("marker_id"), rects.alias("rects"), F.lit(n).alias("part"))

    parts = F.when(
        F.col("_m").isNotNull() & (F.size(lrects) > 0) & (F.size(rrects) > 0), F.array(part("-L", lrects, 0), part("-R", rrects, 1))
    ).otherwise(F.array(part("", F.col("rects"), 0)))
    keep = [c for c in markers.columns if c not in ("marker_id", "rects")]
    return rows.select(*keep, F.explode(parts).alias("_p")).select(*keep, "_p.marker_id", "_p.rects", "_p.part")


def marker_order(markers: DataFrame, max_gap: float = 8.0, min_overlap: float = 0.3) -> DataFrame:
    """Markers in reading order, merged where one continues the one above: doc, page, index, marker_id, n_merged."""

    def edge(fn, name: str) -> Column:
        return fn(F.transform("rects", lambda r: r[name]))

    m = split_markers(markers)
    m = m.select(
        "doc", "page", "marker_id", "ord", "part", edge(F.array_min, "y0").alias("top"), edge(F.array_max, "y1").alias("bottom"),
        edge(F.array_min, "x0").alias("x0"), edge(F.array_max, "x1").alias("x1"),
    )
    w = Window.partitionBy("doc", "page").orderBy("top", "ord", "part")
    prev = {c: F.lag(c).over(w) for c in ("bottom", "x0", "x1")}
    width = F.least(prev["x1"] - prev["x0"], F.col("x1") - F.col("x0"))
    shared = F.greatest(F.lit(0.0), F.least(prev["x1"], F.col("x1")) - F.greatest(prev["x0"], F.col("x0")))
    joins = (width > 0) & (shared / width > min_overlap) & (F.col("top") - prev["bottom"] <= max_gap)
    numbered = m.withColumn("opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn(
        "index", F.sum("opens").over(w)
    )
    return numbered.groupBy("doc", "page", "index").agg(
        F.min_by("marker_id", F.struct("top", "ord", "part")).alias("marker_id"), F.count("*").alias("n_merged"),
        F.min("top").alias("top"), F.max("bottom").alias("bottom"),
    )
