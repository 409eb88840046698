"""Reports over the given tables (survey group G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import unicode as un
from claimloom.operators import reports as rp
from claimloom.plans import bindings as b
from claimloom.plans import ingest_queries as iq
from claimloom.plans import retrieval_queries as rq
from claimloom.plans.registry import fragment, query


def s(c):
    return c.cast("string")


def reviewed(spark, d):
    """Events as reviewed claims of a run: the user is the run, the event type the review state."""
    t = b.table(spark, d, "events")
    e, v = F.col("event_type"), F.col("value")
    return t.select(
        F.col("event_id").alias("claim_id"), F.col("user_id").alias("run"),
        F.when(e == "purchase", "approved").when(e == "error", "rejected").when(e == "signup", "missed").otherwise("pending").alias("status"),
        F.when((e == "error") & (v > 15), "false_positive").when((e == "error") & (v > 5), "wrong_reference").alias("rejection_type"),
        F.least(F.lit(1.0), v / 20).alias("confidence"), (e != "error").alias("matched"),
        F.when(F.col("event_id") % 6 == 0, F.lit(None)).otherwise(v / 100).alias("match_confidence"),
        F.when(e == "click", "citation-scoped").when(e == "view", "fact-anchored").when(e == "purchase", "verified-extraction")
        .when((e == "signup") & (v > 5), "semantic-direct-fallback").alias("match_tier"),
        F.get(F.array(*[F.lit(x) for x in ("efficacy", "safety", "regulatory", "comparative", "dosage", "other")]),
              (F.col("event_id") % 6).cast("int")).alias("type"),
        F.when(F.col("event_id") % 4 == 0, "on-page").when(F.col("event_id") % 4 == 1, "layout").when(F.col("event_id") % 4 == 2, "ai-find")
        .otherwise("core").alias("source"),
        (F.col("event_id") % 12 - 1).cast("int").alias("page"), (F.col("event_id") % 9 == 0).alias("global_spot"),
        F.when(F.col("event_id") % 5 > 1, F.array(F.lit("r"))).when(F.col("event_id") % 5 == 1, F.array().cast("array<string>")).alias("references"),
        F.col("event_id").alias("ord"), F.col("event_id").alias("global_index"), F.concat(e, F.lit(" Claim "), s(F.col("user_id"))).alias("text"),
        "ts",
    )


fragment(
    "reviewed",
    """SELECT event_id AS claim_id, user_id AS run, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'missed' ELSE 'pending' END AS status,
    CASE WHEN event_type = 'error' AND value > 15 THEN 'false_positive' WHEN event_type = 'error' AND value > 5 THEN 'wrong_reference' END AS rejection_type,
    least(1.0::DOUBLE, value / 20) AS confidence, event_type <> 'error' AS matched, CASE WHEN event_id % 6 <> 0 THEN value / 100 END AS match_confidence,
    CASE WHEN event_type = 'click' THEN 'citation-scoped' WHEN event_type = 'view' THEN 'fact-anchored' WHEN event_type = 'purchase' THEN 'verified-extraction'
      WHEN event_type = 'signup' AND value > 5 THEN 'semantic-direct-fallback' END AS match_tier,
    ['efficacy', 'safety', 'regulatory', 'comparative', 'dosage', 'other'][event_id % 6 + 1] AS type,
    ['on-page', 'layout', 'ai-find', 'core'][event_id % 4 + 1] AS source, (event_id % 12 - 1)::INT AS page, event_id % 9 = 0 AS global_spot,
    CASE WHEN event_id % 5 > 1 THEN 1 WHEN event_id % 5 = 1 THEN 0 END AS n_refs, event_id AS ord, event_id AS global_index,
    event_type || ' Claim ' || user_id AS text, ts FROM events""",
)


@query(
    "g01_matching_stats",
    """SELECT run, count(*) AS total, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE NOT matched) AS unmatched,
      round(count(*) FILTER (WHERE matched) / count(*) * 100, 1) AS match_rate,
      coalesce(round(coalesce(sum(match_confidence) FILTER (WHERE matched), 0) / nullif(count(*) FILTER (WHERE matched), 0) * 100, 1), 0) AS avg_confidence
    FROM reviewed GROUP BY run""",
    ("reviewed",),
)
def matching_stats(spark, d):
    return rp.matching_stats(reviewed(spark, d), ["run"])


@query(
    "g01_tier_counts",
    "SELECT run, match_tier, count(*) AS n FROM reviewed WHERE matched AND match_tier IS NOT NULL GROUP BY ALL", ("reviewed",),
)
def tier_counts(spark, d):
    return rp.tier_counts(reviewed(spark, d), ["run"])


@query(
    "g02_pipeline_summary",
    """SELECT run, outcome, count(*) AS n FROM (SELECT run, CASE WHEN claim_id % 31 = 0 THEN 'errors' WHEN match_tier = 'citation-scoped' THEN 'citation_scoped_matched'
      WHEN match_tier = 'fact-anchored' THEN 'fact_anchored_matched' WHEN match_tier = 'verified-extraction' THEN 'extraction_matched'
      WHEN match_tier = 'semantic-direct-fallback' THEN 'semantic_direct_fallback_matched' WHEN matched THEN NULL WHEN claim_id % 7 = 0 THEN 'semantic_no_passages'
      WHEN claim_id % 7 = 1 THEN 'errors' WHEN claim_id % 3 = 0 THEN 'extraction_unverified' WHEN claim_id % 3 = 1 THEN 'extraction_not_supported' ELSE 'no_match' END AS outcome
      FROM reviewed) WHERE outcome IS NOT NULL GROUP BY ALL""",
    ("reviewed",),
)
def pipeline_summary(spark, d):
    k = F.col("claim_id")
    rows = reviewed(spark, d).withColumn("has_diagnostics", k % 31 != 0).withColumn(
        "semantic_result", F.when(k % 7 == 0, "no-passages").when(k % 7 == 1, "error").otherwise("narrowed")
    ).withColumn(
        "extraction_results",
        F.when(k % 3 == 0, F.array(F.lit("not-supported"), F.lit("unverified"))).when(k % 3 == 1, F.array(F.lit("not-supported")))
        .otherwise(F.array().cast("array<string>")),
    )
    return rp.pipeline_summary(rows, ["run"])


@query(
    "g03_duration_summary",
    """SELECT user_id AS run, count(*) AS count, floor(min(value) + 0.5)::BIGINT AS min, floor(avg(value) + 0.5)::BIGINT AS avg,
      floor(quantile_disc(value, 0.95) + 0.5)::BIGINT AS p95, floor(max(value) + 0.5)::BIGINT AS max FROM events GROUP BY user_id""",
)
def duration_summary(spark, d):
    t = b.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("value").alias("ms"))
    return rp.duration_summary(t, ["run"])


fragment(
    "bench_rows",
    """SELECT brand, claim_id, claim_id % 11 <> 0 AS ok, (claim_id * 37 % 1000 / 10.0)::DOUBLE AS ms, claim_id // 1000 AS want, claim_id % 3 AS kind FROM claims""",
    "claims",
)


@query(
    "g04_benchmark_summary",
    """SELECT brand, count(*) AS requests, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok) AS successful,
      count(*) FILTER (WHERE ok AND kind < 2) AS expected,
      round(count(*) FILTER (WHERE ok AND kind < 2 AND hit <= 1) / nullif(count(*) FILTER (WHERE ok AND kind < 2), 0), 6) AS recall_at_1,
      round(count(*) FILTER (WHERE ok AND kind < 2 AND hit <= 5) / nullif(count(*) FILTER (WHERE ok AND kind < 2), 0), 6) AS recall_at_5,
      round(count(*) FILTER (WHERE ok AND kind < 2 AND hit <= 20) / nullif(count(*) FILTER (WHERE ok AND kind < 2), 0), 6) AS recall_at_20,
      min(n) FILTER (WHERE ok) AS results_min, max(n) FILTER (WHERE ok) AS results_max, round(avg(n) FILTER (WHERE ok), 6) AS results_avg,
      max(ms) FILTER (WHERE ok) AS latency_max, round(avg(ms) FILTER (WHERE ok), 6) AS latency_avg,
      quantile_disc(ms, 0.01) FILTER (WHERE ok) AS latency_min, quantile_disc(ms, 0.5) FILTER (WHERE ok) AS latency_p50,
      quantile_disc(ms, 0.9) FILTER (WHERE ok) AS latency_p90, quantile_disc(ms, 0.95) FILTER (WHERE ok) AS latency_p95,
      quantile_disc(ms, 0.99) FILTER (WHERE ok) AS latency_p99
    FROM (SELECT b.brand, b.claim_id, ok, ms, kind, count(r.hybrid_rank) AS n, min(hybrid_rank) FILTER (WHERE reference_id = want) AS hit
      FROM bench_rows b LEFT JOIN (SELECT * FROM reranked WHERE hybrid_rank <= 20) r USING (claim_id) GROUP BY ALL) GROUP BY brand""",
    ("bench_rows", "reranked"),
)
def benchmark_summary(spark, d):
    k = F.col("claim_id")
    want = F.floor(k / 1000)
    responses = b.claims(spark, d).select(
        "brand", k.alias("request_id"), (k % 11 != 0).alias("ok"), (k * 37 % 1000 / 10.0).alias("duration_ms"),
        F.when(k % 3 == 0, want).alias("expected_reference_id"),
        F.when(k % 3 == 1, F.concat(F.lit("ref-"), s(want))).alias("expected_alias"),
    )
    results = rq.reranked_rows(spark, d).filter("hybrid_rank <= 20").select(
        F.col("claim_id").alias("request_id"), F.col("hybrid_rank").alias("rank"), "reference_id",
        F.concat(F.lit("Ref "), s(F.col("reference_id"))).alias("display_alias"),
    )
    out = rp.benchmark_summary(responses, results, ["brand"])
    return out


@query(
    "g05_scorecard",
    """SELECT *, round(approved / nullif(approved + false_positives, 0) * 100, 6) AS precision,
      round((approved + corrected) / nullif(approved + corrected + missed, 0) * 100, 6) AS recall,
      round(approved / nullif(approved + corrected, 0) * 100, 6) AS mapping_accuracy FROM (
      SELECT run, count(*) FILTER (WHERE status IN ('approved', 'rejected')) AS reviewed, count(*) FILTER (WHERE status <> 'missed') AS total,
        count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE rejection_type = 'false_positive') AS false_positives,
        count(*) FILTER (WHERE rejection_type = 'wrong_reference') AS corrected, count(*) FILTER (WHERE status = 'missed') AS missed
      FROM reviewed GROUP BY run)""",
    ("reviewed",),
)
def scorecard(spark, d):
    return rp.scorecard(reviewed(spark, d), ["run"])


@query(
    "g06_annotation_summary",
    """SELECT run, count(*) AS total, count(*) FILTER (WHERE source IN ('on-page', 'layout')) AS on_page, count(*) FILTER (WHERE source = 'ai-find') AS ai_finds,
      count(*) FILTER (WHERE global_spot) AS global_annotations, count(*) FILTER (WHERE NOT matched OR coalesce(n_refs, 0) = 0) AS unreferenced
    FROM reviewed GROUP BY run""",
    ("reviewed",),
)
def annotation_summary(spark, d):
    return rp.annotation_summary(reviewed(spark, d), ["run"])


@query(
    "g07_status_bands",
    """SELECT coalesce(status, 'all') AS status, coalesce(band, 'all') AS band, count(*) AS n, grouping_id(status, band) AS level FROM (
      SELECT status, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM reviewed)
    GROUP BY CUBE (status, band)""",
    ("reviewed",),
)
def status_bands(spark, d):
    return rp.status_bands(reviewed(spark, d))


@query(
    "g08_type_counts",
    """SELECT g.run, g.type, count(r.claim_id) AS n FROM (SELECT run, unnest(['efficacy', 'safety', 'regulatory', 'comparative', 'dosage', 'ingredient', 'testimonial', 'pricing']) AS type
      FROM (SELECT DISTINCT run FROM reviewed)) g LEFT JOIN reviewed r ON r.run = g.run AND r.type = g.type GROUP BY ALL""",
    ("reviewed",),
)
def type_counts(spark, d):
    return rp.type_counts(reviewed(spark, d), ["run"])


@query(
    "g09_browse_claims",
    """SELECT claim_id, page, status, round(confidence, 6) AS confidence FROM reviewed WHERE status = 'pending' AND type IN ('safety', 'dosage')
      AND source = 'layout' AND contains(lower(text), 'claim 1')""",
    ("reviewed",),
)
def browse_claims(spark, d):
    out = rp.browse_claims(reviewed(spark, d), "pending", ("safety", "dosage"), "layout", "CLAIM 1", order="confidence-desc")
    return out.select("claim_id", "page", "status", F.round("confidence", 6).alias("confidence"))


@query(
    "g10_claims_by_page",
    """SELECT run, greatest(1, page) AS page, claim_id, row_number() OVER (PARTITION BY run, greatest(1, page) ORDER BY ord) AS page_pos,
      count(*) OVER (PARTITION BY run, greatest(1, page)) AS page_claims FROM reviewed""",
    ("reviewed",),
)
def claims_by_page(spark, d):
    out = rp.claims_by_page(reviewed(spark, d), "run")
    return out.select("run", "page", "claim_id", F.col("page_pos").cast("long").alias("page_pos"), "page_claims")


def usage(spark, d):
    """Order lines as model calls."""
    t = b.table(spark, d, "lineitem")
    f = F.col("l_returnflag")
    model = F.when(f == "A", "gemini-2.5-flash").when(f == "N", "gemini-3-pro-preview").otherwise("someone-elses-model")
    return t.select(
        "l_orderkey", "l_linenumber", model.alias("model"), (F.col("l_quantity") * 1000).cast("long").alias("input_tokens"),
        F.col("l_extendedprice").cast("long").alias("output_tokens"),
    )


fragment(
    "usage",
    """SELECT l_orderkey, l_linenumber, i, o, i / 1000000 * CASE WHEN l_returnflag = 'A' THEN 0.075::DOUBLE ELSE 1.25::DOUBLE END
      + o / 1000000 * CASE WHEN l_returnflag = 'A' THEN 0.30::DOUBLE ELSE 5.0::DOUBLE END AS cost
    FROM (SELECT l_orderkey, l_linenumber, l_returnflag, trunc(l_quantity * 1000)::BIGINT AS i, trunc(l_extendedprice)::BIGINT AS o FROM lineitem)""",
)


@query("g11_usage_cost", "SELECT l_orderkey, l_linenumber, round(cost, 9) AS cost FROM usage", ("usage",))
def usage_cost(spark, d):
    return rp.usage_cost(usage(spark, d)).select("l_orderkey", "l_linenumber", F.round("cost", 9).alias("cost"))


@query(
    "g12_run_usage",
    "SELECT l_orderkey, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(cost), 8) AS cost FROM usage GROUP BY l_orderkey",
    ("usage",),
)
def run_usage(spark, d):
    return rp.run_usage(rp.usage_cost(usage(spark, d)), ["l_orderkey"])


@query(
    "g13_run_delta",
    """SELECT l_suppkey, baseline, trained, trained - baseline AS delta, floor((trained - baseline) / greatest(baseline, 1) * 100 + 0.5)::BIGINT AS percent_change FROM (
      SELECT l_suppkey, count(*) FILTER (WHERE l_linestatus = 'F') AS baseline, count(*) FILTER (WHERE l_linestatus = 'O') AS trained FROM lineitem GROUP BY l_suppkey)
    WHERE baseline > 0 AND trained > 0""",
)
def run_delta(spark, d):
    t = b.table(spark, d, "lineitem")
    variant = F.when(F.col("l_linestatus") == "F", "baseline").otherwise("trained").alias("variant")
    return rp.run_delta(t.groupBy("l_suppkey", variant).agg(F.count("*").alias("claim_count")), "l_suppkey")


@query(
    "g14_run_log",
    """SELECT run, count(*) AS claim_count, count(*) FILTER (WHERE matched) AS matched_count, round(avg(confidence), 6) AS avg_confidence FROM reviewed GROUP BY run""",
    ("reviewed",),
)
def run_log(spark, d):
    return rp.run_log(reviewed(spark, d), ["run"])


def order_runs(spark, d):
    return b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("doc "), s(F.col("o_custkey"))).alias("document_name"),
        (F.col("o_custkey") % 5).alias("brand_id"), F.col("o_orderdate").alias("created_at"),
    )


@query(
    "g14_runs_for", "SELECT o_orderkey AS run_id, o_custkey % 5 AS brand_id FROM orders WHERE o_custkey = 14",
)
def runs_for(spark, d):
    return rp.runs_for(order_runs(spark, d), "doc 14", 4).select("run_id", "brand_id")


@query("g14_recent_runs", "SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_runs(spark, d):
    return rp.recent_runs(order_runs(spark, d)).select("run_id")


@query(
    "g15_brand_counts",
    """SELECT n_name AS brand, count(d.doc_id) AS reference_count FROM nation LEFT JOIN documents d ON d.source = 'src' || n_nationkey GROUP BY n_name""",
)
def brand_counts(spark, d):
    parents = b.table(spark, d, "nation").select("n_name", F.concat(F.lit("src"), s(F.col("n_nationkey"))).alias("brand"))
    return rp.parent_counts(parents, iq.library_docs(spark, d), "brand").select(F.col("n_name").alias("brand"), "reference_count")


@query(
    "g15_folder_counts",
    """SELECT r_regionkey::BIGINT AS folder_id, count(reference_id) AS reference_count FROM region LEFT JOIN library_docs ON folder_id = r_regionkey GROUP BY r_regionkey""",
    ("library_docs",),
)
def folder_counts(spark, d):
    parents = b.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("folder_id"))
    return rp.parent_counts(parents, iq.library_docs(spark, d), "folder_id")


_DEDUP = "array_to_string(regexp_extract_all(lower(trim(regexp_replace(text, '[.,;:!?]+$', ''))), '[\\p{L}\\p{N}%]+(?:[.-][\\p{L}\\p{N}%]+)*'), ' ')"


@query(
    "g16_compare_runs",
    f"""SELECT coalesce(f.doc_id, m.doc_id) AS doc_id, md5(coalesce(f.t, m.t)) AS text_md5,
      CASE WHEN f.t IS NOT NULL AND m.t IS NOT NULL THEN 'found' WHEN m.t IS NOT NULL THEN 'missed' ELSE 'extra' END AS outcome
    FROM (SELECT DISTINCT doc_id, {_DEDUP} AS t FROM sentence_rows WHERE length(text) % 3 <> 0) f
    FULL JOIN (SELECT DISTINCT doc_id, {_DEDUP} AS t FROM sentence_rows WHERE length(text) % 2 = 0) m ON f.doc_id = m.doc_id AND f.t = m.t""",
    ("sentence_rows",),
)
def compare_runs(spark, d):
    rows = b.sentence_rows(spark, d).withColumn("dedup_text", un.norm_dedup(F.col("text")))
    out = rp.compare_runs(rows.filter(F.length("text") % 3 != 0), rows.filter(F.length("text") % 2 == 0), ["doc_id"])
    return out.select("doc_id", F.md5("dedup_text").alias("text_md5"), "outcome")


@query(
    "g17_feedback_for",
    """SELECT event_id AS feedback_id, user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_latest FROM events""",
)
def feedback_for(spark, d):
    t = b.table(spark, d, "events").select(F.col("event_id").alias("feedback_id"), F.col("user_id").alias("document_id"),
                                           F.col("ts").alias("created_at"))
    out = rp.feedback_for(t, "document_id")
    return out.select("feedback_id", "document_id", F.col("recency").cast("long").alias("recency"), "is_latest")


def line_id():
    """An order line's number within its order is not unique here; part and supplier make it so."""
    return F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")


SQL_LINE_ID = "(l_linenumber::BIGINT * 10000000000 + l_partkey * 10000 + l_suppkey)"


def markers(spark, d):
    """Order lines as page markers of one or two boxes."""
    t = b.table(spark, d, "lineitem")
    y = ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 11) % 120).cast("double")
    x = (F.col("l_suppkey") % 40).cast("double")

    def box(x0, y0):
        return F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 10).alias("y1"))

    rects = (
        F.when(F.col("l_linenumber") % 3 == 0, F.array(box(x, y), box(x + 60, y + 3)))
        .when(F.col("l_linenumber") % 3 == 1, F.array(box(x, y), box(x + 33, y + 3))).otherwise(F.array(box(x, y)))
    )
    return t.select(
        F.col("l_orderkey").alias("doc"), (F.floor("l_quantity") % 2).cast("int").alias("page"),
        F.concat(F.lit("m"), s(F.col("l_linenumber"))).alias("marker_id"), line_id().alias("ord"), rects.alias("rects"),
    )


@query(
    "g18_marker_order",
    f"""WITH m AS (SELECT l_orderkey AS doc, (trunc(l_quantity) % 2)::INT AS page, {SQL_LINE_ID} AS ord, l_linenumber AS ln, ((l_partkey * 7 + l_linenumber * 11) % 120)::DOUBLE AS y,
        (l_suppkey % 40)::DOUBLE AS x, l_linenumber % 3 AS kind FROM lineitem),
    sp AS (SELECT doc, page, 'm' || ln || CASE WHEN kind = 0 THEN '-L' ELSE '' END AS marker_id, ord, 0 AS part, y AS top,
        CASE WHEN kind = 1 THEN y + 13 ELSE y + 10 END AS bottom, x AS x0, CASE WHEN kind = 1 THEN x + 63 ELSE x + 30 END AS x1 FROM m
      UNION ALL SELECT doc, page, 'm' || ln || '-R', ord, 1, y + 3, y + 13, x + 60, x + 90 FROM m WHERE kind = 0),
    j AS (SELECT *, least(lag(x1) OVER w - lag(x0) OVER w, x1 - x0) AS width, greatest(0, least(lag(x1) OVER w, x1) - greatest(lag(x0) OVER w, x0)) AS shared,
        top - lag(bottom) OVER w AS gap FROM sp WINDOW w AS (PARTITION BY doc, page ORDER BY top, ord, part)),
    n AS (SELECT *, sum(CASE WHEN width > 0 AND shared / width > 0.3 AND gap <= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY top, ord, part) AS idx FROM j)
    SELECT doc, page, idx::BIGINT AS index, arg_min(marker_id, {{'a': top, 'b': ord, 'c': part}}) AS marker_id, count(*) AS n_merged, min(top) AS top, max(bottom) AS bottom
    FROM n GROUP BY doc, page, idx""",
)
def marker_order(spark, d):
    return rp.marker_order(markers(spark, d)).withColumn("index", F.col("index").cast("long"))


@query(
    "g19_training_totals",
    """SELECT conv_id AS session_id, count(*) FILTER (WHERE turn % 3 = 0) AS approved, count(*) FILTER (WHERE turn % 3 = 1) AS rejected,
      count(*) FILTER (WHERE turn % 3 = 2) AS missed FROM conversations GROUP BY ROLLUP (conv_id)""",
)
def training_totals(spark, d):
    t = b.table(spark, d, "conversations")
    kind = F.when(F.col("turn") % 3 == 1, "FalsePositive").when(F.col("turn") % 3 == 2, "MissedClaim")
    # one group is one conversation
    g = t.groupBy(F.col("conv_id").alias("session_id")).agg(F.collect_list(F.struct("text", kind.alias("type"))).alias("approved_claims"))
    return rp.training_totals(g)
