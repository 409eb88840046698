"""Library scans, responses, work lists and passages over the given tables (survey groups S and P)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import passages as ps
from claimloom.plans import bindings as b
from claimloom.plans.registry import fragment, query
from claimloom.session import shared_folder
from claimloom.sources import ingest as ig


def s(c):
    return c.cast("string")


def long(name):
    return F.col(name).cast("long").alias(name)


def library_docs(spark, d):
    t = b.table(spark, d, "documents")
    k = F.col("doc_id")
    return t.select(
        k.alias("reference_id"), F.col("source").alias("brand"),
        F.when(k % 17 != 0, F.col("text")).alias("content_text"),
        F.when(k % 5 != 0, k % 5).alias("folder_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int")).alias("upload_date"),
        F.when(k % 13 == 0, F.date_add(F.lit("2024-06-01").cast("date"), (k % 30).cast("int"))).alias("deleted_at"),
        F.when(k % 3 == 0, "docx").otherwise("pdf").alias("doc_type"),
        F.when(k % 4 == 0, "").when(k % 4 != 1, "[]").alias("page_boundaries"),
        F.when(k % 6 != 0, "{}").alias("citation_metadata"),
    )


fragment(
    "library_docs",
    """SELECT doc_id AS reference_id, source AS brand, CASE WHEN doc_id % 17 <> 0 THEN text END AS content_text,
    CASE WHEN doc_id % 5 <> 0 THEN doc_id % 5 END AS folder_id, DATE '2024-01-01' + (doc_id % 365)::INT AS upload_date,
    CASE WHEN doc_id % 13 = 0 THEN DATE '2024-06-01' + (doc_id % 30)::INT END AS deleted_at,
    CASE WHEN doc_id % 3 = 0 THEN 'docx' ELSE 'pdf' END AS doc_type,
    CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 <> 1 THEN '[]' END AS page_boundaries,
    CASE WHEN doc_id % 6 <> 0 THEN '{}' END AS citation_metadata FROM documents""",
)


def library_facts(spark, d):
    t = b.table(spark, d, "labels")
    k = F.col("doc_id")
    status = F.when(F.col("quality") == 1, "indexed").when(k % 2 == 0, "failed").otherwise("pending")
    facts = F.transform(F.sequence(F.lit(0), k % 7), lambda i: F.struct(
        F.when(i % 3 == 2, "").otherwise(F.concat(F.lit("fact "), s(i), F.lit(" of "), s(k))).alias("text")))
    return t.groupBy("doc_id").agg(F.max("quality").alias("quality")).select(
        k.alias("reference_id"), status.alias("extraction_status"),
        F.when(F.col("quality") == 1, facts).alias("facts"),
        F.when(k % 3 == 0, F.array(F.lit(1.0))).alias("embedding"),
    )


fragment(
    "library_facts",
    """SELECT doc_id AS reference_id, CASE WHEN quality = 1 THEN 'indexed' WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'pending' END AS extraction_status,
    CASE WHEN quality = 1 THEN list_transform(range(0, doc_id % 7 + 1), i -> CASE WHEN i % 3 = 2 THEN '' ELSE 'fact ' || i || ' of ' || doc_id END) END AS facts,
    CASE WHEN doc_id % 3 = 0 THEN [1.0] END AS embedding
    FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)""",
)

_LIB = """SELECT d.reference_id, brand, folder_id, content_text IS NOT NULL AS has_content, extraction_status,
  coalesce(len(facts), 0) AS facts_count, {} AS day FROM library_docs d LEFT JOIN library_facts USING (reference_id) WHERE deleted_at IS {}"""


@query("s01_library", _LIB.format("strftime(upload_date, '%Y-%m-%d')", "NULL"), ("library_docs", "library_facts"))
def library(spark, d):
    return ig.library(library_docs(spark, d), library_facts(spark, d)).select(
        "reference_id", "brand", "folder_id", "has_content", "extraction_status", long("facts_count"),
        s(F.col("upload_date")).alias("day"),
    )


@query("s02_trash", _LIB.format("strftime(deleted_at, '%Y-%m-%d')", "NOT NULL"), ("library_docs", "library_facts"))
def trash(spark, d):
    return ig.trash(library_docs(spark, d), library_facts(spark, d)).select(
        "reference_id", "brand", "folder_id", "has_content", "extraction_status", long("facts_count"),
        s(F.col("deleted_at")).alias("day"),
    )


@query(
    "s03_assemble_pages",
    """SELECT doc_id, page, (sum(length(page_text) + 2) OVER (PARTITION BY doc_id ORDER BY page))::BIGINT - length(page_text) AS start_char,
      (sum(length(page_text) + 2) OVER (PARTITION BY doc_id ORDER BY page))::BIGINT AS end_char FROM doc_pages""",
    ("doc_pages",),
)
def assemble_pages(spark, d):
    return ig.assemble_pages(b.doc_pages(spark, d)).select("doc_id", "page", "start_char", "end_char")


@query(
    "s03_assemble_text",
    """SELECT doc_id, md5(chr(10) || chr(10) || string_agg(page_text, chr(10) || chr(10) ORDER BY page)) AS text_md5 FROM doc_pages GROUP BY doc_id""",
    ("doc_pages",),
)
def assemble_text(spark, d):
    return ig.assemble_text(b.doc_pages(spark, d)).select("doc_id", F.md5("content_text").alias("text_md5"))


def raw_responses(spark, d):
    """Every turn as a model response: plain, fenced, wrapped in prose, or broken."""
    t = b.table(spark, d, "conversations")
    k = F.col("conv_id") + F.col("turn")
    claim = F.struct(
        F.concat(F.lit("  "), F.col("text"), F.lit("\n ")).alias("claim"),
        F.when(k % 5 == 0, F.lit("high")).otherwise(s(k % 130 + 0.5)).alias("confidence"),
        F.when(k % 7 == 0, F.lit("p1")).otherwise(s(F.col("turn") + 1)).alias("page"),
        s(F.col("conv_id") % 150).alias("x"), F.when(k % 4 == 0, F.lit(None)).otherwise(s(F.col("turn") * 9)).alias("y"),
        F.array(s(F.col("turn")), s(k % 9), F.lit("-2"), F.lit("1.5")).alias("refNumbers"),
        F.when(k % 3 == 0, "slide").when(k % 3 == 1, "notes").otherwise("footer").alias("region"),
    )
    blank = F.struct(*[F.lit(" ").alias("claim") if n == "claim" else claim[n].alias(n) for n in
                       ("claim", "confidence", "page", "x", "y", "refNumbers", "region")])
    refs = F.create_map(
        s(F.col("turn") % 3 + 1),
        F.create_map(
            F.when(k % 2 == 0, "slide").otherwise("notes"),
            F.create_map(s(F.col("conv_id") % 4 + 1), F.substring("text", 1, 700), F.lit("9"), F.concat(F.lit("turn "), s(F.col("turn")))),
        ),
    )
    body = F.to_json(F.struct(F.array(claim, blank).alias("claims"), refs.alias("pageReferences")))
    shaped = (
        F.when(k % 4 == 0, body)
        .when(k % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 4 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .otherwise(F.concat(F.lit("Sorry {"), F.substring(body, 1, 20)))
    )
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pass_no"), shaped.alias("body"))


@query(
    "s04_parse_responses",
    """SELECT conv_id AS doc_id, turn AS pass_no, (conv_id + turn) % 4 <> 3 AS parsed, CASE WHEN (conv_id + turn) % 4 <> 3 THEN 2 END::BIGINT AS n_claims
    FROM conversations""",
)
def parse_responses(spark, d):
    good, bad = ig.parse_responses(raw_responses(spark, d))
    return good.select(
        "doc_id", "pass_no", F.lit(True).alias("parsed"), F.size("response.claims").cast("long").alias("n_claims")
    ).unionByName(bad.select("doc_id", "pass_no", F.lit(False).alias("parsed"), F.lit(None).cast("long").alias("n_claims")))


fragment(
    "sanitized",
    """SELECT conv_id AS doc_id, turn AS pass_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text,
      (CASE WHEN k % 5 = 0 THEN 60 ELSE least(100, k % 130 + 1) END)::INT AS confidence,
      (CASE WHEN k % 7 = 0 THEN 1 ELSE turn + 1 END)::INT AS page, least(100, conv_id % 150)::DOUBLE AS x,
      (CASE WHEN k % 4 = 0 THEN 0 ELSE least(100, turn * 9) END)::DOUBLE AS y,
      array_to_string(list_filter([turn, k % 9], n -> n > 0), ',') AS refs,
      CASE k % 3 WHEN 0 THEN 'slide' WHEN 1 THEN 'notes' END AS region
    FROM (SELECT *, conv_id + turn AS k FROM conversations) WHERE k % 4 <> 3 AND trim(text) <> ''""",
)


@query("s05_sanitize_claims", "SELECT * FROM sanitized", ("sanitized",))
def sanitize_claims(spark, d):
    good, _ = ig.parse_responses(raw_responses(spark, d))
    return ig.sanitize_claims(good).withColumn("refs", F.array_join("ref_numbers", ",")).drop("ref_numbers", "pos")


@query(
    "s06_to_claims",
    """SELECT doc_id, 'claim_' || lpad(row_number() OVER (PARTITION BY doc_id ORDER BY pass_no)::VARCHAR, 3, '0') AS id,
      round(confidence / 100.0, 6)::DOUBLE AS confidence, 'pending' AS status, page FROM sanitized""",
    ("sanitized",),
)
def to_claims(spark, d):
    good, _ = ig.parse_responses(raw_responses(spark, d))
    c = ig.to_claims(ig.sanitize_claims(good), "doc_id", ["pass_no", "pos"])
    return c.select("doc_id", "id", F.round("confidence", 6).alias("confidence"), "status", "page")


fragment(
    "merged_refs",
    """SELECT doc_id, page, region, ref_no, arg_max(citation_text, pass_no) AS citation_text FROM (
      SELECT conv_id AS doc_id, turn AS pass_no, (turn % 3 + 1)::INT AS page, CASE WHEN (conv_id + turn) % 2 = 0 THEN 'slide' ELSE 'notes' END AS region,
        unnest([(conv_id % 4 + 1)::INT, 9]) AS ref_no, unnest([substring(text, 1, 700), 'turn ' || turn]) AS citation_text
      FROM conversations WHERE (conv_id + turn) % 4 <> 3) GROUP BY ALL""",
)


@query("s07_merge_page_refs", "SELECT doc_id, page, region, ref_no, md5(citation_text) AS text_md5 FROM merged_refs", ("merged_refs",))
def merge_page_refs(spark, d):
    good, _ = ig.parse_responses(raw_responses(spark, d))
    return ig.merge_page_refs(ig.page_ref_rows(good, ["doc_id", "pass_no"])).select(
        "doc_id", "page", "region", "ref_no", F.md5("citation_text").alias("text_md5")
    )


@query(
    "s08_cap_page_refs",
    """SELECT doc_id, page, region, ref_no, length(citation_text) AS n_chars FROM (
      SELECT doc_id, page, region, ref_no, substring(citation_text, 1, 100) AS citation_text,
        dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS p, row_number() OVER (PARTITION BY doc_id, page, region ORDER BY ref_no) AS r
      FROM merged_refs) WHERE p <= 2 AND r <= 1""",
    ("merged_refs",),
)
def cap_page_refs(spark, d):
    good, _ = ig.parse_responses(raw_responses(spark, d))
    pool = ig.merge_page_refs(ig.page_ref_rows(good, ["doc_id", "pass_no"]))
    return ig.cap_page_refs(pool, 2, 1, 100).select(
        "doc_id", "page", "region", "ref_no", F.length("citation_text").cast("long").alias("n_chars")
    )


@query(
    "s09_load_benchmark",
    """SELECT item_id AS ord, CASE WHEN item_id % 3 = 0 THEN 'claim-' || item_id ELSE 'b' || item_id END AS id, md5(trim(text, ' ' || chr(10))) AS text_md5,
      (CASE WHEN item_id % 3 = 2 THEN item_id % 5 + 1 ELSE 7 END)::INT AS brand_id,
      CASE WHEN item_id % 3 = 2 THEN (item_id + 1)::INT END AS expected_reference_id, CASE WHEN item_id % 3 = 1 THEN 'Ref ' || item_id END AS expected_alias
    FROM benchmark""",
)
def load_benchmark(spark, d):
    t = b.table(spark, d, "benchmark")
    k = F.col("item_id")
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    plain = F.to_json(F.struct(text.alias("t")))
    entry = (
        F.when(k % 3 == 0, F.regexp_extract(plain, r"(?s)^\{\"t\":(.*)\}$", 1))
        .when(k % 3 == 1, F.to_json(F.struct(F.concat(F.lit("b"), s(k)).alias("id"), text.alias("claimText"),
                                             F.concat(F.lit("Ref "), s(k)).alias("expectedAlias"))))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("b"), s(k)).alias("id"), text.alias("claim_text"),
                                      (k % 5 + 1).alias("brandId"), s(k + 1).alias("expected_reference_id"))))
    )
    ok, _ = ig.load_benchmark(t.select(k.alias("ord"), entry.alias("entry")), default_brand=7)
    return ok.withColumn("text_md5", F.md5("claim_text")).drop("claim_text")


def sessions(spark, d):
    """One training session per conversation; user turns are its approved claims."""
    t = b.table(spark, d, "conversations")
    user = F.when(F.col("role") == "user", F.struct("turn", F.col("text")))
    # one group is one conversation
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(user)).alias("u"))
    return g.select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") % 20).alias("brand_id"),
        F.when(F.col("conv_id") % 6 == 0, "").otherwise(F.concat(F.lit("prompt "), s(F.col("conv_id")))).alias("prompt_text"),
        F.when(F.col("conv_id") % 5 == 0, F.lit("2024-02-01")).alias("cleared_at"),
        F.transform("u", lambda x: F.struct(x["text"].alias("text"), F.lit("Claim").alias("type"))).alias("approved_claims"),
    )


@query(
    "s10_export_training",
    """SELECT conv_id AS session_id, 'prompt ' || conv_id AS text_input, count(*) FILTER (WHERE role = 'user') AS n_claims
    FROM conversations WHERE conv_id % 6 <> 0 AND conv_id % 5 <> 0 GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0""",
)
def export_training(spark, d):
    lines = ig.export_training(sessions(spark, d))
    o = F.from_json("value", "text_input string, output string")
    n = F.size(F.from_json(o["output"], "array<struct<text:string,type:string>>")).cast("long")
    return lines.select("session_id", o["text_input"].alias("text_input"), n.alias("n_claims"))


def scratch(spark) -> str:
    """A fresh folder under the session's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/claimloom-{uuid.uuid4().hex}"


@query(
    "s11_append_scorecard",
    """SELECT dataset_name, run, n * run AS total_requests FROM (SELECT source AS dataset_name, count(*) AS n FROM documents GROUP BY source),
      range(1, 3) r(run)""",
)
def append_scorecard(spark, d):
    base = b.table(spark, d, "documents").groupBy(F.col("source").alias("dataset_name")).agg(F.count("*").alias("n"))
    path = scratch(spark) + "/scorecard"
    for run in (1, 2):
        rows = base.select("dataset_name", F.lit(run).cast("long").alias("run"), (F.col("n") * run).alias("total_requests"))
        ig.append_scorecard(rows, path)
    return spark.read.parquet(path)


@query(
    "s12_replace_passages",
    """SELECT doc_id AS reference_id, page, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM doc_pages
    WHERE NOT (doc_id % 3 = 0 AND page > 2)""",
    ("doc_pages",),
)
def replace_passages(spark, d):
    p = b.doc_pages(spark, d).select(F.col("doc_id").alias("reference_id"), "page")
    path = scratch(spark) + "/passages"
    ig.replace_passages(p.withColumn("version", F.lit(1).cast("long")), path)
    again = p.filter((F.col("reference_id") % 3 == 0) & (F.col("page") <= 2)).withColumn("version", F.lit(2).cast("long"))
    ig.replace_passages(again, path)
    ig.replace_passages(again, path)
    return spark.read.parquet(path).select("reference_id", "page", "version")


fragment("embedded_docs", "SELECT doc_id AS reference_id, CASE WHEN quality = 1 THEN [1.0] END AS embedding FROM labels")


def embedded_docs(spark, d):
    return b.table(spark, d, "labels").select(
        F.col("doc_id").alias("reference_id"), F.when(F.col("quality") == 1, F.array(F.lit(1.0))).alias("embedding")
    )


@query(
    "s13_needs_embedding",
    """SELECT reference_id, length(content_text)::BIGINT AS n_chars FROM library_docs WHERE deleted_at IS NULL AND length(content_text) > 0
      AND reference_id NOT IN (SELECT reference_id FROM embedded_docs WHERE embedding IS NOT NULL)""",
    ("library_docs", "embedded_docs"),
)
def needs_embedding(spark, d):
    return ig.needs_embedding(library_docs(spark, d), embedded_docs(spark, d)).select(
        "reference_id", F.length("content_text").cast("long").alias("n_chars")
    )


@query(
    "s14_needs_facts",
    """SELECT reference_id FROM library_docs WHERE content_text IS NOT NULL AND (reference_id NOT IN (
      SELECT reference_id FROM library_facts WHERE extraction_status = 'indexed') OR reference_id IN (
      SELECT reference_id FROM library_facts WHERE extraction_status = 'failed'))""",
    ("library_docs", "library_facts"),
)
def needs_facts(spark, d):
    return ig.needs_facts(library_docs(spark, d), library_facts(spark, d)).select("reference_id")


@query(
    "s15_fact_texts",
    """SELECT reference_id, array_to_string(list_filter(facts, t -> t <> ''), chr(10)) AS fact_text FROM library_facts
      WHERE extraction_status = 'indexed' AND embedding IS NULL AND reference_id IN (SELECT reference_id FROM library_docs WHERE deleted_at IS NULL)""",
    ("library_docs", "library_facts"),
)
def fact_texts(spark, d):
    return ig.fact_texts(library_docs(spark, d), library_facts(spark, d))


@query(
    "s17_needs_backfill",
    """SELECT reference_id, 'metadata' AS reason FROM library_docs WHERE citation_metadata IS NULL AND content_text IS NOT NULL
    UNION ALL SELECT reference_id, 'boundaries' FROM library_docs WHERE doc_type = 'pdf' AND (trim(coalesce(page_boundaries, '')) = ''
      OR trim(coalesce(citation_metadata, '')) = '')""",
    ("library_docs",),
)
def needs_backfill(spark, d):
    return ig.needs_backfill(library_docs(spark, d))


def annotation_responses(spark, d):
    """Conversations as annotation responses: user turns annotations, assistant turns review finds."""
    t = b.table(spark, d, "conversations")
    k = F.col("conv_id") + F.col("turn")
    ann = F.struct(
        "turn", F.col("text").alias("text"), F.when(k % 3 == 0, "notes").alias("region"),
        F.when(k % 2 == 0, F.array((k % 6).cast("int"))).alias("refNumbers"),
        F.when(k % 2 == 1, (k % 5).cast("int")).alias("refNumber"),
        F.array(F.lit(" first "), F.lit("second")).alias("references"),
        F.when(k % 4 == 0, F.lit("x")).otherwise(s(k % 120)).alias("confidence"), s(F.col("turn")).alias("page"),
        s(k % 140).alias("x"), s(F.col("turn") * 11 % 60).alias("y"),
    )
    # one group is one conversation
    g = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", ann))).alias("annotations"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", ann))).alias("claims"),
    )
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct("annotations", "claims")), F.lit("```"))
    return g.select(F.col("conv_id").alias("doc_id"), body.alias("body"))


_PLACED = """SELECT conv_id AS doc_id, '{prefix}' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id,
  CASE WHEN k % 3 = 0 THEN 'notes' ELSE 'slide' END AS region, {refs}
  (CASE WHEN k % 4 = 0 OR k % 120 = 0 THEN {conf} ELSE least(100, k % 120) END)::INT AS confidence, greatest(1, turn)::INT AS page,
  least(100, k % 140)::DOUBLE AS x, (turn * 11 % 60)::DOUBLE AS y,
  row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, turn * 11 % 60, turn) AS ord
  FROM (SELECT *, conv_id + turn AS k FROM conversations) WHERE role = '{role}'"""


@query(
    "s18_annotations",
    _PLACED.format(prefix="ann-", conf=80, role="user", refs="""(CASE WHEN k % 2 = 0 AND k % 6 > 0 THEN k % 6 WHEN k % 2 = 1 AND k % 5 > 0 THEN k % 5 ELSE 1 END)
      || ':first,2:second' AS refs,"""),
)
def annotations(spark, d):
    good, _ = ig.parse_responses(annotation_responses(spark, d), ig.ANNOTATION_SCHEMA)
    a = ig.to_annotations(good, "doc_id")
    refs = F.array_join(F.transform("references", lambda r: F.concat_ws(":", s(r["number"]), r["text"])), ",")
    return a.select("doc_id", "id", "region", refs.alias("refs"), "confidence", "page", "x", "y", long("ord"))


@query("s18_review_finds", _PLACED.format(prefix="ai-find-", conf=60, role="assistant", refs=""))
def review_finds(spark, d):
    good, _ = ig.parse_responses(annotation_responses(spark, d), ig.ANNOTATION_SCHEMA)
    return ig.to_finds(good, "doc_id").select("doc_id", "id", "region", "confidence", "page", "x", "y", long("ord"))


@query(
    "s19_valid_positions",
    """SELECT l_orderkey, l_linenumber, 'position' AS kind FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5 AND l_quantity * 3 BETWEEN 0 AND 100
      AND l_partkey % 90 < 57
    UNION ALL SELECT l_orderkey, l_linenumber, 'statement' FROM lineitem WHERE length(l_returnflag || l_linestatus || CASE WHEN l_linenumber > 2 THEN 'x' ELSE '' END) >= 3
      AND l_suppkey BETWEEN 1 AND 50 AND l_quantity * 3 BETWEEN 0 AND 100 AND l_partkey % 90 < 57""",
)
def valid_rows(spark, d):
    t = b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linenumber").alias("index"), (F.col("l_quantity") * 3).alias("x"),
        (F.col("l_partkey") % 90).alias("y"), F.array("l_suppkey").alias("ref_numbers"),
        F.concat("l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") > 2, "x").otherwise("")).alias("statement"),
    )
    edge = F.lit(55)
    keys = ["l_orderkey", "l_linenumber"]
    return ig.valid_positions(t, F.lit(5), edge).select(*keys, F.lit("position").alias("kind")).unionByName(
        ig.valid_statements(t, edge).select(*keys, F.lit("statement").alias("kind"))
    )


# ---- passages ----

fragment(
    "cuts",
    """SELECT reference_id, 0 AS i, content_text AS t, 0 AS s, CASE WHEN length(content_text) <= 4800 THEN length(content_text) ELSE
      4800 END AS e0 FROM refs WHERE length(content_text) > 0""",
    "refs",
)

_CUT = """CASE WHEN {e} < length(t) AND length(regexp_extract(substring(t, greatest({e} - 240, {s}) + 1, {e} - greatest({e} - 240, {s})), '(?s)^(.*)[.!?]\\s+[A-Z]', 1))
   > ({e} - greatest({e} - 240, {s})) * 0.35 AND regexp_matches(substring(t, greatest({e} - 240, {s}) + 1, {e} - greatest({e} - 240, {s})), '[.!?]\\s+[A-Z]')
   THEN greatest({e} - 240, {s}) + length(regexp_extract(substring(t, greatest({e} - 240, {s}) + 1, {e} - greatest({e} - 240, {s})), '(?s)^(.*)[.!?]\\s+[A-Z]', 1)) + 1 ELSE {e} END"""


def chunk_oracle(tail: str, size: int = 4800, lap: int = 800) -> str:
    first = _CUT.format(e=f"least({size}, length(t))", s="0")
    nxt = _CUT.format(e=f"least(ns + {size}, length(t))", s="ns")
    return f"""WITH RECURSIVE base AS (SELECT doc_id AS reference_id, text AS t FROM documents WHERE length(text) > 0),
    c(reference_id, t, i, s, e) AS (
      SELECT reference_id, t, 0, 0, {first} FROM base
      UNION ALL
      SELECT reference_id, t, i + 1, ns, {nxt} FROM (SELECT *, s + greatest(e - s - {lap}, 1) AS ns FROM c) q
      WHERE NOT (length(t) <= {size}) AND length(t) - ns >= {lap}),
    f AS (SELECT reference_id, i::INT AS passage_index, s::INT AS start_char,
      (CASE WHEN i = max(i) OVER (PARTITION BY reference_id) THEN length(t) ELSE e END)::INT AS end_char FROM c)
    {tail}"""


@query("p01_chunk", chunk_oracle("SELECT * FROM f"))
def chunk(spark, d):
    return ps.chunk(b.documents(spark, d).select("reference_id", "content_text")).select(
        "reference_id", "passage_index", "start_char", "end_char"
    )


@query(
    "p02_chunk_options",
    """SELECT doc_id, CASE WHEN n_chars * 10 >= 120000 THEN 3600 ELSE 4800 END::INT AS chunk_size,
      CASE WHEN n_chars * 10 >= 120000 THEN 600 ELSE 800 END::INT AS overlap FROM documents""",
)
def chunk_options(spark, d):
    o = ps.chunk_options(F.col("n_chars") * 10)
    return b.table(spark, d, "documents").select("doc_id", o["chunk_size"].alias("chunk_size"), o["overlap"].alias("overlap"))


@query(
    "p03_stride_chunks",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_no, s AS start_char, md5(substring(text, s + 1, 2400)) AS text_md5
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 2280)) AS s FROM documents) WHERE s = 0 OR (length(text) > 2400 AND s + 120 < length(text))""",
)
def stride_chunks(spark, d):
    t = b.table(spark, d, "documents").select("doc_id", "text")
    return ps.stride_chunks(t, "doc_id", "text", 2400, 120).select(
        "doc_id", long("chunk_no"), long("start_char"), F.md5("chunk_text").alias("text_md5")
    )


def with_boundaries(spark, d):
    """Documents with nested page boundaries of the assembled text and an offset to look up."""
    pages = ig.assemble_pages(b.doc_pages(spark, d))
    # one group is one document's pages
    nested = pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "start_char", "end_char"))).alias("boundaries"), F.max("end_char").alias("n")
    )
    offsets = F.array(F.lit(0), F.lit(2), F.lit(3002), F.lit(3003), F.lit(3004), F.col("n") - 1, F.col("n"), F.col("n") + 50,
                      F.col("doc_id") * 37 % F.col("n"))
    return nested.select("doc_id", "boundaries", F.posexplode(offsets).alias("k", "off"))


_OFFS = """SELECT doc_id, unnest(range(0, 9))::INT AS k, unnest([0, 2, 3002, 3003, 3004, n - 1, n, n + 50, doc_id * 37 % n]) AS off
  FROM (SELECT doc_id, max(end_char) AS n FROM bounds GROUP BY doc_id)"""
fragment(
    "bounds",
    """SELECT doc_id, page, (sum(length(page_text) + 2) OVER (PARTITION BY doc_id ORDER BY page))::BIGINT - length(page_text) AS start_char,
      (sum(length(page_text) + 2) OVER (PARTITION BY doc_id ORDER BY page))::BIGINT AS end_char FROM doc_pages""",
    "doc_pages",
)


@query(
    "p04_offset_to_page",
    f"SELECT o.doc_id, k, coalesce(max(page) FILTER (WHERE start_char <= off), 1) AS page FROM ({_OFFS}) o JOIN bounds USING (doc_id) GROUP BY ALL",
    ("bounds",),
)
def offset_to_page(spark, d):
    return with_boundaries(spark, d).select("doc_id", "k", ps.offset_to_page(F.col("off"), F.col("boundaries")).alias("page"))


@query(
    "p05_estimate_page",
    """SELECT doc_id, (floor((doc_id * 37 % 9000) / CASE WHEN pages > 0 THEN greatest(1, floor(n_chars / pages + 0.5)) ELSE 3000 END) + 1)::INT AS page
    FROM (SELECT *, doc_id % 4 AS pages FROM documents)""",
)
def estimate_page(spark, d):
    per = ps.chars_per_page(F.col("n_chars"), F.col("doc_id") % 4)
    return b.table(spark, d, "documents").select("doc_id", ps.estimate_page(F.col("doc_id") * 37 % 9000, per).alias("page"))


@query(
    "p06_offset_to_page_incl",
    f"""SELECT o.doc_id, k, coalesce(min(page) FILTER (WHERE start_char <= off AND off <= end_char), max(page)) AS page
    FROM ({_OFFS}) o JOIN bounds USING (doc_id) GROUP BY ALL""",
    ("bounds",),
)
def offset_to_page_incl(spark, d):
    return with_boundaries(spark, d).select("doc_id", "k", ps.offset_to_page_incl(F.col("off"), F.col("boundaries")).alias("page"))


@query(
    "p07_sanitize_page",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN user_id % 3 = 0 THEN CASE WHEN event_type = 'view' THEN trunc(value) ELSE value END
      ELSE least(greatest(floor(CASE WHEN event_type = 'view' THEN trunc(value) ELSE value END + 0.5), 1), user_id % 20 + 1) END::DOUBLE AS page FROM events""",
)
def sanitize_page(spark, d):
    t = b.table(spark, d, "events")
    raw = (
        F.when(F.col("event_type") == "error", "abc")
        .when(F.col("event_type") == "view", F.concat(s(F.col("value").cast("long")), F.lit(" of 9")))
        .otherwise(s(F.col("value")))
    )
    count = F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 20 + 1)
    return t.select("event_id", ps.sanitize_page(raw, count).alias("page"))


@query(
    "p08_passage_stats",
    chunk_oracle("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(length(text))::BIGINT FROM documents) AS chars, count(*) AS passages,
      round(count(*) / (SELECT count(*) FROM documents), 6) AS avg_passages FROM f"""),
)
def passage_stats(spark, d):
    return ps.passage_stats(b.documents(spark, d))


fragment(
    "page_rows",
    "SELECT doc_id AS reference_id, page, CASE WHEN (doc_id + page) % 3 > 0 THEN [1.0] END AS embedding FROM doc_pages", "doc_pages",
)


def page_rows(spark, d):
    return b.doc_pages(spark, d).select(
        F.col("doc_id").alias("reference_id"), "page",
        F.when((F.col("doc_id") + F.col("page")) % 3 > 0, F.array(F.lit(1.0))).alias("embedding"),
    )


@query(
    "p09_embedding_status",
    """SELECT reference_id, count(page) AS passage_count, count(embedding) AS embedded_count FROM library_docs LEFT JOIN page_rows USING (reference_id)
    WHERE deleted_at IS NULL GROUP BY reference_id""",
    ("library_docs", "page_rows"),
)
def embedding_status(spark, d):
    return ps.embedding_status(library_docs(spark, d), page_rows(spark, d)).select(
        "reference_id", "passage_count", "embedded_count"
    )


@query(
    "p09_embedding_status_by_brand",
    """SELECT brand, count(*) AS total_references, sum((e > 0)::INT)::BIGINT AS embedded_references, sum(n)::BIGINT AS total_passages FROM (
      SELECT brand, reference_id, count(page) AS n, count(embedding) AS e FROM library_docs LEFT JOIN page_rows USING (reference_id)
      WHERE deleted_at IS NULL GROUP BY ALL) GROUP BY brand""",
    ("library_docs", "page_rows"),
)
def embedding_status_by_brand(spark, d):
    return ps.embedding_status_by_brand(ps.embedding_status(library_docs(spark, d), page_rows(spark, d)))


def word_items(spark, d):
    """Words of the lines as positioned items; after every seventh word comes a wide gap."""
    words = b.lines(spark, d).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("pos", "str"))
    x = F.col("pos") * 30 + F.floor(F.col("pos") / 7) * 100
    return words.select(
        "doc_id", (F.floor(F.col("line_no") / 10) + 1).cast("int").alias("page"), F.col("pos").alias("item_no"), "str",
        x.cast("double").alias("x"), (F.col("line_no") % 10 * 12 + F.col("pos") % 4).cast("double").alias("y"),
        F.lit(24.0).alias("width"), F.lit(10.0).alias("height"),
    )


@query(
    "p10_lines_from_items",
    """SELECT doc_id, (line_no // 10 + 1)::INT AS page, string_agg(w, ' ' ORDER BY pos) AS text, (min(pos) * 30 + min(pos) // 7 * 100)::DOUBLE AS x,
      (line_no % 10 * 12 + min(pos % 4))::DOUBLE AS y, ((max(pos) - min(pos)) * 30 + 24)::DOUBLE AS width, count(*) AS n_items
    FROM (SELECT doc_id, line_no, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM lines))
    GROUP BY doc_id, line_no, pos // 7""",
    ("lines",),
)
def lines_from_items(spark, d):
    return ps.lines_from_items(word_items(spark, d), ["doc_id", "page"]).select(
        "doc_id", "page", "text", "x", "y", "width", long("n_items")
    )


@query(
    "p11_group_lines",
    """SELECT doc_id, (line_no // 10 + 1)::INT AS page, (line_no % 10)::DOUBLE AS y, line AS text FROM lines""",
    ("lines",),
)
def group_lines(spark, d):
    w = b.lines(spark, d).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("pos", "text"))
    spans = w.select(
        "doc_id", (F.floor(F.col("line_no") / 10) + 1).cast("int").alias("page"),
        (F.col("line_no").cast("long") * 100000 + F.col("pos")).alias("span_no"), "text",
        F.col("pos").cast("double").alias("x"), (F.col("line_no") % 10 + (F.col("pos") % 3) * 0.2).alias("y"),
    )
    return ps.group_lines(spans, ["doc_id", "page"], 0.5).select("doc_id", "page", F.round("y", 6).alias("y"), "text")


@query(
    "p12_notes_boundary",
    """SELECT doc_id, (line_no // 10 + 1)::INT AS page, coalesce(min(line_no % 10 * 9) FILTER (WHERE doc_id % 3 = 0 AND line_no % 10 >= 5), 50)::DOUBLE AS boundary
    FROM lines GROUP BY ALL""",
    ("lines",),
)
def notes_boundary(spark, d):
    label = (F.col("doc_id") % 3 == 0) & (F.col("line_no") % 10 >= 5)
    spans = b.lines(spark, d).select(
        "doc_id", (F.floor(F.col("line_no") / 10) + 1).cast("int").alias("page"), F.col("line_no").alias("span_no"),
        F.when(label, " Speaker  Notes ").otherwise(F.col("line")).alias("text"), (F.col("line_no") % 10 * 9).cast("double").alias("y"),
    )
    return ps.notes_boundary(spans, ["doc_id", "page"])
