"""Library tables, model responses and work lists (survey group S)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as tx

RESPONSE_SCHEMA = (
    "claims array<struct<claim:string,confidence:string,page:string,x:string,y:string,refNumbers:array<string>,region:string>>,"
    "pageReferences map<string,map<string,map<string,string>>>"
)
ANNOTATION_SCHEMA = (
    "annotations array<struct<text:string,region:string,refNumbers:array<int>,refNumber:int,references:array<string>,"
    "reference:string,contentType:string,confidence:string,page:string,x:string,y:string>>,"
    "claims array<struct<text:string,region:string,contentType:string,confidence:string,page:string,x:string,y:string>>"
)


# ---- library scans ----


def _with_facts(docs: DataFrame, facts: DataFrame) -> DataFrame:
    f = facts.select("reference_id", "extraction_status", F.size("facts").alias("n"))
    return (
        docs.join(f, "reference_id", "left")
        .withColumn("has_content", F.col("content_text").isNotNull())
        .withColumn("facts_count", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)))
        .drop("n", "content_text")
    )


def library(docs: DataFrame, facts: DataFrame, brand: str | None = None, folder: int | None = None) -> DataFrame:
    """Live documents with fact status and count, newest first."""
    live = docs.filter(F.col("deleted_at").isNull())
    if brand is not None:
        live = live.filter(F.col("brand") == brand)
    if folder is not None:
        live = live.filter(F.col("folder_id") == folder)
    return _with_facts(live, facts).orderBy(F.desc("upload_date"), "reference_id")


def trash(docs: DataFrame, facts: DataFrame, brand: str | None = None) -> DataFrame:
    """Soft-deleted documents, last deleted first."""
    gone = docs.filter(F.col("deleted_at").isNotNull())
    if brand is not None:
        gone = gone.filter(F.col("brand") == brand)
    return _with_facts(gone, facts).orderBy(F.desc("deleted_at"), "reference_id")


def assemble_pages(doc_pages: DataFrame) -> DataFrame:
    """Page boundaries in the assembled text (a leading blank line, one blank line between pages)."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("page_text") + 2).over(w)
    return doc_pages.withColumn("end_char", end.cast("long")).withColumn("start_char", F.col("end_char") - F.length("page_text"))


def assemble_text(doc_pages: DataFrame) -> DataFrame:
    """Full text per document; one group is one document's pages."""
    pages = doc_pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "page_text"))).alias("p"))
    texts = F.transform("p", lambda p: p["page_text"])
    return pages.select("doc_id", F.concat(F.lit("\n\n"), F.array_join(texts, "\n\n")).alias("content_text"))


# ---- model responses ----


def json_body(body: Column) -> Column:
    """The JSON part of a model response, or null: whole text, fenced block, outermost braces."""
    def first_valid(t: Column) -> Column:
        fenced = F.trim(F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1))
        sliced = F.regexp_extract(t, r"(?s)([{\[].*[}\]])", 1)
        usable = F.filter(F.array(t, fenced, sliced), lambda c: (c != "") & F.try_parse_json(c).isNotNull())
        return F.get(usable, F.lit(0))

    return tx.bind(F.regexp_replace(tx.text_or_empty(body), r"^\s+|\s+$", ""), first_valid)


def parse_responses(raw: DataFrame, schema: str = RESPONSE_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Parsed responses (column ``response``) and the rejects."""
    parsed = raw.withColumn("json", json_body(F.col("body")))
    good = parsed.filter(F.col("json").isNotNull()).withColumn("response", F.from_json("json", schema)).drop("json", "body")
    return good, parsed.filter(F.col("json").isNull()).drop("json")


def leading_int(c: Column) -> Column:
    return F.regexp_extract(tx.text_or_empty(c), r"^\s*([-+]?\d{1,9})", 1).try_cast("int")


def _clamped(c: Column, low: float, high: float, default: float) -> Column:
    number = c.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), number)))


def _round(c: Column) -> Column:
    return F.floor(c + 0.5)


def sanitize_claims(good: DataFrame) -> DataFrame:
    """One row per usable raw claim: text, confidence 0..100, page, x, y, ref_numbers, region, pos."""
    rows = good.select(*[c for c in good.columns if c != "response"], F.posexplode("response.claims").alias("pos", "c"))
    refs = F.transform(F.filter("c.refNumbers", lambda n: n.rlike(r"^\d{1,9}$") & (n.try_cast("int") > 0)), lambda n: n.try_cast("int"))
    number = F.col("c.confidence").try_cast("double")
    confidence = F.when(number.isNull() | F.isnan(number), F.lit(60)).otherwise(
        F.least(F.lit(100), F.greatest(F.lit(0), _round(number)))
    )
    page = F.coalesce(F.nullif(leading_int(F.col("c.page")), F.lit(0)), F.lit(1))
    return rows.select(
        *[c for c in good.columns if c != "response"], "pos", tx.norm_inline(F.col("c.claim")).alias("text"),
        confidence.cast("int").alias("confidence"), F.greatest(F.lit(1), page).alias("page"),
        _clamped(F.col("c.x"), 0.0, 100.0, 0.0).alias("x"), _clamped(F.col("c.y"), 0.0, 100.0, 0.0).alias("y"),
        refs.alias("ref_numbers"),
        F.when(F.col("c.region").isin("slide", "notes"), F.col("c.region")).alias("region"),
    ).filter("text <> ''")


def to_claims(raw_claims: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Raw claims as pending claims, numbered per document."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    return raw_claims.withColumn("id", F.format_string("claim_%03d", n)).withColumn(
        "confidence", F.col("confidence") / 100.0
    ).withColumn("status", F.lit("pending"))


def page_ref_rows(good: DataFrame, keys: list[str]) -> DataFrame:
    """Reference pools of responses as rows: keys, page, region, ref_no, citation_text."""
    pages = good.select(*keys, F.explode("response.pageReferences").alias("page", "sections"))
    regions = pages.select(*keys, "page", F.explode("sections").alias("region", "refs")).filter(F.col("region").isin("slide", "notes"))
    return regions.select(
        *keys, F.col("page").try_cast("int").alias("page"), "region", F.explode("refs").alias("ref_no", "citation_text")
    ).withColumn("ref_no", F.col("ref_no").try_cast("int"))


def merge_page_refs(rows: DataFrame) -> DataFrame:
    """Pools over passes: a later pass replaces the text of a number."""
    return rows.groupBy("doc_id", "page", "region", "ref_no").agg(F.max_by("citation_text", "pass_no").alias("citation_text"))


def cap_page_refs(pool: DataFrame, pages: int = 200, refs: int = 50, chars: int = 500) -> DataFrame:
    """The documented limits of a request: pages per document, numbers per region, characters per text."""
    page_rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page"))
    ref_rank = F.row_number().over(Window.partitionBy("doc_id", "page", "region").orderBy("ref_no"))
    kept = pool.withColumn("_p", page_rank).withColumn("_r", ref_rank).filter((F.col("_p") <= pages) & (F.col("_r") <= refs))
    return kept.drop("_p", "_r").withColumn("citation_text", F.substring("citation_text", 1, chars))


def load_benchmark(entries: DataFrame, default_brand: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Benchmark entries (columns ord, entry: a JSON string or object) with aliases resolved, and the rejects."""
    schema = (
        "id string, claim_text string, claimText string, text string, brand_id string, brandId string, "
        "expected_reference_id string, expectedReferenceId string, expected_reference_alias string, "
        "expected_alias string, expectedAlias string, expected_display_alias string"
    )
    o = F.from_json("entry", schema)
    plain = F.from_json(F.concat(F.lit("["), "entry", F.lit("]")), "array<string>")
    is_text = F.col("entry").rlike(r'^\s*"')

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(o[n], F.lit("")) for n in names])

    def positive(c: Column) -> Column:
        n = leading_int(c)
        return F.when(n > 0, n)

    brand = F.when(is_text, F.lit(None)).otherwise(positive(first("brand_id", "brandId")))
    rows = entries.select(
        "ord",
        F.coalesce(F.when(~is_text, o["id"]), F.concat(F.lit("claim-"), F.col("ord").cast("string"))).alias("id"),
        F.when(is_text, F.get(plain, F.lit(0))).otherwise(F.trim(first("claim_text", "claimText", "text"))).alias("claim_text"),
        F.coalesce(brand, F.lit(default_brand).cast("int")).alias("brand_id"),
        F.when(~is_text, positive(first("expected_reference_id", "expectedReferenceId"))).alias("expected_reference_id"),
        F.when(~is_text, first("expected_reference_alias", "expected_alias", "expectedAlias", "expected_display_alias")).alias("expected_alias"),
    )
    ok = (F.coalesce("claim_text", F.lit("")) != "") & F.col("brand_id").isNotNull()
    return rows.filter(ok), rows.filter(~ok)


def export_training(sessions: DataFrame) -> DataFrame:
    """One JSON line per active session with a prompt and at least one claim (column ``value``)."""
    ready = sessions.filter(
        F.col("cleared_at").isNull() & (F.coalesce("prompt_text", F.lit("")) != "") & (F.size("approved_claims") > 0)
    )
    return ready.select(
        "session_id",
        F.to_json(F.struct(F.col("prompt_text").alias("text_input"), F.to_json("approved_claims").alias("output"))).alias("value"),
    )


def append_scorecard(summary: DataFrame, path: str) -> None:
    """Append the rows of a benchmark summary to the scorecard table."""
    summary.write.mode("append").parquet(path)


def replace_passages(new: DataFrame, path: str, buckets: int = 64, writers: int = 8, file_rows: int = 1_000_000) -> None:
    """Replace all passages of the documents in ``new``; running it twice gives the same table.

    The table is partitioned by a document bucket, and only touched buckets are read and rewritten.  A bucket is written by
    several tasks (``writers``) in files of at most ``file_rows`` rows; ``buckets`` grows with the table (thousands for a large
    one) and stays the same for one table.  What is kept is stored in the shared folder before buckets are replaced, so a
    run that breaks off can be repeated.
    """
    spark = new.sparkSession
    spot = F.pmod(F.xxhash64("reference_id"), F.lit(buckets * writers))
    rows = new.withColumn("bucket", F.floor(spot / writers).cast("int"))

    def write(table: DataFrame, mode: str) -> None:
        spread = table.withColumn("writer", (F.pmod(F.xxhash64("reference_id"), F.lit(buckets * writers)) % writers).cast("int"))
        out = spread.repartition("bucket", "writer").drop("writer").write.mode(mode).option("partitionOverwriteMode", "dynamic")
        out.option("maxRecordsPerFile", file_rows).partitionBy("bucket").parquet(path)

    try:
        old = spark.read.parquet(path)
    except Exception as exc:  # first write
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        write(rows, "append")
        return
    touched = rows.select("bucket").distinct()
    kept = old.join(touched, "bucket", "left_semi").join(new.select("reference_id").distinct(), "reference_id", "left_anti")
    from claimloom.session import durable

    write(durable(kept.select(*rows.columns).unionByName(rows)), "overwrite")


# ---- work lists ----


def needs_embedding(docs: DataFrame, passages: DataFrame, force: bool = False) -> DataFrame:
    """Live documents with text and no embedded passage."""
    todo = docs.filter(F.col("deleted_at").isNull() & (F.length("content_text") > 0))
    if force:
        return todo
    done = passages.filter(F.col("embedding").isNotNull()).select("reference_id").distinct()
    return todo.join(done, "reference_id", "left_anti")


def needs_facts(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents that are not indexed, or whose indexing failed."""
    done = facts.filter(F.col("extraction_status") == "indexed").select("reference_id")
    failed = facts.filter(F.col("extraction_status") == "failed").select("reference_id")
    settled = done.join(failed, "reference_id", "left_anti").distinct()
    return docs.filter(F.col("content_text").isNotNull()).join(settled, "reference_id", "left_anti")


def fact_texts(docs: DataFrame, facts: DataFrame, force: bool = False) -> DataFrame:
    """Fact texts to embed, one line per fact, of live indexed documents without a fact vector."""
    rows = facts.filter(F.col("extraction_status") == "indexed")
    if not force:
        rows = rows.filter(F.col("embedding").isNull())
    texts = F.filter(F.transform("facts", lambda f: F.coalesce(f["text"], F.lit(""))), lambda t: t != "")
    live = docs.filter(F.col("deleted_at").isNull()).select("reference_id")
    return (
        rows.select("reference_id", F.array_join(texts, "\n").alias("fact_text"))
        .filter(F.trim("fact_text") != "")
        .join(live, "reference_id", "left_semi")
    )


def needs_backfill(docs: DataFrame) -> DataFrame:
    """Documents without citation metadata, and PDFs without boundaries or metadata (column ``reason``)."""

    def blank(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""

    meta = docs.filter(F.col("citation_metadata").isNull() & F.col("content_text").isNotNull())
    pdf = docs.filter((F.col("doc_type") == "pdf") & (blank("page_boundaries") | blank("citation_metadata")))
    return meta.select("reference_id", F.lit("metadata").alias("reason")).unionByName(
        pdf.select("reference_id", F.lit("boundaries").alias("reason"))
    )


# ---- annotation responses ----


def to_annotations(good: DataFrame, doc: str) -> DataFrame:
    """Annotations of parsed responses with zipped references, slide before notes, then by y."""
    rows = good.select(doc, F.posexplode("response.annotations").alias("pos", "a"))
    has_list = F.col("a.refNumbers").isNotNull()
    nums = F.when(has_list, F.col("a.refNumbers")).when(F.col("a.refNumber") > 0, F.array("a.refNumber")).otherwise(
        F.array().cast("array<int>")
    )
    texts = (
        F.when(F.col("a.references").isNotNull(), F.col("a.references"))
        .when(F.coalesce("a.reference", F.lit("")) != "", F.array("a.reference"))
        .otherwise(F.array().cast("array<string>"))
    )
    out = rows.withColumn("ref_numbers", nums).withColumn("texts", texts)
    refs = F.transform(
        "texts",
        lambda t, i: F.struct(
            F.coalesce(F.nullif(F.get("ref_numbers", i), F.lit(0)), i + 1).alias("number"),
            F.trim(F.coalesce(t, F.lit(""))).alias("text"),
        ),
    )
    return _placed(out.withColumn("references", refs).drop("texts"), doc, "a", "ann-", 80)


def to_finds(good: DataFrame, doc: str) -> DataFrame:
    """Review finds of parsed responses."""
    rows = good.select(doc, F.posexplode("response.claims").alias("pos", "a"))
    return _placed(rows, doc, "a", "ai-find-", 60)


def _placed(rows: DataFrame, doc: str, a: str, prefix: str, default_confidence: int) -> DataFrame:
    number = F.col(f"{a}.confidence").try_cast("double")
    number = F.when(number.isNull() | (number == 0) | F.isnan(number), float(default_confidence)).otherwise(number)
    page = F.coalesce(F.nullif(leading_int(F.col(f"{a}.page")), F.lit(0)), F.lit(1))
    region = F.coalesce(F.nullif(F.col(f"{a}.region"), F.lit("")), F.lit("slide"))
    out = (
        rows.withColumn("id", F.concat(F.lit(prefix), (F.col("pos") + 1).cast("string")))
        .withColumn("text", F.trim(F.coalesce(F.col(f"{a}.text"), F.lit(""))))
        .withColumn("region", region)
        .withColumn("content_type", F.coalesce(F.nullif(F.col(f"{a}.contentType"), F.lit("")), F.lit("bullet")))
        .withColumn("confidence", F.least(F.lit(100), F.greatest(F.lit(0), _round(number))).cast("int"))
        .withColumn("page", F.greatest(F.lit(1), page))
        .withColumn("x", _clamped(F.col(f"{a}.x"), 0.0, 100.0, 0.0))
        .withColumn("y", _clamped(F.col(f"{a}.y"), 0.0, 100.0, 0.0))
        .drop(a)
    )
    order = Window.partitionBy(doc).orderBy(F.when(F.col("region") == "notes", 1).otherwise(0), "y", "pos")
    return out.withColumn("ord", F.row_number().over(order)).drop("pos")


def valid_positions(rows: DataFrame, n_candidates: Column, boundary: Column) -> DataFrame:
    """Position answers with a known index inside the slide area."""
    return rows.filter(
        F.col("index").between(1, n_candidates) & F.col("x").between(0, 100) & (F.col("y") >= 0) & (F.col("y") < boundary + 2)
    )


def valid_statements(rows: DataFrame, boundary: Column) -> DataFrame:
    """Statement answers: three characters, references 1..50, inside the slide area."""
    refs_ok = (F.size("ref_numbers") > 0) & F.forall("ref_numbers", lambda n: (n > 0) & (n <= 50))
    return rows.filter(
        (F.length("statement") >= 3) & refs_ok & F.col("x").between(0, 100) & (F.col("y") >= 0) & (F.col("y") < boundary + 2)
    )
