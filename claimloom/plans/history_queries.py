"""Versions, lineage, retention and export over the given tables (survey group V)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.operators import history as hs
from claimloom.plans import bindings as b
from claimloom.plans import ingest_queries as iq
from claimloom.plans.registry import fragment, query
from claimloom.plans.report_queries import SQL_LINE_ID, line_id


def s(c):
    return c.cast("string")


def long(name):
    return F.col(name).cast("long").alias(name)


def snapshots(spark, d):
    """Orders as snapshots of the customer's document."""
    t = b.table(spark, d, "orders")
    return t.select(
        F.col("o_custkey").alias("document_hash"), (F.col("o_custkey") % 5).alias("brand_id"), F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("payload"), F.col("o_orderpriority").alias("source"),
    )


def versions(spark, d):
    snaps = snapshots(spark, d)
    none = snaps.filter(F.lit(False)).select("document_hash", F.lit(0).alias("version_number"))
    return hs.number_versions(snaps, none, ["created_at", "snapshot_id"])


fragment(
    "versions",
    """SELECT o_custkey AS document_hash, o_custkey % 5 AS brand_id, o_orderkey AS snapshot_id, o_orderdate AS created_at,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number FROM orders""",
)


@query(
    "v01_number_versions",
    """SELECT o_orderkey AS snapshot_id, coalesce(top, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number
    FROM orders LEFT JOIN (SELECT c_custkey, c_custkey % 4 AS top FROM customer WHERE c_custkey % 4 > 0) ON o_custkey = c_custkey""",
)
def number_versions(spark, d):
    c = b.table(spark, d, "customer").filter(F.col("c_custkey") % 4 > 0)
    existing = c.select(F.col("c_custkey").alias("document_hash"), F.explode(F.sequence(F.lit(1), F.col("c_custkey") % 4)).alias("version_number"))
    out = hs.number_versions(snapshots(spark, d), existing, ["created_at", "snapshot_id"])
    return out.select("snapshot_id", long("version_number"))


@query(
    "v02_latest_version",
    "SELECT document_hash, snapshot_id, version_number FROM versions QUALIFY version_number = max(version_number) OVER (PARTITION BY document_hash)",
    ("versions",),
)
def latest_version(spark, d):
    return hs.latest_version(versions(spark, d)).select("document_hash", "snapshot_id", long("version_number"))


@query("v02_version_at", "SELECT document_hash, snapshot_id FROM versions WHERE version_number = 3", ("versions",))
def version_at(spark, d):
    return hs.version_at(versions(spark, d), 3).select("document_hash", "snapshot_id")


@query(
    "v03_latest_per_document",
    """SELECT brand_id, document_hash, snapshot_id FROM (SELECT *, snapshot_id % 3 AS b FROM versions) QUALIFY version_number = max(version_number) OVER (PARTITION BY b, document_hash)""".replace(
        "SELECT brand_id,", "SELECT b AS brand_id,"),
    ("versions",),
)
def latest_per_document(spark, d):
    v = versions(spark, d).withColumn("brand_id", F.col("snapshot_id") % 3)
    return hs.latest_per_document(v).select("brand_id", "document_hash", "snapshot_id")


def annotations(spark, d):
    """Order lines as annotations of a version: one per line number."""
    t = b.table(spark, d, "lineitem")
    pick = F.min_by(F.struct("l_quantity", "l_suppkey", "l_partkey"), line_id())
    g = t.groupBy("l_orderkey", "l_linenumber").agg(pick.alias("p"))
    refs = F.transform(F.sequence(F.lit(0), F.col("p.l_suppkey") % 3), lambda i: F.col("p.l_partkey") % 2 + i)
    v = versions(spark, d).select(F.col("snapshot_id").alias("l_orderkey"), "document_hash", "version_number")
    return g.join(v, "l_orderkey").select(
        "document_hash", "version_number", F.col("l_linenumber").alias("annotation_id"), F.floor(F.col("p.l_quantity") / 25).alias("x"),
        F.lit(0).alias("y"), refs.alias("refs"),
    )


fragment(
    "annotations",
    f"""SELECT document_hash, version_number, l_linenumber AS annotation_id, floor(l_quantity / 25)::BIGINT AS x,
      list_transform(range(0, l_suppkey % 3 + 1), i -> l_partkey % 2 + i) AS refs
    FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {SQL_LINE_ID}) = 1)
    JOIN versions ON snapshot_id = l_orderkey""",
    "versions",
)


@query(
    "v04_diff_versions",
    """SELECT document_hash, version_number, annotation_id, unnest(CASE WHEN o IS NULL THEN ['add_missed'] WHEN n IS NULL THEN ['delete'] ELSE list_filter([
        CASE WHEN o.x <> n.x THEN 'move' END, CASE WHEN len(n.refs) > len(o.refs) THEN 'ref_add' WHEN list_sort(n.refs) <> list_sort(o.refs) THEN 'ref_change' END], e -> e IS NOT NULL) END) AS edit_type
    FROM (SELECT coalesce(o.document_hash, n.document_hash) AS document_hash, coalesce(o.version_number + 1, n.version_number) AS version_number,
        coalesce(o.annotation_id, n.annotation_id) AS annotation_id, CASE WHEN o.document_hash IS NOT NULL THEN {'x': o.x, 'refs': o.refs} END AS o,
        CASE WHEN n.document_hash IS NOT NULL THEN {'x': n.x, 'refs': n.refs} END AS n
      FROM annotations o FULL JOIN annotations n ON o.document_hash = n.document_hash AND o.version_number + 1 = n.version_number AND o.annotation_id = n.annotation_id)""",
    ("annotations",),
)
def diff_versions(spark, d):
    a = annotations(spark, d)
    out = hs.diff_versions(a.withColumn("version_number", F.col("version_number") + 1), a, ["document_hash", "version_number"])
    return out.select("document_hash", long("version_number"), "annotation_id", "edit_type")


def edges(spark, d):
    """Every order descends from the customer's order before it; some edges are recorded twice."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = b.table(spark, d, "orders").withColumn("parent", F.lag("o_orderkey").over(w))
    e = t.select(
        F.col("o_orderkey").alias("document_hash"), F.col("parent").alias("parent_hash"), F.lit(0.9).alias("similarity_score"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("edge_id"), "o_custkey",
    )
    older = e.filter(F.col("o_custkey") % 3 == 0).withColumn("similarity_score", F.lit(0.5)).withColumn(
        "created_at", F.col("created_at") - F.expr("INTERVAL 1 DAY"))
    return e.unionByName(older).drop("o_custkey")


fragment(
    "chain",
    "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
)


@query(
    "v05_latest_edges",
    "SELECT c.o_orderkey AS document_hash, p.o_orderkey AS parent_hash, 0.9::DOUBLE AS similarity_score FROM chain c JOIN chain p ON c.o_custkey = p.o_custkey AND c.rn = p.rn + 1",
    ("chain",),
)
def latest_edges(spark, d):
    return hs.latest_edges(edges(spark, d))


@query(
    "v05_children",
    """SELECT p.o_orderkey AS parent_hash, c.o_orderkey AS document_hash, unnest(CASE WHEN c.o_custkey % 3 = 0 THEN [1, 2] ELSE [1] END)::BIGINT AS child_no
    FROM chain c JOIN chain p ON c.o_custkey = p.o_custkey AND c.rn = p.rn + 1""",
    ("chain",),
)
def children(spark, d):
    return hs.children(edges(spark, d)).withColumn("child_no", F.col("child_no").cast("long"))


@query(
    "v05_ancestors",
    "SELECT c.o_orderkey AS document_hash, p.o_orderkey AS ancestor, (c.rn - p.rn)::INT AS depth FROM chain c JOIN chain p ON c.o_custkey = p.o_custkey AND c.rn > p.rn",
    ("chain",),
)
def ancestors(spark, d):
    return hs.ancestors(edges(spark, d))


@query(
    "v05_by_brand",
    """SELECT c.o_custkey % 20 AS brand_id, c.o_orderkey AS document_hash, p.o_orderkey AS parent_hash, unnest(CASE WHEN c.o_custkey % 3 = 0 THEN [0.9, 0.5] ELSE [0.9] END)::DOUBLE AS similarity_score
    FROM chain c LEFT JOIN chain p ON c.o_custkey = p.o_custkey AND c.rn = p.rn + 1""",
    ("chain",),
)
def lineage_by_brand(spark, d):
    brands = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("document_hash"), (F.col("o_custkey") % 20).alias("brand_id"))
    return hs.lineage_by_brand(edges(spark, d).join(brands, "document_hash")).select("brand_id", "document_hash", "parent_hash", "similarity_score")


def page_pairs(spark, d):
    """Each document against the document before it that starts with the same 30 characters."""
    w = Window.partitionBy(F.substring("text", 1, 30)).orderBy("doc_id")
    t = b.table(spark, d, "documents").withColumn("old_doc", F.lag("doc_id").over(w))
    return t.filter("old_doc IS NOT NULL").select("old_doc", F.col("doc_id").alias("new_doc"))


fragment(
    "page_pairs",
    """SELECT old_doc, new_doc FROM (SELECT doc_id AS new_doc, lag(doc_id) OVER (PARTITION BY substring(text, 1, 30) ORDER BY doc_id) AS old_doc FROM documents)
    WHERE old_doc IS NOT NULL""",
)
fragment(
    "page_words",
    """SELECT doc_id, page, list_distinct(list_filter(regexp_split_to_array(lower(page_text), '\\s+'), w -> length(w) > 2)) AS words FROM doc_pages""",
    "doc_pages",
)
fragment(
    "page_matches",
    """SELECT old_doc, new_doc, new_page, similarity, CASE WHEN similarity > 0 THEN old_page END AS old_page FROM (
      SELECT old_doc, new_doc, n.page AS new_page, o.page AS old_page,
        coalesce(len(list_intersect(n.words, o.words))::DOUBLE / nullif(len(n.words) + len(o.words) - len(list_intersect(n.words, o.words)), 0), 0) AS similarity
      FROM page_pairs JOIN page_words n ON n.doc_id = new_doc JOIN page_words o ON o.doc_id = old_doc)
    QUALIFY row_number() OVER (PARTITION BY old_doc, new_doc, new_page ORDER BY similarity DESC, old_page) = 1""",
    "page_pairs", "page_words",
)


def page_matches(spark, d):
    return hs.compare_pages(page_pairs(spark, d), b.doc_pages(spark, d))


@query(
    "v06_compare_pages", "SELECT old_doc, new_doc, new_page, old_page, round(similarity, 6) AS similarity FROM page_matches", ("page_matches",)
)
def compare_pages(spark, d):
    return page_matches(spark, d).withColumn("similarity", F.round("similarity", 6))


@query(
    "v07_carry_forward",
    "SELECT m.old_doc, m.new_doc, m.new_page, s.line_no, true AS carried FROM page_matches m JOIN statements s ON s.doc_id = m.old_doc AND s.page = m.old_page WHERE similarity >= 0.85",
    ("page_matches", "statements"),
)
def carry_forward(spark, d):
    notes = b.statements(spark, d).select("doc_id", "page", "line_no")
    return hs.carry_forward(page_matches(spark, d), notes).select("old_doc", "new_doc", "new_page", "line_no", "carried")


@query(
    "v07_document_similarity",
    "SELECT old_doc, new_doc, round(avg(similarity), 6) AS similarity, count(*) AS pages FROM page_matches GROUP BY ALL", ("page_matches",),
)
def document_similarity(spark, d):
    return hs.document_similarity(page_matches(spark, d)).withColumn("similarity", F.round("similarity", 6))


def pattern_events(spark, d):
    t = b.table(spark, d, "events")
    delta = F.when(F.col("event_type").isin("purchase", "click"), 1).when(F.col("event_type") == "signup", 2).otherwise(-1)
    return t.select(
        (F.col("user_id") % 20).alias("brand_id"), F.lit("ref_association").alias("pattern_type"), F.col("user_id").alias("pattern"),
        delta.alias("delta"), "ts", "event_id",
    )


fragment(
    "strengths",
    """SELECT brand_id, pattern_type, pattern, s - least(0, low) AS strength, n_events FROM (
      SELECT user_id % 20 AS brand_id, 'ref_association' AS pattern_type, user_id AS pattern, sum(delta) AS s, min(p) AS low, count(*) AS n_events FROM (
        SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (
          SELECT *, CASE WHEN event_type IN ('purchase', 'click') THEN 1 WHEN event_type = 'signup' THEN 2 ELSE -1 END AS delta FROM events)) GROUP BY user_id)""",
)


def strengths(spark, d):
    return hs.pattern_strength(
        pattern_events(spark, d), ["brand_id", "pattern_type", "pattern"], ["ts", "event_id"], F.to_date("ts")
    )


@query("v08_pattern_strength", "SELECT brand_id, pattern, strength::BIGINT AS strength, n_events FROM strengths", ("strengths",))
def pattern_strength(spark, d):
    return strengths(spark, d).select("brand_id", "pattern", "strength", "n_events")


@query(
    "v09_patterns_for",
    """SELECT brand_id, pattern, row_number() OVER (PARTITION BY brand_id ORDER BY strength DESC, pattern_type, pattern) AS rank FROM strengths WHERE strength >= 2 QUALIFY rank <= 5""",
    ("strengths",),
)
def patterns_for(spark, d):
    return hs.patterns_for(strengths(spark, d), 2, 5).select("brand_id", "pattern", long("rank"))


@query("v09_patterns_of_type", "SELECT brand_id, pattern, strength::BIGINT AS strength FROM strengths WHERE strength > 0", ("strengths",))
def patterns_of_type(spark, d):
    return hs.patterns_of_type(strengths(spark, d), "ref_association").select("brand_id", "pattern", "strength")



@query(
    "v10_fingerprint",
    """SELECT brand, 'v1|' || sha256(brand) || '|' || count(*) || '-' || bit_xor(('0x' || substring(h, 1, 15))::BIGINT) || '-' || bit_xor(('0x' || substring(h, 16, 15))::BIGINT) AS cache_key
    FROM (SELECT brand, sha256(d.reference_id || ':' || coalesce(len(facts), 0) || ':' || coalesce(extraction_status, '')) AS h
      FROM library_docs d LEFT JOIN library_facts USING (reference_id) WHERE deleted_at IS NULL) GROUP BY brand""",
    ("library_docs", "library_facts"),
)
def fingerprint(spark, d):
    from claimloom.sources import ingest as ig

    refs = ig.library(iq.library_docs(spark, d), iq.library_facts(spark, d))
    f = hs.reference_fingerprint(refs, ["brand"])
    return f.select("brand", hs.cache_key(F.lit("v1"), F.sha2("brand", 256), F.col("fingerprint")).alias("cache_key"))


def stored_results(spark, d):
    """Parts as stored results; a third have expired, some never expire."""
    t = b.table(spark, d, "part")
    k = F.col("p_partkey")
    day = lambda n: F.date_add(F.lit("2024-03-01").cast("date"), n.cast("int")).cast("timestamp")
    return t.select(
        k.alias("id"), F.concat(F.lit("key-"), s(k)).alias("cache_key"), F.col("p_name").alias("payload"),
        day(k % 50).alias("written_at"), day(k % 41).alias("last_accessed_at"), F.when(k % 7 != 0, day(k % 60 - 20)).alias("expires_at"),
    )


NOW = "2024-03-01"
fragment(
    "stored",
    """SELECT p_partkey AS id, 'key-' || p_partkey AS cache_key, p_name AS payload, DATE '2024-03-01' + (p_partkey % 50)::INT AS written_at,
    DATE '2024-03-01' + (p_partkey % 41)::INT AS last_accessed_at, CASE WHEN p_partkey % 7 <> 0 THEN DATE '2024-03-01' + (p_partkey % 60 - 20)::INT END AS expires_at FROM part""",
)


@query(
    "v11_reuse_results",
    """SELECT l_orderkey, l_linenumber, s.id IS NOT NULL AS reused FROM lineitem LEFT JOIN (SELECT * FROM stored WHERE expires_at IS NULL OR expires_at > DATE '2024-03-01') s
      ON cache_key = 'key-' || l_partkey""",
    ("stored",),
)
def reuse_results(spark, d):
    t = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("key-"), s(F.col("l_partkey"))).alias("cache_key"),
                                             line_id().alias("input_id"))
    hits, rest = hs.reuse_results(t, stored_results(spark, d), F.lit(NOW).cast("timestamp"))
    keys = ["l_orderkey", "l_linenumber"]
    return hits.select(*keys, F.lit(True).alias("reused")).unionByName(rest.select(*keys, F.lit(False).alias("reused")))


@query(
    "v12_prune_results",
    "SELECT id FROM stored WHERE expires_at IS NULL OR expires_at > DATE '2024-03-01' ORDER BY last_accessed_at DESC, id DESC LIMIT 500", ("stored",),
)
def prune_results(spark, d):
    return hs.prune_results(stored_results(spark, d), F.lit(NOW).cast("timestamp")).select("id")


@query(
    "v13_merge_results",
    """SELECT cache_key, id, payload, strftime(expires_at, '%Y-%m-%d') AS expires_on FROM (
      SELECT cache_key, id, payload, expires_at, 0 AS n, written_at FROM stored
      UNION ALL SELECT 'key-' || (id + 5), id + 1000000, payload || ' again', written_at + 30, 1, written_at FROM stored WHERE id % 4 = 0
      UNION ALL SELECT 'key-' || (id + 5), id + 2000000, payload || ' late', written_at + 31, 1, written_at + 1 FROM stored WHERE id % 8 = 0)
    QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY n DESC, written_at DESC, id DESC) = 1""",
    ("stored",),
)
def merge_results(spark, d):
    base = stored_results(spark, d)
    again = base.withColumn("cache_key", F.concat(F.lit("key-"), s(F.col("id") + 5))).drop("expires_at")
    first = again.filter("id % 4 = 0").withColumn("payload", F.concat("payload", F.lit(" again"))).withColumn("id", F.col("id") + 1000000)
    late = again.filter("id % 8 = 0").withColumn("payload", F.concat("payload", F.lit(" late"))).withColumn("id", F.col("id") + 2000000)
    late = late.withColumn("written_at", F.col("written_at") + F.expr("INTERVAL 1 DAY"))
    out = hs.merge_results(base, first.unionByName(late))
    return out.select("cache_key", "id", "payload", F.date_format("expires_at", "yyyy-MM-dd").alias("expires_on"))


@query(
    "v14_library_changes",
    """WITH c AS (SELECT event_id AS seq, event_id % (SELECT count(*) FROM documents) AS reference_id, user_id % 9 AS folder_id, (ts::DATE) AS at,
        CASE event_type WHEN 'click' THEN 'delete' WHEN 'view' THEN 'restore' WHEN 'signup' THEN 'move' WHEN 'error' THEN 'move' ELSE CASE WHEN event_id % 5 = 0 THEN 'purge' ELSE 'delete' END END AS op FROM events)
    SELECT reference_id, strftime(CASE WHEN t.op IS NULL THEN d.deleted_at WHEN t.op = 'delete' THEN t.at END, '%Y-%m-%d') AS deleted_on,
      CASE WHEN p.op IS NULL THEN d.folder_id WHEN p.op = 'move' THEN p.folder_id END AS folder_id
    FROM library_docs d
    LEFT JOIN (SELECT * FROM c WHERE op IN ('delete', 'restore') QUALIFY row_number() OVER (PARTITION BY reference_id ORDER BY seq DESC) = 1) t USING (reference_id)
    LEFT JOIN (SELECT * FROM c WHERE op IN ('move', 'restore') QUALIFY row_number() OVER (PARTITION BY reference_id ORDER BY seq DESC) = 1) p USING (reference_id)
    WHERE reference_id NOT IN (SELECT reference_id FROM c WHERE op = 'purge')""",
    ("library_docs",),
)
def library_changes(spark, d):
    n = b.table(spark, d, "documents").agg(F.count("*")).scalar()
    e = F.col("event_type")
    op = (
        F.when(e == "click", "delete").when(e == "view", "restore").when(e.isin("signup", "error"), "move")
        .when(F.col("event_id") % 5 == 0, "purge").otherwise("delete")
    )
    c = b.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % n).alias("reference_id"), (F.col("user_id") % 9).alias("folder_id"),
        F.to_date("ts").alias("at"), op.alias("op"),
    )
    out = hs.apply_library_changes(iq.library_docs(spark, d), c)
    return out.select("reference_id", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted_on"), "folder_id")


@query(
    "v15_active_sessions",
    "SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 20 <> 3",
)
def active_sessions(spark, d):
    cleared = hs.clear_sessions(iq.sessions(spark, d), 3, F.lit("2024-03-01"))
    return hs.active_sessions(cleared).select("session_id")


@query(
    "v16_export_rows",
    f"""WITH c AS (SELECT o_orderkey AS claim_id, o_orderkey % 9 AS page, CASE WHEN o_orderkey % 6 > 0 THEN (o_custkey % 100)::DOUBLE END AS x,
        CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 101)::DOUBLE END AS y, o_orderkey % 10 = 0 AS spot, o_orderpriority AS text FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT l_orderkey AS claim_id, {SQL_LINE_ID} AS pos, l_partkey AS reference_id, l_linenumber AS number,
        CASE WHEN l_partkey % 3 = 0 THEN ' loc  ' || (l_partkey % 50) END AS locator, CASE WHEN l_partkey % 4 > 0 THEN 'Cite ' || (l_suppkey % 9) END AS cite,
        count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    e AS (SELECT DISTINCT l_orderkey AS claim_id, l_partkey AS reference_id, unnest(['/p' || l_linenumber, '/P' || l_linenumber || '/col1', '/P' || l_linenumber]) AS line,
        unnest([{SQL_LINE_ID} * 4, {SQL_LINE_ID} * 4 + 1, {SQL_LINE_ID} * 4 + 2]) AS seq FROM lineitem WHERE l_returnflag = 'R'),
    ef AS (SELECT claim_id, reference_id, lower(line) AS k, min(seq) AS seq, arg_min(line, {{'s': seq, 'l': line}}) AS line FROM e GROUP BY ALL),
    l AS (SELECT r.claim_id, pos, n, number, ef.seq, ef.line FROM r JOIN ef USING (claim_id, reference_id)
      UNION ALL SELECT claim_id, pos, n, number, 0, coalesce(trim(regexp_replace(locator, '\\s+', ' ', 'g')), cite) FROM r
        WHERE coalesce(locator, cite) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ef WHERE ef.claim_id = r.claim_id AND ef.reference_id = r.reference_id)),
    nl AS (SELECT claim_id, pos, seq, CASE WHEN n > 1 AND row_number() OVER (PARTITION BY claim_id, pos ORDER BY seq) = 1 THEN number || '. ' || line ELSE line END AS line FROM l),
    u AS (SELECT claim_id, lower(line) AS k, arg_min(line, {{'p': pos, 's': seq, 'l': line}}) AS line, min({{'p': pos, 's': seq, 'l': line}}) AS o FROM nl GROUP BY ALL)
    SELECT claim_id, greatest(1, page) AS page, spot AS global_spot, CASE WHEN spot OR x IS NULL OR x >= 50 THEN 'right' ELSE 'left' END AS target_side,
      CASE WHEN y IS NOT NULL THEN greatest(2, least(98, y)) WHEN spot THEN 15 ELSE 50 END::DOUBLE AS target_y_pct, text AS claim_text,
      row_number() OVER (PARTITION BY claim_id ORDER BY o.p, o.s, k) AS line_no, line AS notation_line
    FROM c JOIN u USING (claim_id)""",
)
def export_rows(spark, d):
    k = F.col("o_orderkey")
    c = b.table(spark, d, "orders").select(
        k.alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"), (k % 9).alias("page"),
        F.when(k % 6 > 0, (F.col("o_custkey") % 100).cast("double")).alias("x"), F.when(k % 7 > 0, (k % 101).cast("double")).alias("y"),
        (k % 10 == 0).alias("global_spot"), F.col("o_orderpriority").alias("text"),
    )
    t = b.table(spark, d, "lineitem")
    p = F.col("l_partkey")
    r = t.select(
        F.col("l_orderkey").alias("claim_id"), line_id().alias("pos"), p.alias("reference_id"), F.col("l_linenumber").alias("number"),
        F.when(p % 3 == 0, F.concat(F.lit(" loc  "), s(p % 50))).alias("locator"),
        F.when(p % 4 > 0, F.concat(F.lit("Cite "), s(F.col("l_suppkey") % 9))).alias("citation_text"),
    )
    n = s(F.col("l_linenumber"))
    places = F.array(F.concat(F.lit("/p"), n), F.concat(F.lit("/P"), n, F.lit("/col1")), F.concat(F.lit("/P"), n))
    e = t.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("claim_id"), p.alias("reference_id"), line_id().alias("lid"),
        F.posexplode(places).alias("i", "location_annotation"),
    ).withColumn("seq", F.col("lid") * 4 + F.col("i"))
    return hs.export_rows(c, r, e).withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "v17_carry_status",
    """WITH saved AS (SELECT conv_id % 30 AS doc, (turn % 2)::INT AS page, substring(text, 1, 60) AS k, arg_max(CASE turn % 3 WHEN 1 THEN 'approved' ELSE 'rejected' END, conv_id * 1000 + turn) AS st
        FROM conversations WHERE turn % 3 > 0 GROUP BY ALL)
    SELECT conv_id, turn, coalesce(st, 'pending') AS status FROM conversations LEFT JOIN saved ON doc = conv_id % 30 AND page = turn % 2 AND k = substring(text, 1, 60)""",
)
def carry_status(spark, d):
    t = b.table(spark, d, "conversations")
    base = t.select("conv_id", "turn", (F.col("conv_id") % 30).alias("document_hash"), (F.col("turn") % 2).alias("page"), "text",
                    (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    saved = base.withColumn("status", F.when(F.col("turn") % 3 == 1, "approved").when(F.col("turn") % 3 == 2, "rejected").otherwise("pending"))
    return hs.carry_status(base.withColumn("status", F.lit("pending")), saved).select("conv_id", "turn", "status")


@query(
    "v18_merge_matches",
    """SELECT event_id AS claim_id, CASE WHEN event_id % 3 = 0 THEN 'tier-b' ELSE 'tier-a' END AS match_tier, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS match_confidence, user_id FROM events""",
)
def merge_matches(spark, d):
    t = b.table(spark, d, "events")
    def fields(tier, conf):
        return [F.lit(True).alias("matched"), F.lit(conf).alias("match_confidence"), F.lit(tier).alias("match_tier"),
                F.col("user_id").alias("reference_id"), F.lit("r").alias("match_reasoning")]
    claims = t.select(F.col("event_id").alias("claim_id"), "user_id", *fields("tier-a", 0.25))
    found = t.filter("event_id % 3 = 0").select(F.col("event_id").alias("claim_id"), *fields("tier-b", 0.5))
    return hs.merge_matches(claims, found).select("claim_id", "match_tier", "match_confidence", "user_id")
