"""On-page citations over the given tables (survey group A).

Every ten lines of a document are a slide page: lines 0 to 5 on the slide, 6 to 9 in the notes; every third line
carries a superscript; small print lists four footnotes, the notes list three references.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import onpage as op
from claimloom.operators import passages as ps
from claimloom.plans import bindings as b
from claimloom.plans.registry import fragment, query

RULES = (("dose", "5 mg dose"), ("relapse", "relapse by"), ("endpoint", "primary endpoint"))
CANONICAL = {"dose": "Adverse events at 5 mg", "relapse": "Relapse was reduced", "endpoint": "Primary endpoint met"}


def s(c):
    return c.cast("string")


def line_page():
    return (F.floor(F.col("line_no") / 10) + 1).cast("int").alias("page")


def spans(spark, d, sup_x=60.0):
    """Spans of the pages; ``sup_x`` is where superscripts stand, right of the lines that begin at 5."""
    t = b.lines(spark, d)
    k = F.col("line_no") % 10
    y = F.when(k < 6, k * 5.0 + 2).otherwise(k * 5.0 + 22)  # 2..27 on the slide, 52..67 in the notes
    base = t.select("doc_id", "line_no", line_page(), (k * 4).alias("pos"), F.col("line").alias("text"), F.lit(5.0).alias("x"), y.alias("y"), F.lit(12.0).alias("size"),
                    F.lit(False).alias("is_superscript"), F.col("line_no").alias("block_id"))
    number = s((F.col("doc_id") + F.col("line_no")) % 6 + 1)
    sup = t.filter("line_no % 3 = 0").select("doc_id", "line_no", line_page(), (k * 4 + 1).alias("pos"), number.alias("text"), F.lit(sup_x).alias("x"), (y - 0.3).alias("y"), F.lit(6.0).alias("size"),
                                             F.lit(True).alias("is_superscript"), F.col("line_no").alias("block_id"))
    pages = t.select("doc_id", line_page()).distinct()

    def fixed(pos, text, y, size, x=5.0):
        return F.struct(F.lit(pos).alias("pos"), text.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(size).alias("size"))

    def ref(n):
        return F.concat(F.lit(f"{n}. Roe AB et al. Brain {n}x"), s(F.col("doc_id")), F.lit("."))

    extra = F.array(
        *[fixed(50 + n, ref(n), 38.0 + n, 5.5) for n in (1, 2, 3, 4)], fixed(60, F.lit("Speaker notes"), 48.0, 12.0), fixed(70, F.lit("References"), 76.0, 12.0),
        fixed(71, ref(1), 78.0, 12.0), fixed(72, F.lit("continued text"), 80.0, 12.0), fixed(73, ref(2), 82.0, 12.0), fixed(74, ref(5), 84.0, 12.0))
    more = pages.select("doc_id", "page", F.explode(extra).alias("e")).select(
        "doc_id", F.lit(0).alias("line_no"), "page", "e.pos", "e.text", "e.x", "e.y", "e.size", F.lit(False).alias("is_superscript"), (F.lit(-1) - F.col("e.pos")).alias("block_id"))
    every = base.unionByName(sup).unionByName(more)
    return every.select(F.col("doc_id").alias("doc"), "page", F.col("pos").alias("span_no"), "text", "x", "y", "size", "is_superscript", "block_id")


def bounds(spark, d):
    return ps.notes_boundary(spans(spark, d), ["doc", "page"])


def deck(spark, d):
    return op.read_deck(spans(spark, d))


fragment(
    "sup_rows",
    """SELECT doc_id AS doc, (line_no // 10 + 1)::INT AS page, (line_no % 10 * 4 + 1)::INT AS sup_no, ((doc_id + line_no) % 6 + 1)::INT AS n, CASE WHEN line_no % 10 < 6 THEN 'slide' ELSE 'notes' END AS region, line
    FROM lines WHERE line_no % 3 = 0""",
    "lines",
)
fragment("sup_claims_raw", "SELECT * FROM sup_rows WHERE length(line) >= 5 AND NOT regexp_matches(line, '^([•\\-–—]\\s*|\\d{1,2}\\.\\s*)$')", "sup_rows")
fragment(
    "sup_claims", "SELECT doc, page, region, line AS text, list_sort(list(DISTINCT n)) AS numbers, min(sup_no) AS claim_no FROM sup_claims_raw GROUP BY ALL", "sup_claims_raw",
)
fragment(
    "resolved",
    """SELECT doc, page, region, claim_no, n AS ref_no, CASE WHEN region = 'slide' AND n <= 4 OR region = 'notes' AND n IN (1, 2, 5) THEN 1 END AS hit FROM (SELECT doc, page, region, claim_no, unnest(numbers) AS n FROM sup_claims)""",
    "sup_claims",
)
fragment("deck_pages", "SELECT DISTINCT doc_id AS doc, (line_no // 10 + 1)::INT AS page FROM lines", "lines")
fragment(
    "pool",
    """SELECT doc, page, 'slide' AS region, n::INT AS ref_no, 'Roe AB et al. Brain ' || n || 'x' || doc || '.' AS citation_text FROM deck_pages, unnest([1, 2, 3, 4]) u(n)
    UNION ALL SELECT doc, page, 'notes', n::INT, 'Roe AB et al. Brain ' || n || 'x' || doc || '.' || CASE WHEN n = 1 THEN ' continued text' ELSE '' END FROM deck_pages, unnest([1, 2, 5]) u(n)""",
    "deck_pages",
)


def resolved(spark, d):
    return deck(spark, d)["resolved"]


@query("a01_sup_spans", "SELECT doc, page, sup_no, n::VARCHAR AS numbers, region FROM sup_rows", ("sup_rows",))
def sup_spans(spark, d):
    out = op.sup_spans(spans(spark, d), bounds(spark, d))
    return out.select("doc", "page", "sup_no", F.array_join("numbers", ",").alias("numbers"), "region")


@query("a02_sup_parent", "SELECT doc, page, sup_no, line AS text FROM sup_claims_raw", ("sup_claims_raw",))
def sup_parent(spark, d):
    sp, bd = spans(spark, d), bounds(spark, d)
    return op.sup_parent(sp, op.sup_spans(sp, bd), bd).select("doc", "page", "sup_no", "text")


@query("a03_associate_sups", "SELECT doc, page, sup_no, n::VARCHAR AS numbers FROM sup_claims_raw WHERE NOT regexp_matches(line, '10\\s*$')", ("sup_claims_raw",))
def associate_sups(spark, d):
    # superscripts next to their line, near enough to make its 10 a power of ten
    sp, bd = spans(spark, d, 15.0), bounds(spark, d)
    return op.associate_sups(op.sup_parent(sp, op.sup_spans(sp, bd), bd)).select("doc", "page", "sup_no", F.array_join("numbers", ",").alias("numbers"))


@query("a04_merge_sup_claims", "SELECT doc, page, region, text, array_to_string(numbers, ',') AS numbers, claim_no FROM sup_claims", ("sup_claims",))
def merge_sup_claims(spark, d):
    return deck(spark, d)["claims"].select("doc", "page", "region", "text", F.array_join("numbers", ",").alias("numbers"), "claim_no")


@query("a05_footnote_pool", "SELECT doc, page, ref_no, citation_text FROM pool WHERE region = 'slide'", ("pool",))
def footnote_pool(spark, d):
    return op.footnote_pool(spans(spark, d), bounds(spark, d)).select("doc", "page", "ref_no", "citation_text")


@query("a06_notes_pool", "SELECT doc, page, ref_no, citation_text FROM pool WHERE region = 'notes'", ("pool",))
def notes_pool(spark, d):
    return op.notes_pool(spans(spark, d), bounds(spark, d)).select("doc", "page", "ref_no", "citation_text")


@query("a07_resolve_refs", "SELECT doc, page, region, claim_no, ref_no, hit IS NOT NULL AS resolved FROM resolved", ("resolved",))
def resolve_refs(spark, d):
    return resolved(spark, d).select("doc", "page", "region", "claim_no", "ref_no", F.col("citation_text").isNotNull().alias("resolved"))


@query("a08_unresolved_refs", "SELECT doc, page, region, claim_no, ref_no FROM resolved WHERE hit IS NULL", ("resolved",))
def unresolved_refs(spark, d):
    return op.unresolved_refs(resolved(spark, d)).select("doc", "page", "region", "claim_no", "ref_no")


fragment(
    "orphans", "SELECT doc, page, region, ref_no FROM pool WHERE (doc, page, region, ref_no) NOT IN (SELECT doc, page, region, ref_no FROM resolved WHERE hit = 1)", "pool", "resolved",
)


@query("a09_orphan_refs", "SELECT * FROM orphans", ("orphans",))
def orphan_refs(spark, d):
    k = deck(spark, d)
    return op.orphan_refs(k["pool"], k["resolved"]).select("doc", "page", "region", "ref_no")


def visuals(spark, d):
    p = b.lines(spark, d).select(F.col("doc_id").alias("doc"), line_page()).distinct()

    def box(n, x0, y0, x1, y1):
        return F.struct(F.lit(n).alias("rect_no"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x1).alias("x1"), F.lit(y1).alias("y1"))

    made = F.when(F.col("doc") % 3 == 0, F.array(box(1, 1.0, 6.0, 40.0, 14.0), box(2, 1.0, 18.0, 40.0, 24.0), box(3, 0.0, 5.0, 60.0, 30.0))).when(F.col("doc") % 3 == 1, F.array(box(1, 1.0, 6.0, 40.0, 14.0)))
    return p.select("doc", "page", F.explode(made).alias("r")).select("doc", "page", "r.*")


def elements(spark, d, k):
    return op.content_elements(k["spans"], k["bounds"], visuals(spark, d), k["pool"])


@query("a11_content_elements")
def content_elements(spark, d):
    return elements(spark, d, deck(spark, d)).select("doc", "page", "element_no", "text", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "kind")


def globals_(spark, d, k):
    return op.global_annotations(op.orphan_refs(k["pool"], k["resolved"]), elements(spark, d, k), k["bounds"])


@query("a10_global_annotations")
def global_annotations(spark, d):
    return globals_(spark, d, deck(spark, d)).select("doc", "page", "region", F.array_join("numbers", ",").alias("numbers"), "element_no", "text", "reason")


@query("a12_match_segments")
def match_segments(spark, d):
    t = b.lines(spark, d)
    lines = t.select(F.col("doc_id").alias("doc"), line_page(), "line_no", F.col("line").alias("text"), F.floor(F.col("line_no") / 3).alias("block_id"), F.lit(5.0).alias("x"), F.col("line_no").cast("double").alias("y"))
    segs = t.select(F.col("doc_id").alias("doc"), line_page(), F.col("line_no").alias("seg_no"), F.concat(F.lit("Overall "), "line").alias("text"))
    return op.match_segments(segs, lines).drop("x", "y")


def statement_rows(spark, d):
    t = b.statements(spark, d)
    return t.select(F.col("doc_id").alias("doc"), "page", F.col("line_no").alias("ord"), F.col("stmt").alias("text"), (F.col("line_no") % 7 / 7.0).alias("confidence"),
                    F.array((F.col("line_no") % 5).cast("int")).alias("numbers"))


def promoted(spark, d):
    rows = statement_rows(spark, d)
    out = op.promote_claims(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1"), RULES)
    return out


_KIND = "CASE WHEN contains(lower(stmt), '5 mg dose') THEN 'dose' WHEN contains(lower(stmt), 'relapse by') THEN 'relapse' WHEN contains(lower(stmt), 'primary endpoint') THEN 'endpoint' END"


@query("a13_annotations")
def annotations(spark, d):
    p = promoted(spark, d).select("doc", "page", F.col("ord").alias("idx"), "text", "numbers", (F.col("ord") % 4 == 0).alias("has_evidence"))
    k = deck(spark, d)
    return op.annotations(k["claims"], k["resolved"], p, globals_(spark, d, k))


@query(
    "a14_canonical_globals",
    f"""SELECT doc_id AS doc, page, line_no AS ord, kind, CASE kind WHEN 'dose' THEN 'Adverse events at 5 mg' WHEN 'relapse' THEN 'Relapse was reduced' WHEN 'endpoint' THEN 'Primary endpoint met' ELSE stmt END AS text
    FROM (SELECT *, {_KIND} AS kind FROM statements) QUALIFY kind IS NULL OR row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY line_no % 7 DESC, line_no) = 1""",
    ("statements",),
)
def canonical_globals(spark, d):
    rows = statement_rows(spark, d).withColumn("score", F.col("confidence"))
    return op.canonical_globals(rows, RULES, CANONICAL).select("doc", "page", "ord", "kind", "text")


@query(
    "a15_merge_halves",
    f"""WITH k AS (SELECT doc_id AS doc, page, line_no AS ord, {_KIND} AS kind, line_no % 7 AS c, line_no % 5 AS n FROM statements),
    p AS (SELECT doc, page, bool_or(kind = 'endpoint') AS w, min(ord) FILTER (WHERE kind = 'dose') AS a, min(ord) FILTER (WHERE kind = 'relapse') AS b FROM k GROUP BY doc, page)
    SELECT doc, page, ord, kind, n::VARCHAR AS numbers FROM k JOIN p USING (doc, page) WHERE NOT (coalesce(w, false) AND coalesce(kind IN ('dose', 'relapse'), false)) AND NOT (NOT coalesce(w, false) AND a IS NOT NULL AND b IS NOT NULL AND ord IN (a, b))
    UNION ALL SELECT doc, page, min(ord), 'endpoint', array_to_string(list_sort(list(DISTINCT n)), ',') FROM k JOIN p USING (doc, page) WHERE NOT coalesce(w, false) AND a IS NOT NULL AND b IS NOT NULL AND ord IN (a, b) GROUP BY doc, page""",
    ("statements",),
)
def merge_halves(spark, d):
    rows = statement_rows(spark, d).withColumn("kind", op.kind_of(F.col("text"), RULES)).select("doc", "page", "ord", "kind", "text", "confidence", "numbers")
    out = op.merge_halves(rows, "endpoint", ("dose", "relapse"), "Both halves")
    return out.select("doc", "page", "ord", "kind", F.array_join("numbers", ",").alias("numbers"))


@query("a16_promote_claims")
def promote_claims(spark, d):
    return promoted(spark, d).select("doc", "page", "ord", "kind", "text")


fragment(
    "audit",
    """SELECT doc, page, coalesce(superscripts, 0) AS superscripts, coalesce(r, 0) AS resolved, coalesce(unmatched, 0) AS unmatched FROM (SELECT doc, page, count(*) AS superscripts, count(hit) AS r FROM resolved GROUP BY ALL)
    FULL JOIN (SELECT doc, page, count(*) FILTER (WHERE n = 0) AS unmatched FROM (SELECT doc, page, region, claim_no, count(hit) AS n FROM resolved GROUP BY ALL) GROUP BY ALL) USING (doc, page)""",
    "resolved",
)


def page_audit(spark, d):
    k = deck(spark, d)
    return op.audit_pages(k["resolved"], shown_rows(k))


def shown_rows(k):
    c, r = k["claims"], k["resolved"]
    none_p = c.select("doc", "page", F.lit(0).alias("idx"), "text", "numbers", F.lit(True).alias("has_evidence")).filter(F.lit(False))
    none_g = c.select("doc", "page", "region", "numbers", F.lit(0).alias("element_no"), "text", "x", "y", F.lit("").alias("reason")).filter(F.lit(False))
    return op.annotations(c, r, none_p, none_g)


@query("a17_audit_pages", "SELECT *, superscripts - resolved AS unresolved, superscripts = resolved AND unmatched = 0 AS passed FROM audit", ("audit",))
def audit_pages(spark, d):
    return page_audit(spark, d)


@query(
    "a17_audit_gaps",
    """WITH n AS (SELECT *, count(hit) OVER (PARTITION BY doc, page, region, claim_no) AS hits FROM resolved)
    SELECT doc, page, CASE WHEN hits > 0 THEN 'partial-resolution' ELSE 'unresolved' END AS kind, region, count(*) AS gaps FROM n WHERE hit IS NULL GROUP BY ALL
    UNION ALL SELECT doc, page, 'unmatched', region, count(*) FROM (SELECT DISTINCT doc, page, region, claim_no FROM n WHERE hits = 0) GROUP BY ALL""",
    ("resolved",),
)
def audit_gaps(spark, d):
    k = deck(spark, d)
    gaps = op.audit_gaps(k["claims"], k["resolved"], shown_rows(k))
    return gaps.groupBy("doc", "page", "kind", "region").agg(F.count("text").alias("gaps"))


@query(
    "a18_audit_document",
    """SELECT doc, count(*) AS pages, count(*) FILTER (WHERE superscripts = resolved AND unmatched = 0) AS passed, count(*) FILTER (WHERE NOT (superscripts = resolved AND unmatched = 0)) AS failed,
      sum(superscripts - resolved + unmatched)::BIGINT AS gaps, round(CASE WHEN sum(superscripts) > 0 THEN sum(resolved) / sum(superscripts) ELSE 1 END, 6)::DOUBLE AS resolution_rate FROM audit GROUP BY doc""",
    ("audit",),
)
def audit_document(spark, d):
    return op.audit_document(page_audit(spark, d))


@query(
    "a19_lines_with_refs",
    "SELECT doc_id AS doc, (line_no // 10 + 1)::INT AS page, line_no, CASE WHEN line_no % 3 = 0 THEN ((doc_id + line_no) % 6 + 1)::VARCHAR ELSE '' END AS refs FROM lines WHERE NOT regexp_matches(line, '[\\d,\\s]+$')", ("lines",),
)
def lines_with_refs(spark, d):
    t = b.lines(spark, d).filter(~F.col("line").rlike(r"[\d,\s]+$"))
    y = (F.col("line_no") % 10 * 8 + 5).cast("double")
    lines = t.select(F.col("doc_id").alias("doc"), line_page(), "line_no", F.col("line").alias("text"), F.lit(5.0).alias("x"), y.alias("y"), F.lit(60.0).alias("max_x"), (y + 2).alias("max_y"))
    big = t.select(F.col("doc_id").alias("doc"), line_page(), (F.col("line_no") * 2).alias("token_no"), F.lit("word").alias("text"), F.lit(5.0).alias("x"), y.alias("y"), F.lit(2.0).alias("height"))
    small = t.filter("line_no % 3 = 0").select(F.col("doc_id").alias("doc"), line_page(), (F.col("line_no") * 2 + 1).alias("token_no"), s((F.col("doc_id") + F.col("line_no")) % 6 + 1).alias("text"), F.lit(62.0).alias("x"),
                                               (y - 0.5).alias("y"), F.lit(1.0).alias("height"))
    # two words per line, so that full-size tokens are the majority on every page
    out = op.lines_with_refs(lines, big.unionByName(big).unionByName(small))
    return out.select("doc", "page", "line_no", F.array_join("refs", ",").alias("refs"))
