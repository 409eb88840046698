"""Evidence regions over the given tables (survey group E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import evidence as ev
from claimloom.plans import bindings as b
from claimloom.plans.registry import fragment, query
from claimloom.plans.report_queries import SQL_LINE_ID, line_id
from claimloom.plans.text_queries import sql_terms_numeric, sql_terms_tokens


def s(c):
    return c.cast("string")


def long(name):
    return F.col(name).cast("long").alias(name)


def blocks(spark, d):
    """Statements as blocks of a two-column page, every ninth an image, every eleventh a caption."""
    t = b.statements(spark, d)
    k = F.col("doc_id") + F.col("line_no")
    left = F.col("line_no") % 2 == 0
    x0 = F.when(F.col("doc_id") % 4 == 0, 50.0).when(left, 50.0).otherwise(330.0)
    y0 = F.floor(F.col("line_no") % 10 / 2) * 130.0 + 80
    text = F.when(k % 11 == 0, F.concat(F.lit("Figure "), s(k % 9 + 1), F.lit(". "), "stmt")).otherwise(F.col("stmt"))
    return t.select(
        F.col("doc_id").alias("doc"), "page", F.col("line_no").alias("block_no"), x0.alias("x0"), y0.alias("y0"),
        F.when(F.col("doc_id") % 4 == 0, 560.0).otherwise(x0 + 230).alias("x1"), (y0 + 100 + F.col("line_no") % 3).alias("y1"), text.alias("text"),
        (k % 9 == 0).alias("is_image"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), F.lit(10.0).alias("size"),
    )


fragment(
    "blocks_e",
    """SELECT doc_id AS doc, page, line_no AS block_no, x0, y0, CASE WHEN doc_id % 4 = 0 THEN 560.0 ELSE x0 + 230 END::DOUBLE AS x1, (y0 + 100 + line_no % 3)::DOUBLE AS y1, text, is_image FROM (
      SELECT *, CASE WHEN doc_id % 4 = 0 OR line_no % 2 = 0 THEN 50.0 ELSE 330.0 END::DOUBLE AS x0, (line_no % 10 // 2 * 130.0 + 80)::DOUBLE AS y0,
        CASE WHEN (doc_id + line_no) % 11 = 0 THEN 'Figure ' || ((doc_id + line_no) % 9 + 1) || '. ' || stmt ELSE stmt END AS text, (doc_id + line_no) % 9 = 0 AS is_image FROM statements)""",
    "statements",
)


def pairs(spark, d):
    """Each document with a claim: its own first statement reworded."""
    t = b.statements(spark, d)
    g = t.groupBy("doc_id").agg(F.min_by("stmt", "line_no").alias("stmt"))
    return g.select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("doc"), F.concat(F.lit("Relapse fell by 12% (p<0.04): "), "stmt").alias("claim_text"))


fragment(
    "pairs_e",
    """SELECT doc_id AS pair_id, doc_id AS doc, 'Relapse fell by 12% (p<0.04): ' || arg_min(stmt, line_no) AS claim_text FROM statements GROUP BY doc_id""",
    "statements",
)


def _share(needles, text):
    return f"coalesce(len(list_filter({needles}, n -> contains({text}, n)))::DOUBLE / nullif(len({needles}), 0), 0)"


def _score(text):
    return f"round(CASE WHEN {text} = '' THEN 0 ELSE {_share('toks', text)} * 0.65::DOUBLE + {_share('nums', text)} * 0.35::DOUBLE END, 9)"


fragment(
    "terms_e", f"SELECT *, {sql_terms_tokens('claim_text')} AS toks, {sql_terms_numeric('claim_text')} AS nums FROM pairs_e", "pairs_e",
)
fragment("page_text_e", "SELECT doc_id AS doc, page, string_agg(stmt, chr(10) ORDER BY line_no) AS page_text FROM statements GROUP BY ALL", "statements")
fragment(
    "page_scores_e",
    f"SELECT pair_id, page, {_score('t')} AS page_score FROM (SELECT *, trim(regexp_replace(lower(page_text), '\\s+', ' ', 'g')) AS t FROM terms_e JOIN page_text_e USING (doc))",
    "terms_e", "page_text_e",
)


def page_texts(spark, d):
    """One group is one page."""
    g = b.statements(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "stmt"))).alias("l"))
    return g.select(F.col("doc_id").alias("doc"), "page", F.array_join(F.transform("l", lambda x: x["stmt"]), "\n").alias("page_text"), F.lit(1).alias("seq"))


def candidates(spark, d):
    t = blocks(spark, d)
    return t.select(
        F.col("doc").alias("pair_id"), F.col("block_no").alias("candidate_no"), "page",
        F.when(F.col("block_no") % 3 == 0, "table").otherwise("text").alias("kind"), "text", F.concat_ws(",", s(F.col("x0")), s(F.col("y0"))).alias("rect_key"),
        F.when(F.col("block_no") % 4 > 0, F.col("block_no") % 7 / 10.0).alias("pre_score"),
    )


@query("e01_overlap_score", f"SELECT pair_id, line_no, {_score('lower(stmt)')} AS score FROM terms_e JOIN statements ON doc_id = doc", ("terms_e", "statements"))
def overlap_score(spark, d):
    p = pairs(spark, d).select("pair_id", tx.claim_terms(F.col("claim_text")).alias("terms"))
    j = p.join(b.statements(spark, d).withColumnRenamed("doc_id", "pair_id"), "pair_id")
    return j.select("pair_id", "line_no", F.round(ev.overlap_score(F.col("terms"), F.col("stmt")), 9).alias("score"))


@query("e02_page_scores", "SELECT * FROM page_scores_e", ("page_scores_e",))
def page_scores(spark, d):
    return ev.page_scores(pairs(spark, d), page_texts(spark, d))


fragment(
    "ranked_e",
    f"""SELECT *, round(greatest(0, least(1, coalesce(pre, own) * 0.55::DOUBLE + own * 0.25::DOUBLE + page_score * 0.20::DOUBLE + CASE WHEN len(nums) > 0 AND kind = 'table' THEN 0.08::DOUBLE ELSE 0 END)), 9) AS score FROM (
      SELECT p.pair_id, block_no AS candidate_no, k.page, text, x0, y0, nums, CASE WHEN block_no % 3 = 0 THEN 'table' ELSE 'text' END AS kind, CASE WHEN block_no % 4 > 0 THEN (block_no % 7 / 10.0)::DOUBLE END AS pre,
        {_score('lower(text)')} AS own, page_score FROM terms_e p JOIN blocks_e k ON k.doc = p.doc JOIN page_scores_e sc ON sc.pair_id = p.pair_id AND sc.page = k.page)""",
    "terms_e", "blocks_e", "page_scores_e",
)
_STRENGTH = "CASE WHEN score >= 0.78 THEN 'direct_support' WHEN score >= 0.45 THEN 'partial_support' ELSE 'weak_support' END"


def ranked(spark, d):
    p = pairs(spark, d)
    return ev.rank_evidence(p, candidates(spark, d), ev.page_scores(p, page_texts(spark, d)))


@query("e03_rank_evidence", "SELECT pair_id, candidate_no, round(score, 6) AS score FROM ranked_e", ("ranked_e",))
def rank_evidence(spark, d):
    return ranked(spark, d).select("pair_id", "candidate_no", F.round("score", 6).alias("score"))


@query(
    "e04_support_strength",
    f"""SELECT pair_id, candidate_no, {_STRENGTH} AS support_strength, CASE WHEN page_score > 0.6 THEN 'Page ' || page || ' repeats most of the claim: ' || kind || ' region ranked with its page'
      WHEN score >= 0.45 THEN 'Page ' || page || ' shares part of the claim: ' || kind || ' region worth a look' ELSE 'Page ' || page || ' shares little with the claim: ' || kind || ' region as a last resort' END AS rationale FROM ranked_e""",
    ("ranked_e",),
)
def support_strength(spark, d):
    return ranked(spark, d).select("pair_id", "candidate_no", "support_strength", "rationale")


@query(
    "e05_dedupe_evidence",
    """SELECT pair_id, candidate_no, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, candidate_no) AS rank FROM (
      SELECT * FROM ranked_e QUALIFY row_number() OVER (PARTITION BY pair_id, page, kind, substring(lower(trim(text)), 1, 120), x0, y0 ORDER BY score DESC, candidate_no) = 1) QUALIFY rank <= 6""",
    ("ranked_e",),
)
def dedupe_evidence(spark, d):
    return ev.dedupe_evidence(ranked(spark, d)).select("pair_id", "candidate_no", long("rank"))


_E_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(claim_text), '[a-zA-Z0-9\\-%\\.]+'), t -> length(t) > 2))"
_E_NUMERIC = "list_distinct(regexp_extract_all(lower(claim_text), '\\b\\d+(?:\\.\\d+)?%?|hr\\s*0?\\.\\d+|p\\s*[<=>]\\s*0?\\.\\d+\\b'))"


@query(
    "e06_shortlist",
    f"""SELECT pair_id, region_no, kind, round(pre_score, 6) AS pre_score, (row_number() OVER (PARTITION BY pair_id ORDER BY round(pre_score, 9) DESC, region_no))::INT AS rank FROM (
      SELECT pair_id, region_no, kind, CASE WHEN kind = 'figure' THEN 0.0::DOUBLE WHEN kind = 'table' THEN least(score * 1.25::DOUBLE, 1) ELSE score END AS pre_score FROM (
        SELECT p.pair_id, k.block_no AS region_no, CASE WHEN is_image THEN 'figure' ELSE t.kind END AS kind,
          CASE WHEN is_image THEN 0::DOUBLE ELSE round(({_score("lower(text)").removeprefix("round(").removesuffix(", 9)")})::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE END AS score
        FROM (SELECT *, {_E_TOKENS} AS toks, {_E_NUMERIC} AS nums FROM pairs_e) p JOIN blocks_e k USING (doc) JOIN block_types_e t ON t.doc = k.doc AND t.block_no = k.block_no))
    QUALIFY rank <= 10""",
    ("pairs_e", "blocks_e", "block_types_e"),
)
def shortlist(spark, d):
    k = blocks(spark, d)
    r = k.select("doc", F.col("block_no").alias("region_no"), "page", F.when(F.col("is_image"), "figure").otherwise(ev.block_type()).alias("kind"),
                 F.when(~F.col("is_image"), F.col("text")).alias("text"))
    return ev.shortlist(pairs(spark, d), r, 10).select("pair_id", "region_no", "kind", F.round("pre_score", 6).alias("pre_score"), "rank")


fragment(
    "block_types_e",
    """SELECT doc, block_no, CASE WHEN length(text) < 200 AND regexp_matches(text, '(?i)^(figure|table|chart|box|fig\\.?)\\s') THEN 'caption' WHEN regexp_matches(text, '(?i)^box\\s+\\d') THEN 'table'
      WHEN length(text) < 80 AND (x1 - x0) / 612.0 < 0.7 THEN 'heading' ELSE 'text' END AS kind FROM blocks_e""",
    "blocks_e",
)


@query("e07_block_type", "SELECT * FROM block_types_e", ("block_types_e",))
def block_type(spark, d):
    return blocks(spark, d).select("doc", "block_no", ev.block_type().alias("kind"))


def rects(spark, d):
    """Boxes around the left or right column, some drawn twice a few points apart, some too small."""
    p = blocks(spark, d).select("doc", "page").distinct()
    k = F.col("doc") % 3

    def box(n, x0, y0, x1, y1):
        return F.struct(F.lit(n).alias("rect_no"), x0.alias("x0"), F.lit(y0).alias("y0"), x1.alias("x1"), F.lit(y1).alias("y1"))

    x = F.when(k == 0, 40.0).otherwise(320.0)
    made = F.array(box(1, x, 70.0, x + 250, 480.0), box(2, x + 4, 74.0, x + 246, 476.0), box(3, x, 70.0, x + 20, 90.0), box(4, F.lit(0.0), 0.0, F.lit(612.0), 792.0))
    return p.select("doc", "page", F.explode(made).alias("r")).select("doc", "page", "r.*", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))


@query("e08_page_rects", "SELECT DISTINCT doc, page, 1 AS rect_no FROM blocks_e", ("blocks_e",))
def page_rects(spark, d):
    return ev.page_rects(rects(spark, d)).select("doc", "page", "rect_no")


@query(
    "e09_rect_groups",
    """SELECT doc, page, 1 AS rect_no, count(*) AS n_blocks, md5(string_agg(trim(text), chr(10) ORDER BY y0, x0, trim(text))) AS text_md5 FROM (
      SELECT *, CASE WHEN doc % 3 = 0 THEN 40.0 ELSE 320.0 END AS rx FROM blocks_e WHERE NOT is_image)
    WHERE greatest(0, least(x1, rx + 250) - greatest(x0, rx)) * greatest(0, least(y1, 480) - greatest(y0, 70)) / ((x1 - x0) * (y1 - y0)) >= 0.8 GROUP BY doc, page HAVING count(*) >= 3""",
    ("blocks_e",),
)
def rect_groups(spark, d):
    g = ev.rect_groups(blocks(spark, d), ev.page_rects(rects(spark, d)))
    return g.select("doc", "page", "rect_no", "n_blocks", F.md5("text").alias("text_md5"))


@query(
    "e10_figure_regions",
    """SELECT c.doc, c.page, c.block_no, round(greatest(coalesce((SELECT max(o.y1) FROM blocks_e o WHERE o.doc = c.doc AND o.page = c.page AND NOT o.is_image AND length(o.text) >= 10 AND o.y1 < c.y0
        AND NOT regexp_matches(o.text, '(?i)^(fig\\.?\\s*\\d|figure\\s*\\d|table\\s*\\d)')), 0), c.y0 - 396), 1) AS y0, round(greatest(c.x0 - 20, 0), 1) AS x0
    FROM blocks_e c WHERE NOT is_image AND regexp_matches(text, '(?i)^(fig\\.?\\s*\\d|figure\\s*\\d|table\\s*\\d)')""",
    ("blocks_e",),
)
def figure_regions(spark, d):
    return ev.figure_regions(blocks(spark, d)).select("doc", "page", "block_no", "y0", "x0")


@query(
    "e11_vision_pages",
    """SELECT doc, page, n AS drawings FROM (SELECT doc, page, count(*) * 4 AS n, sum(CASE WHEN NOT is_image THEN (x1 - x0) * (y1 - y0) / (612.0 * 792.0) ELSE 0 END) AS share FROM blocks_e GROUP BY ALL)
    WHERE n > 15 AND share < 0.4""",
    ("blocks_e",),
)
def vision_pages(spark, d):
    k = blocks(spark, d)
    drawings = k.select("doc", "page", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i"))
    return ev.vision_pages(k, drawings)


@query(
    "e12_column_layout",
    """WITH body AS (SELECT * FROM blocks_e WHERE NOT is_image AND (y0 + y1) / 2 BETWEEN 63.36 AND 728.64 AND length(text) > 20),
    pg AS (SELECT doc, page, count(*) FILTER (WHERE x0 = 50) AS l, count(*) FILTER (WHERE x0 = 330) AS r FROM body WHERE doc % 4 <> 0 GROUP BY ALL)
    SELECT b.doc, CASE WHEN count(*) FILTER (WHERE l + r >= 6 AND l >= 2 AND r >= 2) >= 2 THEN 305.0 END::DOUBLE AS boundary FROM (SELECT DISTINCT doc, page FROM blocks_e) b LEFT JOIN pg USING (doc, page) GROUP BY b.doc""",
    ("blocks_e",),
)
def column_layout(spark, d):
    return ev.column_layout(blocks(spark, d))


def block_lines(spark, d):
    k = blocks(spark, d)
    i = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("line_in_block")
    return k.select("doc", "page", "block_no", "y0", i).select(
        "doc", "page", "block_no", "line_in_block", (F.col("y0") + (F.col("line_in_block") - 1) * 25).alias("y0"), (F.col("y0") + F.col("line_in_block") * 25 - 1).alias("y1"))


def targets(spark, d):
    """The middle two lines of every block."""
    k = blocks(spark, d)
    return k.select("doc", "page", F.col("block_no").alias("target_id"), "x0", (F.col("y0") + 28).alias("y0"), "x1", (F.col("y0") + 70).alias("y1"), "text")


def placed(spark, d):
    k = blocks(spark, d)
    return ev.paragraph_lines(k, block_lines(spark, d), targets(spark, d), ev.column_layout(k))


@query("e13_paragraph_lines")
def paragraph_lines(spark, d):
    return placed(spark, d)


def edge_lines(spark, d):
    """Page footers: a bare number, 'Page n of m', a bar-separated number, or nothing."""
    p = blocks(spark, d).select("doc", "page").distinct()
    n = s(F.col("doc") % 50 + F.col("page"))
    k = F.col("doc") % 4
    foot = F.when(k == 0, n).when(k == 1, F.concat(F.lit("Page "), n, F.lit(" of 99"))).when(k == 2, F.concat(F.lit("Journal | "), n)).otherwise("Footer")
    rows = F.array(F.struct(foot.alias("text"), F.lit(750.0).alias("y0")), F.struct(F.lit("12345").alias("text"), F.lit(400.0).alias("y0")))
    return p.select("doc", "page", F.explode(rows).alias("l")).select(
        "doc", "page", "l.text", "l.y0", (F.col("l.y0") + 10).alias("y1"), F.lit(300.0).alias("x0"), F.lit(312.0).alias("x1"), F.lit(8.0).alias("size"),
        F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))


@query(
    "e15_printed_page",
    "SELECT doc, page, CASE WHEN doc % 4 < 3 THEN (doc % 50 + page)::VARCHAR ELSE page::VARCHAR END AS printed_page FROM (SELECT DISTINCT doc, page FROM blocks_e)", ("blocks_e",),
)
def printed_page(spark, d):
    return ev.printed_page(edge_lines(spark, d))


@query("e14_location")
def location(spark, d):
    k = blocks(spark, d)
    lay = ev.column_layout(k)
    t = targets(spark, d).join(lay, "doc").withColumn("col", ev.column_of(F.col("x0"), F.col("x1"), F.col("boundary")))
    rows = t.join(placed(spark, d), ["doc", "page", "target_id"], "left").join(ev.printed_page(edge_lines(spark, d)), ["doc", "page"])
    kind = F.when(F.col("target_id") % 3 == 0, "figure").when(F.col("target_id") % 3 == 1, "table").otherwise("text")
    loc = ev.location(F.col("printed_page"), F.col("col"), kind, F.col("text"), F.col("para"), F.col("line_start"), F.col("line_end"))
    return rows.select("doc", "page", "target_id", loc.alias("location"))


_RULES = (("relapse", "placebo", None, 0.4), ("relapse", None, "/p1/", 0.2), ("fell", "adverse events", None, -0.3), ("nothing", None, None, 1.0))


@query(
    "e16_rule_rerank",
    """SELECT pair_id AS claim_id, arg_max(candidate_no, {'s': sc, 'n': -candidate_no}) AS candidate_no, max(sc) AS rule_score FROM (
      SELECT doc AS pair_id, block_no AS candidate_no, round((block_no % 7 / 10.0)::DOUBLE - block_no * 0.01::DOUBLE + CASE WHEN contains(lower(text), 'placebo') THEN 0.4::DOUBLE ELSE 0 END
        + CASE WHEN page = 1 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN contains(lower(text), 'adverse events') THEN 0.3::DOUBLE ELSE 0 END, 9) AS sc FROM blocks_e) GROUP BY pair_id""",
    ("blocks_e",),
)
def rule_rerank(spark, d):
    c = pairs(spark, d).select(F.col("pair_id").alias("claim_id"), "claim_text")
    k = blocks(spark, d).select(F.col("doc").alias("claim_id"), F.col("block_no").alias("candidate_no"), "text", (F.col("block_no") % 7 / 10.0).alias("pre_score"),
                                F.concat(F.lit("/p"), s(F.col("page")), F.lit("/col1")).alias("location"))
    return ev.rule_rerank(c, k, _RULES)


@query(
    "e17_admit_evidence",
    "SELECT pair_id, candidate_no, CASE WHEN score >= 0.55 THEN 'direct_support' ELSE 'partial_support' END AS support_strength FROM ranked_e WHERE score >= 0.2", ("ranked_e",),
)
def admit_evidence(spark, d):
    return ev.admit_evidence(ranked(spark, d).drop("support_strength")).select("pair_id", "candidate_no", "support_strength")


def suggestions(spark, d):
    """Order lines as suggestions."""
    t = b.table(spark, d, "lineitem")
    return t.select(
        line_id().alias("line"), F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("reference_id"), (F.col("l_partkey") % 30 + 1).alias("page"),
        F.when(F.col("l_linenumber") % 2 == 0, "text_quote").otherwise("table").alias("kind"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("/p "), s(F.col("l_partkey")))).alias("location"),
        "l_returnflag", "l_linestatus",
    ).withColumn("suggestion_id", F.concat_ws("-", s(F.col("claim_id")), s(F.col("line"))))


def accepted(spark, d):
    sg = suggestions(spark, d)
    first = sg.select("suggestion_id", F.lit(1).alias("seq"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("status"), F.lit(None).cast("string").alias("location"))
    second = sg.filter("l_linestatus = 'F'").select("suggestion_id", F.lit(2).alias("seq"), F.when(F.col("l_returnflag") == "A", "rejected").alias("status"), F.lit("/moved").alias("location"))
    o = b.table(spark, d, "orders").filter("o_orderstatus = 'P'")
    manual = o.select(F.col("o_orderkey").alias("manual_id"), F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("reference_id"), F.lit(1).cast("long").alias("page"), F.lit(3).alias("created_at"))
    return ev.accept_evidence(sg, first.unionByName(second), manual)


fragment(
    "accepted",
    f"""SELECT 'ae_' || l_orderkey || '-' || {SQL_LINE_ID} AS evidence_id, l_orderkey AS claim_id, l_suppkey AS reference_id, l_partkey % 30 + 1 AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'text_quote' ELSE 'table' END AS kind,
      'suggestion_accepted' AS origin, CASE WHEN l_linestatus = 'F' THEN '/moved' WHEN l_partkey % 3 = 0 THEN '/p ' || l_partkey END AS location, CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS created_at
    FROM lineitem WHERE CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN false ELSE l_returnflag <> 'R' END
    UNION ALL SELECT 'ae_manual_' || o_orderkey, o_orderkey, o_custkey, 1, 'manual_box', 'manual_user_box', NULL, 3 FROM orders WHERE o_orderstatus = 'P'""",
)


@query("e18_accept_evidence", "SELECT evidence_id, claim_id, reference_id, page, kind, origin, location FROM accepted", ("accepted",))
def accept_evidence(spark, d):
    return accepted(spark, d).drop("created_at")


@query(
    "e19_evidence_for",
    """SELECT evidence_id, row_number() OVER (PARTITION BY claim_id, reference_id ORDER BY page, created_at, evidence_id) AS pos FROM accepted
    WHERE (claim_id, reference_id) IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N')""",
    ("accepted",),
)
def evidence_for(spark, d):
    p = suggestions(spark, d).filter("l_returnflag = 'N'").select("claim_id", "reference_id")
    return ev.evidence_for(accepted(spark, d), p).select("evidence_id", long("pos"))


@query(
    "e20_pending_pairs",
    "SELECT DISTINCT l_orderkey AS claim_id, l_suppkey AS reference_id FROM lineitem WHERE (l_orderkey, l_suppkey) NOT IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')",
)
def pending_pairs(spark, d):
    sg = suggestions(spark, d)
    return ev.pending_pairs(sg.select("claim_id", "reference_id").distinct(), sg.filter("l_returnflag = 'R'"))


@query("e21_evidence_pairs", "SELECT DISTINCT l_orderkey AS claim_id, unnest([l_suppkey, l_partkey]) AS reference_id FROM lineitem")
def evidence_pairs(spark, d):
    t = b.table(spark, d, "lineitem")
    return ev.evidence_pairs(t.select(F.col("l_orderkey").alias("claim_id"), F.array("l_suppkey", "l_partkey", F.lit(None)).alias("reference_ids")))


@query(
    "e22_evidence_list",
    """SELECT evidence_id, coalesce(location, 'Page ' || page || ' · ' || CASE kind WHEN 'text_quote' THEN 'Text Quote' WHEN 'table' THEN 'Table' ELSE 'Manual Box' END) AS label,
      row_number() OVER (PARTITION BY claim_id ORDER BY page, created_at, evidence_id) AS pos FROM accepted""",
    ("accepted",),
)
def evidence_list(spark, d):
    return ev.evidence_list(accepted(spark, d)).select("evidence_id", "label", long("pos"))
