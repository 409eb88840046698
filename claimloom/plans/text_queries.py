"""Text expressions selected over whole tables (survey group T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.functions import unicode as un
from claimloom.plans import bindings as b
from claimloom.plans.registry import query

BLANK = b.SQL_BLANK
CLAIM_STOP = "[" + ", ".join(f"'{w}'" for w in tx.CLAIM_STOP_WORDS) + "]"
CITE_STOP = "[" + ", ".join(f"'{w}'" for w in tx.CITATION_STOP_WORDS) + "]"


def joined(c):
    return F.array_join(c, "|")


def sql_list(expr: str, ordered: bool = False) -> str:
    return f"array_to_string({expr if ordered else f'list_sort(list_distinct({expr}))'}, '|')"


def sql_keywords(col: str) -> str:
    return (
        f"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({col}), "
        f"'[^a-z0-9-]', ' ', 'g'), ' +', ' ', 'g')), ' '), w -> length(w) > 2 AND NOT list_contains({CLAIM_STOP}, w)))"
    )


def sql_numeric(col: str) -> str:
    low = f"lower({col})"
    return (
        f"list_distinct(list_concat(list_concat(regexp_extract_all({low}, '\\b\\d+(?:\\.\\d+)?%?\\b'), "
        f"list_transform(regexp_extract_all({low}, '\\bp\\s*[<=>]\\s*0?\\.\\d+\\b'), x -> regexp_replace(x, '\\s+', '', 'g'))), "
        f"list_transform(regexp_extract_all({low}, '\\bn\\s*[=:]?\\s*\\d+\\b'), x -> regexp_replace(x, '\\s+', '', 'g'))))"
    )


def sql_match_form(col: str) -> str:
    return f"lower(trim(regexp_replace(replace(strip_accents({col}), '''', ''), '[^a-zA-Z0-9]+', ' ', 'g')))"


def sql_terms_tokens(col: str) -> str:
    return f"list_distinct(regexp_extract_all({b.sql_inline(f'lower({col})')}, '[a-z0-9][a-z0-9.%/-]{{2,}}'))"


def sql_terms_numeric(col: str) -> str:
    return (
        f"list_distinct(regexp_extract_all({b.sql_inline(f'lower({col})')}, "
        r"'\b\d+(?:\.\d+)?%?|\bp\s*[<=>]\s*0?\.\d+\b|\bn\s*[=:]?\s*\d+\b|\bhr\s*0?\.\d+\b'))"
    )


DOC = "SELECT doc_id, line_no, {} AS value FROM statements"


def _over_statements(expr):
    def run(spark, d):
        return b.statements(spark, d).select("doc_id", "line_no", expr(F.col("stmt")).alias("value"))

    return run


def scalar(name, expr, oracle, needs=("statements",)):
    query(name, DOC.format(oracle) if oracle else None, needs if oracle else ())(_over_statements(expr))


@query("t01_norm_inline", f"SELECT doc_id, {b.sql_inline('text')} AS value FROM documents")
def norm_inline(spark, d):
    return b.table(spark, d, "documents").select("doc_id", tx.norm_inline(F.col("text")).alias("value"))


@query("t02_norm_match", f"SELECT doc_id, {sql_match_form('text')} AS value FROM documents")
def norm_match(spark, d):
    return b.table(spark, d, "documents").select("doc_id", un.norm_match(F.col("text")).alias("value"))


scalar(
    "t03_norm_quote", tx.norm_quote,
    "trim(regexp_replace(regexp_replace(lower(stmt), '[^a-z0-9%.<>=\\s]', ' ', 'g'), '\\s+', ' ', 'g'))",
)
scalar(
    "t04_norm_dedup", un.norm_dedup,
    "array_to_string(regexp_extract_all(lower(trim(regexp_replace(regexp_replace(replace(replace(stmt, '\"', ''), '''', ''), "
    "'(?i)\\bversus\\b', 'vs', 'g'), '[.,;:!?]+$', ''))), '[\\p{L}\\p{N}%]+(?:[.-][\\p{L}\\p{N}%]+)*'), ' ')",
)
scalar(
    "t05_norm_alias", tx.norm_alias,
    "trim(regexp_replace(regexp_replace(lower(stmt), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))",
)
scalar("t06_norm_memo", tx.norm_memo, "trim(regexp_replace(lower(stmt), '\\s+', ' ', 'g'))")
scalar(
    "t07_norm_position", lambda c: F.concat_ws("|", tx.norm_position(c), tx.norm_span(c)),
    "trim(regexp_replace(regexp_replace(lower(stmt), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) || '|' || "
    "trim(regexp_replace(regexp_replace(lower(stmt), '[^a-z0-9_\\s%$.,]', '', 'g'), '\\s+', ' ', 'g'))",
)
scalar(
    "t08_norm_evidence",
    lambda c: tx.norm_evidence(F.replace(F.replace(c, F.lit("ffi"), F.lit("ﬃ")), F.lit("fi"), F.lit("ﬁ"))),
    "lower(trim(regexp_replace(stmt, '\\s+', ' ', 'g')))",
)
scalar("t09_keywords", lambda c: joined(F.array_sort(tx.keywords(c))), sql_list(sql_keywords("stmt")))
scalar("t10_numeric_tokens", lambda c: joined(F.array_sort(tx.numeric_tokens(c))), sql_list(sql_numeric("stmt")))
scalar(
    "t11_citation_keywords", lambda c: joined(tx.cite_keywords(un.norm_match(c))),
    sql_list(f"list_filter(string_split({sql_match_form('stmt')}, ' '), w -> length(w) > 2 AND NOT list_contains({CITE_STOP}, w))", True),
)
scalar(
    "t12_claim_terms",
    lambda c: F.concat_ws("#", joined(F.array_sort(tx.claim_terms(c)["tokens"])), joined(F.array_sort(tx.claim_terms(c)["numeric"]))),
    sql_list(sql_terms_tokens("stmt")) + " || '#' || " + sql_list(sql_terms_numeric("stmt")),
)
scalar(
    "t13_evidence_terms",
    lambda c: F.concat_ws("#", joined(tx.evidence_terms(c)["tokens"]), joined(tx.evidence_terms(c)["numeric"])),
    sql_list("list_filter(regexp_extract_all(lower(stmt), '[a-zA-Z0-9\\-%\\.]+'), t -> length(t) > 2)") + " || '#' || "
    + sql_list("regexp_extract_all(lower(stmt), '\\b\\d+(?:\\.\\d+)?%?|hr\\s*0?\\.\\d+|p\\s*[<=>]\\s*0?\\.\\d+\\b')"),
)


def _signature_text(c):
    s = tx.numeric_signature(c)
    return F.concat_ws("#", *[joined(F.array_sort(s[k])) for k in ("percentages", "p_values", "sample_sizes", "numbers")])


def sql_signature(col: str, part: str) -> str:
    pattern = {
        "percentages": r"\b\d+(?:\.\d+)?%",
        "p_values": r"\bp\s*[<=>]\s*0?\.\d+\b",
        "sample_sizes": r"\bn\s*[=:]?\s*\d+\b",
        "numbers": r"\b\d+(?:\.\d+)?\b",
    }[part]
    return (
        f"list_sort(list_distinct(list_transform(regexp_extract_all(lower({col}), '{pattern}'), "
        f"x -> regexp_replace(x, '\\s+', '', 'g'))))"
    )


scalar(
    "t14_numeric_signature", _signature_text,
    " || '#' || ".join(
        f"array_to_string({sql_signature('stmt', p)}, '|')" for p in ("percentages", "p_values", "sample_sizes", "numbers")
    ),
)


@query("t15_sentences", "SELECT doc_id, page, ord, text FROM sentence_rows", ("sentence_rows",))
def sentence_rows(spark, d):
    return b.sentence_rows(spark, d)


_MD_LINE = "'# ' || line || ' `code` [link](http://x.y) | _cell_'"
scalar_md_sql = (
    f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MD_LINE}, "
    "'`([^`]+)`', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), "
    "'^[#>\\-*+\\d.)\\s]+', '', 'g'), '\\|', ' ', 'g'), '[_~]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query("t16_strip_markdown", f"SELECT doc_id, line_no, {scalar_md_sql} AS value FROM lines", ("lines",))
def strip_markdown(spark, d):
    text = F.concat(F.lit("# "), "line", F.lit(" `code` [link](http://x.y) | _cell_"))
    return b.lines(spark, d).select("doc_id", "line_no", tx.strip_markdown(text).alias("value"))


_SUP = "(l_linenumber || ',' || (l_partkey % 40 + 1) || '-' || (l_partkey % 40 + l_linenumber) || ' ' || l_suppkey)"


@query(
    "t17_parse_superscript",
    f"""SELECT l_orderkey, l_linenumber, array_to_string(list_filter(list_concat(list_concat([l_linenumber::BIGINT],
      range(l_partkey % 40 + 1, l_partkey % 40 + l_linenumber + 1)), [l_suppkey]), n -> n BETWEEN 1 AND 50), '|') AS value
    FROM lineitem""",
)
def parse_superscript(spark, d):
    s = lambda c: c.cast("string")
    k = F.col("l_partkey") % 40
    text = F.concat(s(F.col("l_linenumber")), F.lit(","), s(k + 1), F.lit("-"), s(k + F.col("l_linenumber")), F.lit(" "),
                    s(F.col("l_suppkey")))
    t = b.table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", joined(tx.parse_superscript(text)).alias("value"))


@query(
    "t18_parse_glyph_refs",
    """SELECT l_orderkey, l_linenumber,
      CASE WHEN l_suppkey BETWEEN 1 AND 199 THEN l_suppkey::VARCHAR ELSE '' END AS glyph_refs,
      array_to_string(list_filter([l_linenumber::BIGINT, l_partkey], n -> n > 0 AND n < 200), '|') AS trailing_refs FROM lineitem""",
)
def parse_glyph_refs(spark, d):
    s = lambda c: c.cast("string")
    t = b.table(spark, d, "lineitem")
    glyphs = F.concat(F.lit("Response rate"), F.translate(s(F.col("l_suppkey")), "0123456789", tx.SUPERSCRIPT_DIGITS))
    tail = F.concat(F.lit("Response rate "), s(F.col("l_linenumber")), F.lit(", "), s(F.col("l_partkey")))
    return t.select(
        "l_orderkey", "l_linenumber", joined(tx.parse_glyph_refs(glyphs)).alias("glyph_refs"),
        joined(tx.parse_trailing_refs(tail)).alias("trailing_refs"),
    )


@query(
    "t19_page_range",
    """SELECT l_orderkey, l_linenumber, a AS first_page, z AS last_page, CASE WHEN a = z AND kind = 2 THEN a::VARCHAR ELSE a || '-' || z END AS label
    FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 3) AS kind, (100 + l_partkey % 800)::INT AS a,
      (CASE l_partkey % 3 WHEN 2 THEN 100 + l_partkey % 800 ELSE 100 + l_partkey % 800 + l_linenumber END)::INT AS z FROM lineitem)""",
)
def page_range(spark, d):
    s = lambda c: c.cast("string")
    t = b.table(spark, d, "lineitem")
    a = 100 + F.col("l_partkey") % 800
    z = a + F.col("l_linenumber")
    # the end is abbreviated where it shares the hundreds with the start
    short = F.when(F.substring(s(a), 1, 1) == F.substring(s(z), 1, 1), F.substring(s(z), 2, 9)).otherwise(s(z))
    text = (
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("3. Roe J. Brain. 2018;12(3):"), s(a), F.lit("-"), short, F.lit(".")))
        .when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("Roe J. Guide. 2018, pp. "), s(a), F.lit(" - "), s(z)))
        .otherwise(F.concat(F.lit("Roe J. Brain. 2018;12:"), s(a), F.lit(".")))
    )
    r = tx.page_range(text)
    return t.select(
        "l_orderkey", "l_linenumber", r["start"].alias("first_page"), r["end"].alias("last_page"), r["label"].alias("label")
    )


@query(
    "t20_citation_parts",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, '10.1000/ord.' || o_orderkey AS doi,
      'customer' AS first_author FROM orders""",
)
def citation_parts(spark, d):
    t = b.table(spark, d, "orders")
    text = F.concat(
        F.lit("12. Customer AB et al. Brain. "), F.date_format("o_orderdate", "yyyy"), F.lit(";1. doi:10.1000/ORD."),
        F.col("o_orderkey").cast("string"), F.lit(");"),
    )
    first = F.regexp_extract(un.norm_match(tx.strip_citation_number(text)), "^([a-z]+)", 1)
    return t.select("o_orderkey", tx.year_of(text).alias("year"), tx.doi_of(text).alias("doi"), first.alias("first_author"))


@query(
    "t21_figure_label",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'fig ' || p_size WHEN 1 THEN 'table ' || p_size
      WHEN 2 THEN 'figure ' || p_size END AS value FROM part""",
)
def figure_label(spark, d):
    t = b.table(spark, d, "part")
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Fig. "), n)).when(k == 1, F.concat(F.lit(" TABLE"), n))
        .when(k == 2, F.concat(F.lit("figure  "), n, F.lit(". Survival"))).otherwise(F.col("p_name"))
    )
    return t.select("p_partkey", tx.figure_label(text).alias("value"))


SQL_WEAK = """(text = '' OR lower(text) IN ('global slide annotation', 'global notes annotation', 'visual area') OR length(text) < 24
  OR (len(string_split(text, ' ')) < 5 AND NOT regexp_matches(text, '\\d'))
  OR regexp_matches(text, '(?i)^(?:visual|chart|table|figure|image) (?:area|region|content)$') OR regexp_matches(text, '^\\W+$'))"""
SQL_CLAIM_LIKE = f"""(NOT {SQL_WEAK}
  AND (regexp_matches(text, '(?i)(?:\\d+(?:\\.\\d+)?%|\\b\\d+\\s*(?:days?|months?|years?|patients?|cases?|visits?)\\b)')
    OR regexp_matches(text, '(?i)\\b(?:only|better|improved|associated|significant|fewer|shorter|greater|reduced|increased|risk|outcome|delay|diagnosis|consultation)\\b'))
  AND NOT (NOT regexp_matches(text, '[%\\d]') AND len(list_filter(string_split(text, ' '), w -> regexp_matches(w, '^[A-Z][a-z]+'))) >= greatest(5.0, len(string_split(text, ' ')) * 0.65))
  AND NOT regexp_matches(text, '(?i)\\b(?:a|an|and|or|the|to|of|with|from|for|in)$'))"""


@query(
    "t22_claim_like",
    f"SELECT doc_id, ord, {SQL_WEAK} AS weak, {SQL_CLAIM_LIKE} AS claim_like FROM sentence_rows", ("sentence_rows",),
)
def claim_like(spark, d):
    return b.sentence_rows(spark, d).select(
        "doc_id", "ord", tx.weak_claim(F.col("text")).alias("weak"), tx.claim_like(F.col("text")).alias("claim_like")
    )


SQL_QUALIFIER_PATTERNS = (
    (r"\bp\s*[<=>]\s*0?\.\d+\b", 3.0), (r"\b(?:95|90|99)%\s*ci\b", 2.0), (r"\bconfidence interval\b", 2.0),
    (r"\bhazard ratio\b", 2.0), (r"\bodds ratio\b", 2.0), (r"\brisk ratio\b", 2.0), (r"\brelative risk\b", 2.0),
    (r"\bn\s*[=:]?\s*\d+\b", 1.5), (r"\b(?:mean|median|standard deviation|std\.?|se)\b", 1.0),
    (r"\bvs\.?\b|\bversus\b|\bcompared with\b", 1.0),
)


def sql_qualifier(col: str) -> str:
    return "(" + " + ".join(
        f"CASE WHEN regexp_matches({col}, '(?i){p}') THEN {w}::DOUBLE ELSE 0::DOUBLE END" for p, w in SQL_QUALIFIER_PATTERNS
    ) + ")"


scalar("t23_qualifier_score", tx.qualifier_score, sql_qualifier("stmt"))


@query(
    "t24_resolve_confidence",
    """SELECT event_id, round(CASE WHEN event_type = 'error' THEN 0.5 WHEN value > 1 AND value <= 100 THEN value / 100
      ELSE greatest(0, least(1, value)) END, 6) AS value FROM events""",
)
def resolve_confidence(spark, d):
    t = b.table(spark, d, "events")
    raw = F.when(F.col("event_type") == "error", "unknown").otherwise(F.concat(F.col("value").cast("string"), F.lit(" %")))
    return t.select("event_id", F.round(tx.resolve_confidence(raw, F.lit(0.5)), 6).alias("value"))


scalar(
    "t25_stable_hash", lambda c: F.concat_ws("|", tx.stable_hash(c), F.sha2(c, 256)),
    "lpad(lower(to_hex(list_reduce(list_concat([0::UBIGINT], list_transform(string_split(stmt, ''), ch -> unicode(ch)::UBIGINT)), "
    "(h, c) -> (h * 31 + c) % 4294967296))), 8, '0') || '|' || sha256(stmt)",
)


@query(
    "t26_display_alias",
    """SELECT p_partkey, array_to_string(list_transform(string_split('study report ' || lower(regexp_replace(trim(p_name), '[^a-zA-Z0-9]+', ' ', 'g')), ' '),
      w -> upper(w[1]) || w[2:]), ' ') AS value FROM part""",
)
def display_alias(spark, d):
    t = b.table(spark, d, "part")
    slug = F.lower(F.regexp_replace(F.trim("p_name"), "[^a-zA-Z0-9]+", "_"))
    name = F.concat(F.lit("2021-03-04_study-report_"), slug, F.lit("_FINAL.pdf"))
    return t.select("p_partkey", tx.display_alias(name).alias("value"))


@query(
    "t27_snippet",
    f"""SELECT doc_id, line_no, CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substring(body, s + 1, 360)) AS value FROM (
      SELECT *, greatest(0, coalesce(list_filter(list_transform(list_filter(list_filter(string_split({sql_match_form("claim")}, ' '),
        w -> length(w) > 2 AND NOT list_contains({CITE_STOP}, w)), w -> length(w) >= 5), w -> strpos(lower(body), w)), p -> p > 0)[1], 1) - 1 - 80) AS s
      FROM (SELECT doc_id, line_no, stmt AS claim, body FROM statements JOIN (
        SELECT doc_id, page, string_agg(stmt, ' ' ORDER BY line_no) AS body FROM statements GROUP BY doc_id, page) USING (doc_id, page)))""",
    ("statements",),
)
def snippet(spark, d):
    """Where the page of a statement holds it: whole statements, each against the whole text of its page."""
    # one group is one page of at most ten lines; its text is normalised once
    g = b.statements(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "stmt"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["stmt"]), "\n")
    t = g.select("doc_id", "l", tx.norm_inline(text).alias("flat"), tx.norm_evidence(text).alias("low")).select("doc_id", "flat", "low", F.explode("l").alias("s"))
    return t.select("doc_id", "s.line_no", tx.snippet_of(F.col("flat"), F.col("low"), F.col("s.stmt")).alias("value"))


@query(
    "t28_file_type",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'prescribing_info' WHEN 1 THEN 'prescribing_info' WHEN 2 THEN 'guideline'
      WHEN 3 THEN 'data_on_file' WHEN 4 THEN 'organization' ELSE 'paper' END AS value FROM part""",
)
def file_type(spark, d):
    t = b.table(spark, d, "part")
    marks = F.array(*[F.lit(m) for m in ("prescribing information", "x_pi_2020", "NCCN", "x-dof-1", "heart foundation", "epidemiol")])
    slug = F.regexp_replace(F.lower("p_type"), "[^a-z]+", "_")
    name = F.concat(slug, F.lit(" "), F.get(marks, (F.col("p_partkey") % 6).cast("int")), F.lit(".pdf"))
    return t.select("p_partkey", tx.file_type(name).alias("value"))


@query(
    "t29_claim_type",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 'image' WHEN 'error' THEN 'table' WHEN 'click' THEN 'bullet'
      WHEN 'view' THEN 'image' END AS value FROM events""",
)
def claim_type(spark, d):
    t = b.table(spark, d, "events")
    e = F.col("event_type")
    raw = (
        F.when(e == "signup", "Visual Area").when(e == "error", "structured-box").when(e == "click", "Bullet")
        .when(e == "view", "CHART").otherwise(e)
    )
    return t.select("event_id", tx.claim_type(raw).alias("value"))
