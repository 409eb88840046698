"""Quotes and mined facts over the given tables (survey groups Q and F)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import facts as fc
from claimloom.operators import quotes as qt
from claimloom.plans import bindings as b
from claimloom.plans import ingest_queries as iq
from claimloom.plans import retrieval_queries as rq
from claimloom.plans.registry import FRAGMENTS, fragment, query
from claimloom.plans.text_queries import sql_keywords


def s(c):
    return c.cast("string")


def long(name):
    return F.col(name).cast("long").alias(name)


def quote_pairs(spark, d):
    """One quote per passage: an exact piece, a rewording with the passage's numbers, or an invention."""
    p = b.passages(spark, d)
    tail = F.regexp_extract("passage_text", r"Relapse fell by \d+% \(p<0\.0\d\)\.$", 0)
    k = F.col("reference_id") + F.col("page")
    quote = (
        F.when(k % 3 == 0, F.substring("page_text_", 50, 120))
        .when(k % 3 == 1, F.concat(F.lit("In this trial: "), tail, F.lit(" Zzyzx overall")))
        .otherwise(F.lit("Qqq www 999.77% kkk vvv"))
    )
    body = F.expr("substring(passage_text, 1, length(passage_text) - 1)")
    return p.withColumn("page_text_", body).select(
        F.col("passage_id").alias("pair_id"), quote.alias("quote"), F.col("passage_text").alias("reference_text")
    )


fragment(
    "quote_pairs",
    """SELECT passage_id AS pair_id, passage_text AS reference_text, CASE (reference_id + page) % 3 WHEN 0 THEN substring(substring(passage_text, 1, length(passage_text) - 1), 50, 120)
      WHEN 1 THEN 'In this trial: ' || regexp_extract(passage_text, 'Relapse fell by \\d+% \\(p<0\\.0\\d\\)\\.$') || ' Zzyzx overall' ELSE 'Qqq www 999.77% kkk vvv' END AS quote FROM passages""",
    "passages",
)


def _nq(c):
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9%.<>=\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_NUMS = (
    "list_distinct(list_concat(regexp_extract_all(lower(quote), '\\b\\d+(?:\\.\\d+)?%?\\b'), list_transform(regexp_extract_all(lower(quote), 'p\\s*[<>=]\\s*0?\\.\\d+'), x -> regexp_replace(x, '\\s+', '', 'g'))))"
)


@query(
    "q01_verify_quotes_no_window",
    f"""SELECT pair_id, CASE WHEN nq <> '' AND nt <> '' AND contains(nt, nq) THEN 'verified' WHEN nq <> '' AND nt <> '' AND para IS NOT NULL THEN 'partial' ELSE 'unverified' END AS status,
      CASE WHEN nq <> '' AND nt <> '' AND contains(nt, nq) THEN strpos(nt, nq) - 1 END AS norm_offset,
      CASE WHEN nq <> '' AND nt <> '' AND NOT contains(nt, nq) AND para IS NOT NULL THEN strpos(reference_text, para) - 1 END AS raw_offset
    FROM (SELECT *, {_nq("quote")} AS nq, {_nq("reference_text")} AS nt, CASE WHEN len({_NUMS}) > 0 THEN list_filter(regexp_split_to_array(reference_text, '\\n\\s*\\n|\\.\\s+'),
      p -> len(list_filter({_NUMS}, n -> NOT contains(lower(p), n))) = 0)[1] END AS para FROM quote_pairs)""",
    ("quote_pairs",),
)
def verify_quotes_no_window(spark, d):
    out = qt.verify_quotes(quote_pairs(spark, d), min_ratio=1.01)
    return out.select("pair_id", "status", long("norm_offset"), long("raw_offset"))


def item_pairs(spark, d):
    """Every document against one benchmark item."""
    items = b.table(spark, d, "benchmark")
    n = items.agg(F.count("*")).scalar()
    docs = b.table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % n)
    return docs.join(items.select("item_id", F.col("text").alias("quote")), "item_id").select(
        F.col("doc_id").alias("pair_id"), "quote", F.col("text").alias("reference_text")
    )


@query("q01_verify_quotes")
def verify_quotes(spark, d):
    return qt.verify_quotes(item_pairs(spark, d))


@query("q02_lcs_window")
def lcs_window(spark, d):

    p = item_pairs(spark, d).select("pair_id", tx.norm_quote(F.col("quote")).alias("nq"), tx.norm_quote(F.col("reference_text")).alias("nt"))
    return qt.lcs_window(p.filter("nq <> '' AND nt <> ''")).select("pair_id", F.round("ratio", 6).alias("ratio"), "offset")


_KINDS = ("Table_Cell", "text_quote", "chart_label", " figure_caption ", "other")


@query(
    "q03_rank_quotes",
    """SELECT conv_id, turn, kind AS evidence_type, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC, turn) AS quote_rank FROM (
      SELECT conv_id, turn, ['table_cell', 'text_quote', 'chart_label', 'figure_caption', 'text_quote'][turn % 5 + 1] AS kind, [4, 3, 1, 2, 3][turn % 5 + 1] AS p FROM conversations WHERE turn % 7 <> 6)""",
)
def rank_quotes(spark, d):
    t = b.table(spark, d, "conversations")
    kinds = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("turn") % 5).cast("int"))
    q = t.select("conv_id", "turn", F.col("turn").alias("position"), F.when(F.col("turn") % 7 == 6, "  ").otherwise(F.col("text")).alias("quote"), kinds.alias("evidence_type"))
    return qt.rank_quotes(q, ["conv_id"]).select("conv_id", "turn", "evidence_type", long("quote_rank"))


@query(
    "q04_extraction_confidence",
    """SELECT event_id, round(CASE WHEN value > 10 THEN 0.95 ELSE 0.8 END + CASE event_type WHEN 'view' THEN 0.02 WHEN 'click' THEN -0.01 WHEN 'signup' THEN -0.05 ELSE 0 END, 6)::DOUBLE AS value FROM events""",
)
def extraction_confidence(spark, d):
    t = b.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "table_cell").when(F.col("event_type") == "click", "figure_caption").when(F.col("event_type") == "signup", "chart_label").otherwise("text_quote")
    status = F.when(F.col("value") > 10, "verified").otherwise("partial")
    return t.select("event_id", F.round(qt.extraction_confidence(status, kind), 6).alias("value"))


@query(
    "q05_quote_page",
    """SELECT o.doc_id, k, coalesce(max(CASE WHEN start_char <= off AND off < end_char THEN page END), (floor(off / (max(end_char) / max(page))) + 1)::INT) AS page
    FROM (SELECT doc_id, unnest(range(0, 9))::INT AS k, unnest([0, 2, 3002, 3003, 3004, n - 1, n, n + 50, doc_id * 37 % n]) AS off
      FROM (SELECT doc_id, max(end_char) AS n FROM bounds GROUP BY doc_id)) o JOIN bounds USING (doc_id) GROUP BY o.doc_id, k, off""",
    ("bounds",),
)
def quote_page(spark, d):
    t = iq.with_boundaries(spark, d)
    last = F.element_at("boundaries", -1)
    page = qt.quote_page(F.col("off"), F.col("boundaries"), last["end_char"], last["page"], F.lit(None).cast("int"))
    return t.select("doc_id", "k", page.alias("page"))


def model_quotes(spark, d):
    """Quotes a model might give per candidate: odd references get invented ones, even ones a piece of a page."""
    cands = rq.rt.group_by_reference(rq.reranked_rows(spark, d)).select("claim_id", "reference_id", "ref_rank")
    texts = b.table(spark, d, "documents").select(F.col("doc_id").alias("reference_id"), F.col("text").alias("content_text"))
    rows = cands.join(texts, "reference_id")
    good = F.when(F.col("reference_id") % 2 == 0, F.substring("content_text", 20, 90)).otherwise("Qqq www kkk vvv")
    made = F.array(
        F.struct(F.lit(1).alias("position"), F.lit("Wwww kkkk qqqq vvvv").alias("quote"), F.lit("text_quote").alias("evidence_type")),
        F.struct(F.lit(2).alias("position"), good.alias("quote"), F.lit("table_cell").alias("evidence_type")),
    )
    return cands, rows.select("claim_id", "reference_id", F.explode(made).alias("q")).select("claim_id", "reference_id", "q.*"), texts


fragment(
    "extraction",
    f"""SELECT claim_id, reference_id, ref_rank, quote, 0.97::DOUBLE AS match_confidence FROM (
      SELECT c.claim_id, c.reference_id, ref_rank, substring(text, 20, 90) AS quote, {_nq("text")} AS nt, {_nq("substring(text, 20, 90)")} AS nq
      FROM candidate_refs c JOIN documents d ON d.doc_id = c.reference_id WHERE c.reference_id % 2 = 0)
    WHERE nq <> '' AND contains(nt, nq) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY ref_rank) = 1""",
    "candidate_refs",
)


@query(
    "q06_extraction_tier",
    "SELECT claim_id, reference_id, ref_rank, 'table_cell' AS evidence_type, 'verified-extraction' AS match_tier, match_confidence FROM extraction", ("extraction",),
)
def extraction_tier(spark, d):
    cands, quotes, texts = model_quotes(spark, d)
    out = qt.extraction_tier(cands, quotes, texts)
    return out.select("claim_id", "reference_id", long("ref_rank"), "evidence_type", "match_tier", F.round("match_confidence", 6).alias("match_confidence"))


@query(
    "q07_locate_excerpt",
    """WITH p AS (SELECT doc_id, page, lower(trim(regexp_replace(page_text, '\\s+', ' ', 'g'))) AS t, page_text FROM doc_pages),
    e AS (SELECT doc_id, page, doc_id * 1000 + page AS excerpt_id, greatest(1, page + (doc_id + page) % 3 - 1) AS cited,
      lower(trim(regexp_replace(substring(page_text, 100, 160) || CASE WHEN doc_id % 2 = 0 THEN ' zzzz' ELSE '' END, '\\s+', ' ', 'g'))) AS n FROM p)
    SELECT excerpt_id, arg_min(page, pref)::INT AS page, arg_min(l, pref)::BIGINT AS needle_length FROM (
      SELECT e.excerpt_id, p.page, CASE p.page - cited WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS pref,
        CASE WHEN length(n) >= 24 AND contains(t, substring(n, 1, 180)) THEN length(substring(n, 1, 180)) WHEN length(n) >= 24 AND contains(t, substring(n, 1, 140)) THEN length(substring(n, 1, 140))
          WHEN length(n) >= 24 AND contains(t, substring(n, 1, 90)) THEN length(substring(n, 1, 90)) END AS l
      FROM e JOIN p ON p.doc_id = e.doc_id AND abs(p.page - cited) <= 1) WHERE l IS NOT NULL GROUP BY excerpt_id""",
    ("doc_pages",),
)
def locate_excerpt(spark, d):
    p = b.doc_pages(spark, d)
    cited = F.greatest(F.lit(1), (F.col("page") + (F.col("doc_id") + F.col("page")) % 3 - 1).cast("int"))
    e = p.select(
        (F.col("doc_id") * 1000 + F.col("page")).alias("excerpt_id"), "doc_id", cited.alias("page"),
        F.concat(F.substring("page_text", 100, 160), F.when(F.col("doc_id") % 2 == 0, " zzzz").otherwise("")).alias("excerpt"),
    )
    return qt.locate_excerpt(e, p).select("excerpt_id", "page", long("needle_length"))


# ---- facts ----


_NOISE = "(length({c}) < 24 OR len(string_split({c}, ' ')) < 4 OR regexp_matches({c}, '(?i)^(?:copyright|all rights reserved|references|contents|table of contents)\\b'))"


def sql_cat(col, name):
    return f"regexp_matches({col}, '(?i)\\b(?:{fc.CATEGORY_WORDS[name]})\\b')"


_NUM = "regexp_matches({c}, '\\b\\d+(?:\\.\\d+)?%?\\b')"


def sql_score(c):
    parts = [
        f"CASE WHEN {_NUM.format(c=c)} THEN 2 ELSE 0 END",
        f"CASE WHEN regexp_matches({c}, '(?i)\\b(?:p\\s*[<=>]\\s*0?\\.\\d+|hr\\s*0?\\.\\d+|hazard ratio|odds ratio|confidence interval|n\\s*[=:]?\\s*\\d+)\\b') THEN 2 ELSE 0 END",
        f"CASE WHEN regexp_matches({c}, '(?i)\\b(?:phase\\s+[ivx]+|randomized|double-blind|placebo|trial|study|cohort)\\b') THEN 1 ELSE 0 END",
        *[f"CASE WHEN {sql_cat(c, n)} THEN 1 ELSE 0 END" for n in fc.CATEGORY_WORDS],
    ]
    return "(" + " + ".join(parts) + ")"


def sql_category(c):
    rows = []
    for i, n in enumerate(fc.CATEGORY_ORDER):
        extra = f" + CASE WHEN {_NUM.format(c=c)} THEN 1 ELSE 0 END" if n in ("efficacy", "statistical") else ""
        rows.append(f"{{'s': CASE WHEN {sql_cat(f'lower({c})', n)} THEN 1 ELSE 0 END{extra}, 'o': {-i}, 'n': '{n}'}}")
    return f"list_max([{', '.join(rows)}]).n"


_FSTOP = "[" + ", ".join(f"'{w}'" for w in fc.FACT_STOP_WORDS) + "]"


def sql_fact_keywords(c):
    ws = f"list_filter(regexp_extract_all(lower({c}), '[a-z][a-z0-9-]{{2,}}'), w -> NOT list_contains({_FSTOP}, w))"
    nums = [r"(?i)\bp\s*[<=>]\s*0?\.\d+\b", r"(?i)\bn\s*[=:]?\s*\d+\b", r"(?i)\bhr\s*0?\.\d+\b", r"\b\d+(?:\.\d+)?%?\b"]
    found = "flatten([" + ", ".join(f"list_transform(regexp_extract_all({c}, '{p}'), t -> lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))))" for p in nums) + "])"
    pairs = f"list_filter([{ws}[1] || ' ' || {ws}[2], {ws}[2] || ' ' || {ws}[3]], p -> p IS NOT NULL)"
    return f"list_concat(list_concat({found}, {pairs}), {ws})"


@query(
    "f01_fact_blocks",
    f"SELECT DISTINCT doc_id, page, stmt AS block FROM statements WHERE NOT {_NOISE.format(c='stmt')}", ("statements",),
)
def fact_blocks(spark, d):
    return fc.fact_blocks(b.stmt_pages(spark, d)).select("doc_id", "page", "block")


@query("f02_fact_score", f"SELECT doc_id, ord, {sql_score('text')}::BIGINT AS score FROM sentence_rows", ("sentence_rows",))
def fact_score(spark, d):
    return b.sentence_rows(spark, d).select("doc_id", "ord", fc.fact_score(F.col("text")).cast("long").alias("score"))


fragment("raw_statements", "SELECT doc_id, source, line_no, 1 AS page, line AS stmt FROM lines", "lines")


def facts_of_texts(name: str = "facts") -> str:
    """The fragment of a step of fact mining over whole documents of one page instead of statements."""
    steps = {"statements": "raw_statements", "blocks": "raw_blocks", "segments": "raw_segments", "facts": "raw_facts"}
    if name != "statements":
        body, needs = FRAGMENTS[name]
        for old, new in steps.items():
            body = re.sub(rf"\b{old}\b", new, body)
        fragment(steps[name], body, *[facts_of_texts(n) for n in needs])
    return steps[name]


fragment(
    "blocks",
    f"SELECT doc_id, page, stmt AS block, row_number() OVER (PARTITION BY doc_id, page ORDER BY min(line_no)) AS block_no FROM statements WHERE NOT {_NOISE.format(c='stmt')} GROUP BY doc_id, page, stmt",
    "statements",
)
fragment(
    "segments",
    f"""SELECT doc_id, page, text, score, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, length(text), first) AS seg_rank FROM (
      SELECT doc_id, page, arg_max(text, {{'s': score, 'b': -block_no, 'p': -pos}}) AS text, max(score) AS score, min({{'b': block_no, 'p': pos}}) AS first FROM (
        SELECT *, {sql_score('text')} AS score FROM (
          SELECT doc_id, page, block_no, -1 AS pos, block AS text FROM blocks
          UNION ALL SELECT doc_id, page, block_no, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT doc_id, page, block_no,
            list_filter(list_transform(string_split(regexp_replace(block, '([.!?]) +([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), x -> trim(x)), x -> x <> '') AS l FROM blocks))
        WHERE pos = -1 OR NOT {_NOISE.format(c='text')}) WHERE score >= 2 GROUP BY doc_id, page, lower(text)) QUALIFY seg_rank <= 10""",
    "blocks",
)


@query("f03_fact_segments", "SELECT doc_id, page, text, score::BIGINT AS score, seg_rank FROM segments", ("segments",))
def fact_segments(spark, d):
    return fc.fact_segments(fc.fact_blocks(b.stmt_pages(spark, d))).select("doc_id", "page", "text", long("score"), long("seg_rank"))


@query("f04_fact_category", f"SELECT doc_id, ord, {sql_category('text')} AS category FROM sentence_rows", ("sentence_rows",))
def fact_category(spark, d):
    return b.sentence_rows(spark, d).select("doc_id", "ord", fc.fact_category(F.col("text")).alias("category"))


_UNIQ = "array_to_string(list_filter(kw, (x, i) -> list_position(kw, x) = i)[1:6], '|')"


@query(
    "f05_fact_keywords",
    f"SELECT doc_id, ord, {_UNIQ} AS keywords FROM (SELECT doc_id, ord, {sql_fact_keywords('text')} AS kw FROM sentence_rows)", ("sentence_rows",),
)
def fact_keywords(spark, d):
    return b.sentence_rows(spark, d).select("doc_id", "ord", F.array_join(fc.fact_keywords(F.col("text")), "|").alias("keywords"))


fragment(
    "facts",
    f"""SELECT doc_id, fact_no, page, text, {sql_category('text')} AS category, {_UNIQ} AS keywords FROM (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, seg_rank) AS fact_no, page, text, {sql_fact_keywords('text')} AS kw FROM (
        SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY doc_id, lower(substring(text, 1, 120)) ORDER BY page, seg_rank) = 1))""",
    "segments",
)


@query(
    "f06_normalize_facts", "SELECT doc_id, 'fact_' || lpad(fact_no::VARCHAR, greatest(3, length(fact_no::VARCHAR))::INT, '0') AS fact_id, page, text FROM facts", ("facts",),
)
def normalize_facts(spark, d):
    return fc.mine_facts(b.stmt_pages(spark, d)).select("doc_id", "fact_id", "page", "text")


@query("f07_mine_facts", "SELECT doc_id, page, category, keywords, md5(text) AS text_md5 FROM facts", ("facts",))
def mine_facts(spark, d):
    f = fc.mine_facts(b.stmt_pages(spark, d))
    return f.select("doc_id", "page", "category", F.array_join("keywords", "|").alias("keywords"), F.md5("text").alias("text_md5"))


@query(
    "f08_fact_inventory",
    """SELECT source AS brand, line_no, total_chars::BIGINT AS total_chars FROM (SELECT source, row_number() OVER w AS line_no, sum(length(line) + 1) OVER w + 90 AS total_chars FROM (
      SELECT source, doc_id, line_no AS n, '- [Ref ' || doc_id || '] ' || CASE WHEN length(stmt) <= 260 THEN stmt ELSE rtrim(substring(stmt, 1, 257)) || '...' END || CASE WHEN line_no % 2 = 0 THEN ' | efficacy' ELSE '' END AS line FROM statements)
      WINDOW w AS (PARTITION BY source ORDER BY doc_id, n)) WHERE total_chars <= 18000""",
    ("statements",),
)
def fact_inventory(spark, d):
    f = b.statements(spark, d).select(
        F.col("source").alias("brand"), "doc_id", "line_no", F.concat(F.lit("Ref "), s(F.col("doc_id"))).alias("alias"),
        F.col("stmt").alias("text"), F.when(F.col("line_no") % 2 == 0, "efficacy").alias("category"),
    ).withColumnRenamed("line_no", "n")
    return fc.fact_inventory(f, "brand", ["doc_id", "n"], 90).select("brand", long("line_no"), long("total_chars"))


@query(
    "f09_fact_summary",
    "SELECT reference_id, brand, extraction_status, coalesce(len(facts), 0) AS facts_count FROM library_docs LEFT JOIN library_facts USING (reference_id)", ("library_docs", "library_facts"),
)
def fact_summary(spark, d):
    return fc.fact_summary(iq.library_docs(spark, d), iq.library_facts(spark, d)).select("reference_id", "brand", "extraction_status", long("facts_count"))


@query(
    "f09_status_counts",
    "SELECT coalesce(extraction_status, 'none') AS status, count(*) AS documents, sum(coalesce(len(facts), 0))::BIGINT AS facts FROM library_docs LEFT JOIN library_facts USING (reference_id) GROUP BY 1",
    ("library_docs", "library_facts"),
)
def status_counts(spark, d):
    return fc.status_counts(fc.fact_summary(iq.library_docs(spark, d), iq.library_facts(spark, d)))


@query(
    "f10_fact_feedback",
    "SELECT user_id AS reference_id, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS confirmed, count(*) FILTER (WHERE event_type NOT IN ('click', 'purchase')) AS rejected FROM events GROUP BY user_id",
)
def fact_feedback(spark, d):
    t = b.table(spark, d, "events")
    decision = F.when(F.col("event_type").isin("click", "purchase"), "confirmed").otherwise("rejected")
    return fc.fact_feedback(t.select(F.col("user_id").alias("reference_id"), decision.alias("decision")))


@query(
    "f11_merge_facts",
    """SELECT user_id AS reference_id, arg_max(event_type, event_id) AS extraction_status, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS facts FROM events GROUP BY user_id""",
)
def merge_facts(spark, d):
    t = b.table(spark, d, "events")
    rows = t.select(
        F.col("user_id").alias("reference_id"), F.col("event_type").alias("extraction_status"), F.lit(None).cast("string").alias("error_message"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("facts"), F.lit("m").alias("model_used"), F.col("event_id").alias("updated_at"),
    )
    return fc.merge_facts(rows.filter("updated_at % 2 = 0"), rows.filter("updated_at % 2 = 1")).select("reference_id", "extraction_status", "facts")


# ---- the cascade ----


def cascade_inputs(spark, d, rows=None):
    """Claims (all, or the given ones) of every fourth conversation cite the first line of their library document; every fifth has no vector, every
    seventh belongs to a brand without a library.  The model picks the first candidate, or nothing in every tenth."""
    c = b.claim_vectors(spark, d, rows)
    conv = F.floor(F.col("claim_id") / 1000)
    vector = F.when(conv % 5 != 3, F.col("embedding"))
    c = c.withColumn("embedding", vector).withColumn("brand", F.when(conv % 7 == 5, "nowhere").otherwise(F.col("brand")))
    cited = F.when(conv % 4 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    claims = c.withColumn("doc", F.col("claim_id")).withColumn("region", F.lit("slide")).withColumn("y", F.lit(10.0)).withColumn("ref_numbers", cited)
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("conv"), F.lower(F.get(F.split("text", "\n"), F.lit(0))).alias("citation_text"))
    pool = c.withColumn("conv", conv).join(docs, "conv").select(
        F.col("claim_id").alias("doc"), "page", F.lit("slide").alias("region"), F.lit(1).alias("ref_no"), "citation_text")
    choices = c.select(
        "claim_id", (conv % 10 != 8).alias("matched"), F.lit("no. 1").alias("reference_index"), F.lit(None).cast("string").alias("reference_name"),
        F.when(F.col("page") % 2 == 0, 85).alias("confidence"))
    return claims, pool, choices


_CSTOP = "[" + ", ".join(f"'{w}'" for w in tx.CLAIM_STOP_WORDS) + "]"
_FIRST = "lower(string_split(t.text, chr(10))[1])"
fragment(
    "cited_best",
    f"""SELECT claim_id, reference_id, score FROM (
      SELECT claim_id, reference_id, ws, len(list_filter(ws, w -> contains(lower(display_alias || ' ' || substring(content_text, 1, 500)), w)))::DOUBLE / nullif(len(ws), 0) AS score
      FROM (SELECT claim_id, brand, list_filter(regexp_split_to_array(trim({_FIRST}), '\\s+'), w -> length(w) > 3 AND NOT list_contains({_CSTOP}, w)) AS ws, {_FIRST} AS raw
        FROM claims JOIN documents t ON t.doc_id = claim_id // 1000 WHERE (claim_id // 1000) % 4 = 0) JOIN refs USING (brand) WHERE length(trim(raw)) >= 10)
    WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 9) DESC, reference_id) = 1""",
    "claims", "refs",
)
fragment("cited_settled", "SELECT claim_id, reference_id, round(score, 9) AS confidence FROM cited_best WHERE round(score, 9) >= 0.85", "cited_best")
fragment("cited_narrowed", "SELECT claim_id, reference_id FROM cited_best WHERE round(score, 9) < 0.85 AND reference_id IN (SELECT reference_id FROM passages)", "cited_best", "passages")


def _scoped(name: str) -> str:
    """The fragment of a retrieval step for claims whose citation narrows the search to one document."""
    steps = ("knn_pool", "scored", "hybrid", "reranked", "candidate_refs", "fallback")
    body, needs = FRAGMENTS[name]
    if name == "knn_pool":
        body = body.replace("FROM knn_all", """FROM knn_all WHERE claim_id NOT IN (SELECT claim_id FROM cited_narrowed)
      OR (claim_id, reference_id) IN (SELECT claim_id, reference_id FROM cited_narrowed)""")
        needs = (*needs, "cited_narrowed")
    for step in steps:
        body = re.sub(rf"\b{step}\b", f"live_{step}", body)
    fragment(f"live_{name}", body, *[_scoped(n) if n in steps else n for n in needs])
    return f"live_{name}"


for _name in ("candidate_refs", "fallback"):
    _scoped(_name)

# a share of the candidates gets no quotes at all
fragment(
    "cascade_extraction",
    f"""SELECT claim_id, reference_id, match_confidence FROM (SELECT c.claim_id, c.reference_id, ref_rank, 0.97::DOUBLE AS match_confidence, {_nq("text")} AS nt, {_nq("substring(text, 20, 90)")} AS nq
      FROM live_candidate_refs c SEMI JOIN candidate_refs o ON o.claim_id = c.claim_id AND o.reference_id = c.reference_id
      JOIN documents d ON d.doc_id = c.reference_id WHERE c.reference_id % 2 = 0 AND c.reference_id % 5 <> 0)
    WHERE nq <> '' AND contains(nt, nq) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY ref_rank) = 1""",
    "candidate_refs", "live_candidate_refs",
)
fragment(
    "cascade",
    f"""SELECT c.claim_id, f.match_tier, f.reference_id, f.c AS match_confidence, none, blind, quoted, candidates, offered FROM (
      SELECT *, (claim_id // 1000) % 7 = 5 AS none, (claim_id // 1000) % 5 = 3 AS blind FROM claims) c
    LEFT JOIN (SELECT * FROM (SELECT claim_id, 'citation-scoped' AS match_tier, reference_id, confidence AS c, 1 AS o FROM cited_settled
        UNION ALL SELECT claim_id, 'fact-anchored', reference_id, similarity, 2 FROM fact_anchor WHERE (claim_id // 1000) % 5 <> 3
        UNION ALL SELECT claim_id, 'verified-extraction', reference_id, match_confidence, 3 FROM cascade_extraction WHERE (claim_id // 1000) % 5 <> 3
        UNION ALL SELECT claim_id, 'semantic-direct-fallback', reference_id, hybrid_score, 4 FROM live_fallback WHERE (claim_id // 1000) % 5 <> 3
        UNION ALL SELECT claim_id, 'keyword-fallback', reference_id, CASE WHEN page % 2 = 0 THEN 0.85::DOUBLE ELSE score END, 5 FROM cascade_keywords
          WHERE (claim_id // 1000) % 5 = 3 AND (claim_id // 1000) % 10 <> 8 AND rank = 1)
      WHERE (claim_id // 1000) % 7 <> 5 QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY o) = 1) f USING (claim_id)
    LEFT JOIN (SELECT claim_id, count(*) AS candidates, count(*) FILTER (WHERE reference_id % 5 <> 0 AND (claim_id, reference_id) IN (SELECT claim_id, reference_id FROM candidate_refs)) AS quoted
      FROM live_candidate_refs GROUP BY claim_id) USING (claim_id)
    LEFT JOIN (SELECT DISTINCT claim_id, true AS offered FROM cascade_keywords) USING (claim_id)""",
    "cited_settled", "fact_anchor", "cascade_extraction", "live_fallback", "claims", "candidate_refs", "live_candidate_refs", "cascade_keywords",
)
fragment(
    "cascade_keywords",
    f"""SELECT claim_id, page, reference_id, score, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, reference_id) AS rank FROM (
      SELECT claim_id, page, reference_id, len(list_filter(kw, n -> contains(lower(content_text), n)))::DOUBLE / nullif(len(kw), 0) AS score
      FROM (SELECT claim_id, page, brand, {sql_keywords("text")} AS kw FROM claims) JOIN refs USING (brand)) WHERE score > 0""",
    "claims", "refs",
)


@query(
    "k16_match_claims",
    """SELECT claim_id, match_tier IS NOT NULL AS matched, match_tier, reference_id, round(match_confidence, 6) AS match_confidence,
      CASE WHEN match_tier IS NOT NULL THEN 'matched' WHEN blind AND (none OR offered IS NULL) THEN 'no-keyword-overlap' WHEN blind THEN 'no-match' WHEN none THEN 'no-passages' ELSE 'no-match' END AS reason,
      CASE WHEN match_tier IN ('citation-scoped', 'fact-anchored') THEN NULL WHEN blind THEN 'error' WHEN none THEN 'no-passages' ELSE 'narrowed' END AS semantic_result,
      CASE WHEN match_tier IN ('citation-scoped', 'fact-anchored') OR blind OR none THEN NULL ELSE candidates END AS candidate_count
    FROM cascade""",
    ("cascade",),
)
def match_claims(spark, d):
    out = cascade_rows(spark, d).withColumn("match_confidence", F.round("match_confidence", 6))
    return out.select("claim_id", "matched", "match_tier", "reference_id", "match_confidence", "reason", "semantic_result", "candidate_count")


def cascade_rows(spark, d):
    from claimloom.operators import cascade

    claims, pool, choices = cascade_inputs(spark, d)
    _, quotes, _ = model_quotes(spark, d)
    quotes = quotes.filter("reference_id % 5 <> 0")
    return cascade.match_claims(claims, b.documents(spark, d), b.passages(spark, d), b.fact_sets(spark, d), quotes, pool, choices)


@query(
    "g02_cascade_summary",
    """SELECT outcome, count(*) AS n FROM (SELECT CASE match_tier WHEN 'citation-scoped' THEN 'citation_scoped_matched' WHEN 'fact-anchored' THEN 'fact_anchored_matched'
        WHEN 'verified-extraction' THEN 'extraction_matched' WHEN 'semantic-direct-fallback' THEN 'semantic_direct_fallback_matched' WHEN 'keyword-fallback' THEN 'keyword_fallback_matched'
        ELSE CASE WHEN blind THEN 'errors' WHEN none THEN 'semantic_no_passages' WHEN quoted > 0 THEN 'extraction_unverified' ELSE 'extraction_not_supported' END END AS outcome FROM cascade) GROUP BY outcome""",
    ("cascade",),
)
def cascade_summary(spark, d):
    from claimloom.operators import reports as rp

    return rp.pipeline_summary(cascade_rows(spark, d), [])
