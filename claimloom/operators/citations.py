"""Citation parsing, metadata and linking (survey group C)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as tx
from claimloom.functions import unicode as un
from claimloom.operators import topk
from claimloom.operators.holding import Held, Pick, blocks
from claimloom.operators.joins import shuffled
from claimloom.operators.postings import substring_hits
from claimloom.session import durable

# Stop words of metadata tokens, journal words, section headers, surname prefixes, letters.
METADATA_STOP_WORDS = (
    "the and for from with this that are was were been have has had not but all can will one two may use used each which their about "
    "other into more some such only also than then its over after under between our these those most research study paper article "
    "review analysis results methods received revised accepted published open access original journal doi vol volume issue pages http "
    "https www com org"
).split()
JOURNAL_WORDS = (
    "Ann|Br|BMC|Clin|Eur|Int|Nat|Rev|Lancet|JAMA|Neurol|Brain|Muscle|Nerve|Cancer|Thorac|Oncol|Respir|Med|Sci|Syst"
)
SECTION_HEADER = rf"(?i){tx.START}(?:Abstract|Background|Introduction|HIGHLIGHTS|INDICATIONS){tx.END}"
SURNAME_PREFIXES = ("van", "de", "den", "von", "del", "la", "le", "di")
FILE_STOP_WORDS = ("et", "al", "the", "and", "of", "in", "a", "an", "for", "on", "with", "to")
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
SHORTEST_CITATION = 10
# end of fixed values

# Scores nearer than this may round to the same one.
_EPS = 1e-7


def parse_citation(c: Column) -> Column:
    """Author, year, journal, volume and pages of a citation; null under ten characters."""
    t = F.trim(tx.text_or_empty(c))

    def part(text: Column) -> Column:
        def group(pattern: str, n: int) -> Column:
            return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))

        author = F.nullif(F.regexp_replace(F.regexp_extract(text, rf"^([A-Z][a-z]+(?:\s[A-Z]{{1,2}})?){tx.END}", 1), r"\s+[A-Z]{1,2}$", ""), F.lit(""))
        year = tx.year_of(text)
        rest = F.substring(text, F.position(author, text) + F.length(author), F.length(text))
        journal_raw = F.regexp_extract(rest, r"(?:et\s+al\.?\s*[,.]?\s*|[A-Z]{1,2}[,.]?\s*)([A-Z][a-zA-Z\s&]+?)\.?\s*(?:\d{4}|;)", 1)
        journal = F.when(author.isNotNull() & year.isNotNull(), F.nullif(F.regexp_replace(F.trim(journal_raw), r"\.$", ""), F.lit("")))
        first, last = group(r":\s*(\d+)[-–](\d+)", 1), group(r":\s*(\d+)[-–](\d+)", 2)
        return F.when(
            F.length(text) >= SHORTEST_CITATION,
            F.struct(
                author.alias("author"), year.alias("year"), journal.alias("journal"), group(r";(\d+)", 1).alias("volume"),
                F.concat(first, F.lit("-"), last).alias("pages"), text.alias("raw"),
            ),
        )

    return tx.bind(t, part)


def reference_head(alias: Column, content: Column) -> Column:
    """Lower-case alias and first 500 characters, the text a citation is scored against."""
    return F.lower(F.concat(tx.text_or_empty(alias), F.lit(" "), F.substring(tx.text_or_empty(content), 1, 500)))


def score_citation(p: Column, head: Column) -> Column:
    """Weighted share of the citation's parts found in a reference head."""

    def has(part: Column) -> Column:
        return F.contains(head, F.lower(part))

    words = F.filter(F.split(F.lower(p["journal"]), r"\s+"), lambda w: F.length(w) > 2)
    found = F.size(F.filter(words, lambda w: F.contains(head, w)))
    partial = (found >= 2) | ((F.size(words) == 1) & (found == 1))
    first_page = F.get(F.split(p["pages"], "-"), F.lit(0))
    vol_or_pages = p["volume"].isNotNull() | p["pages"].isNotNull()
    zero = F.lit(0.0)
    score = (
        F.when(p["author"].isNotNull() & has(p["author"]), 0.4).otherwise(zero)
        + F.when(p["year"].isNotNull() & has(p["year"]), 0.3).otherwise(zero)
        + F.when(p["journal"].isNotNull() & has(p["journal"]), 0.2).when(p["journal"].isNotNull() & partial, 0.12).otherwise(zero)
        + F.when(p["volume"].isNotNull() & has(p["volume"]), 0.05).otherwise(zero)
        + F.when(p["pages"].isNotNull() & has(first_page), 0.05).otherwise(zero)
    )
    weight = (
        F.when(p["author"].isNotNull(), 0.4).otherwise(zero) + F.when(p["year"].isNotNull(), 0.3).otherwise(zero)
        + F.when(p["journal"].isNotNull(), 0.2).otherwise(zero) + F.when(vol_or_pages, 0.1).otherwise(zero)
    )
    raw = F.filter(F.split(F.lower(p["raw"]), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*tx.CLAIM_STOP_WORDS))
    raw_share = F.when(F.size(raw) > 0, F.size(F.filter(raw, lambda w: F.contains(head, w))) / F.size(raw)).otherwise(zero)
    return F.round(F.when(weight > 0, score / weight).otherwise(raw_share), 9)


def citation_needles(parsed: DataFrame) -> DataFrame:
    """query_id, brand, needle, part, weight: the lower-case parts of a citation with the share of the score that each can bring.

    Words of the journal are one part.  A citation without any part has its longer words instead.
    """
    p = F.col("p")

    def part(name: str, text: Column, weight: float) -> Column:
        return F.array(F.struct(F.lower(text).alias("needle"), F.lit(name).alias("part"), F.lit(weight).alias("weight")))

    words = F.filter(F.split(F.lower(F.coalesce(p["journal"], F.lit(""))), r"\s+"), lambda w: w != "")
    journal = F.transform(words, lambda w: F.struct(w.alias("needle"), F.lit("journal").alias("part"), F.lit(0.2).alias("weight")))
    parts = F.concat(part("author", p["author"], 0.4), part("year", p["year"], 0.3), part("volume", p["volume"], 0.05),
                     part("pages", F.get(F.split(p["pages"], "-"), F.lit(0)), 0.05), journal)
    parts = F.filter(parts, lambda x: x["needle"].isNotNull())
    weight = F.when(p["author"].isNotNull(), 0.4).otherwise(0.0) + F.when(p["year"].isNotNull(), 0.3).otherwise(0.0) + F.when(
        p["journal"].isNotNull(), 0.2).otherwise(0.0) + F.when(p["volume"].isNotNull() | p["pages"].isNotNull(), 0.1).otherwise(0.0)
    raw = F.filter(F.split(F.lower(p["raw"]), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*tx.CLAIM_STOP_WORDS))
    # a word that the citation repeats counts each time
    raw_parts = F.transform(F.array_distinct(raw), lambda w: F.struct(w.alias("needle"), w.alias("part"), (
        F.size(F.filter(raw, lambda x: x == w)) / F.size(raw)).cast("double").alias("weight")))
    rows = parsed.select("citation_id", "brand", F.explode(F.when(weight > 0, F.transform(parts, lambda x: F.struct(
        x["needle"].alias("needle"), x["part"].alias("part"), (x["weight"] / weight).alias("weight")))).otherwise(raw_parts)).alias("x"))
    # one needle may be several parts (a volume that is also a page)
    return rows.groupBy(F.col("citation_id").alias("query_id"), "brand", F.col("x.needle").alias("needle")).agg(
        F.concat_ws("+", F.sort_array(F.collect_set("x.part"))).alias("part"), F.sum("x.weight").alias("weight"))


def _citation_parts(parsed: DataFrame) -> DataFrame:
    """query_id, brand, needles and, beside each, which part of ``score_citation`` it is; what the parts weigh together (0: its words count)."""
    p = F.col("p")
    lower = lambda c, part: F.array(F.struct(F.lower(c).alias("needle"), F.lit(part).alias("part")))
    each = lambda words, part: F.transform(words, lambda w: F.struct(w.alias("needle"), F.lit(part).alias("part")))
    words = F.filter(F.split(F.lower(p["journal"]), r"\s+"), lambda w: F.length(w) > 2)
    raw = F.filter(F.split(F.lower(p["raw"]), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*tx.CLAIM_STOP_WORDS))
    weight = F.when(p["author"].isNotNull(), 0.4).otherwise(0.0) + F.when(p["year"].isNotNull(), 0.3).otherwise(0.0) + F.when(
        p["journal"].isNotNull(), 0.2).otherwise(0.0) + F.when(p["volume"].isNotNull() | p["pages"].isNotNull(), 0.1).otherwise(0.0)
    named = F.concat(
        lower(p["author"], "author"), lower(p["year"].cast("string"), "year"), lower(p["journal"], "journal"), F.coalesce(each(words, "word"), F.array()),
        lower(p["volume"], "volume"), lower(F.get(F.split(p["pages"], "-"), F.lit(0)), "page"))
    rows = parsed.select(F.col("citation_id").alias("query_id"), "brand", weight.alias("weight"), F.when(weight > 0, named).otherwise(each(raw, "raw")).alias("x"))
    rows = rows.withColumn("x", F.filter("x", lambda x: x["needle"].isNotNull()))
    return rows.select("query_id", "brand", "weight", F.col("x.needle").alias("needles"), F.col("x.part").alias("parts"))


_SHARES = (("author", 0.4), ("year", 0.3), ("journal", 0.2), ("volume", 0.05), ("page", 0.05))


def _part_scores(of: dict[str, list[int]], weight: float, found: Callable[[list[int]], np.ndarray]) -> np.ndarray:
    """``score_citation`` before it is rounded; ``found`` counts needles per item."""
    if not weight > 0:
        return found(of["raw"]) / len(of["raw"])
    score: np.ndarray | float = 0.0
    for part, share in _SHARES:
        if part in of:
            got = np.where(found(of[part]) > 0, share, 0.0)
            if part == "journal" and "word" in of:
                words = found(of["word"])
                some = (words >= 2) | ((len(of["word"]) == 1) & (words == 1))
                got = np.where(got > 0, share, np.where(some, 0.12, 0.0))
            score = score + got
    return score / weight


def _pick_citations(min_score: float) -> Pick:
    """Of each citation the items that may be its best one: the first of each score within rounding of the highest.

    Items that hold a rare needle are scored first, and the others only where what the frequent needles weigh could reach the best of them.
    """

    def pick(held: Held, queries: pa.Table, needles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols = [], []
        ends = np.cumsum(sizes)
        for q, (start, end, weight, parts) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), queries["weight"].to_pylist(), queries["parts"].to_pylist())):
            of: dict[str, list[int]] = {}
            for code, part in zip(needles[start:end].tolist(), parts):
                of.setdefault(part, []).append(code)
            if not of:
                continue
            lists = [held.of(code) for code in {c for some in of.values() for c in some} if held.rare(code)]
            near = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int32)
            score = _part_scores(of, weight, lambda some, near=near: held.among(some, near))
            often = {part for part, some in of.items() if not all(map(held.rare, some))}
            if weight > 0:
                bound = sum(share for part, share in _SHARES if part in often or (part == "journal" and "word" in often)) / weight
            else:
                bound = sum(not held.rare(c) for c in of["raw"]) / len(of["raw"])
            if bound > 0 and (not len(near) or bound >= score.max() - _EPS):
                near = np.arange(held.n)
                score = _part_scores(of, weight, lambda some: held.add(some, np.zeros(held.n, np.int32)))
            best = score.max() if len(near) else 0
            if best <= 0 or best < min_score - _EPS:
                continue
            close = np.flatnonzero(score >= best - _EPS)
            _, first = np.unique(score[close], return_index=True)
            rows += [q] * len(first)
            cols += near[close[first]].tolist()
        return np.array(rows, np.int64), np.array(cols, np.int64), np.zeros(len(rows), np.int64)

    return pick


def best_citation(citations: DataFrame, references: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Best reference of the brand per citation: citation_id, reference_id, confidence; equal ones go to the smaller id.

    Citations and reference heads meet in blocks of bounded size, which look up the parts as substrings of the heads (see holding.py);
    only the candidates for the first place leave a block and are scored.
    """
    # read several times; a test of the parsed citation itself would be pushed below a caller's aggregation and parse every row there
    long_enough = citations.filter(F.length(F.trim(tx.text_or_empty(F.col("citation_text")))) >= SHORTEST_CITATION)
    parsed = durable(long_enough.select("citation_id", "brand", parse_citation(F.col("citation_text")).alias("p")))
    head = F.col("head") if "head" in references.columns else reference_head(F.col("display_alias"), F.col("content_text"))
    heads = durable(references.select(F.col("reference_id").alias("item"), "brand", head.alias("head")))
    items = heads.select("item", "brand", F.array("head").alias("words"), F.length("head").alias("chars")).filter("chars > 0")
    pairs = blocks(_citation_parts(parsed), items, _pick_citations(min_score), ["brand"], together=False).select("query_id", "item").distinct()
    rows = pairs.join(shuffled(parsed.select(F.col("citation_id").alias("query_id"), "p")), "query_id").join(shuffled(heads.select("item", "head")), "item")
    scored = rows.withColumn("score", score_citation(F.col("p"), F.col("head"))).filter((F.col("score") > 0) & (F.col("score") >= min_score))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item"))
    out = scored.withColumn("rank", F.row_number().over(w)).filter("rank = 1")
    return out.select(F.col("query_id").alias("citation_id"), F.col("item").alias("reference_id"), F.col("score").alias("confidence"))


def citation_tier(claims: DataFrame, page_refs: DataFrame, references: DataFrame, keep: float = config.CITATION_KEEP,
                  accept: float = config.CITATION_ACCEPT) -> tuple[DataFrame, DataFrame]:
    """Claims settled by their citation, and the references the others are narrowed to.

    claims: claim_id, doc, brand, page, region, y, ref_numbers; page_refs: doc, page, region, ref_no, citation_text.
    """
    region = F.coalesce(F.col("region"), F.when(F.coalesce("y", F.lit(50.0)) < 55, "slide").otherwise("notes"))
    cited = claims.select("claim_id", "doc", "brand", "page", region.alias("region"), F.posexplode("ref_numbers").alias("pos", "ref_no"))
    rows = cited.join(shuffled(page_refs), ["doc", "page", "region", "ref_no"])
    keyed = durable(rows.withColumn("citation_id", F.sha2(F.concat_ws("\x1f", "brand", "citation_text"), 256)))
    distinct = keyed.select("citation_id", "brand", "citation_text").distinct()
    best = best_citation(distinct, references, keep)
    linked = keyed.join(shuffled(best), "citation_id")
    top = linked.groupBy("claim_id").agg(
        F.max_by(F.struct("reference_id", "confidence", "ref_no", "citation_text", "region"), F.struct("confidence", -F.col("pos"))).alias("m")
    ).select("claim_id", "m.*")
    settled = top.filter(F.col("confidence") >= accept)
    narrowed = linked.join(shuffled(settled.select("claim_id")), "claim_id", "left_anti").select("claim_id", "reference_id", "confidence").groupBy(
        "claim_id", "reference_id").agg(F.max("confidence").alias("confidence"))
    return settled, narrowed


# ---- metadata of library documents ----


def first_page(content: Column, boundaries: Column | None = None) -> Column:
    """Text of the first page by its boundary, else the first 2000 characters."""
    text = tx.text_or_empty(content)
    head = F.substring(text, 1, 2000)
    if boundaries is None:
        return head
    b = F.get(boundaries, F.lit(0))
    return F.coalesce(F.substring(text, b["start_char"] + 1, b["end_char"] - b["start_char"]), head)


def _strip_stamp(name: Column) -> Column:
    return F.regexp_replace(name, r"^\d+_", "")


def _front(page: Column, limit: int = 1200) -> Column:
    """Text before the first section header, else the first characters."""
    before = F.regexp_extract(page, rf"(?s)^(.*?){SECTION_HEADER}", 1)
    return F.when(page.rlike(SECTION_HEADER), before).otherwise(F.substring(page, 1, limit))


def _unless_stop(words: Column, longer_than: int) -> Column:
    return F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(*METADATA_STOP_WORDS))


def author_tokens(page: Column, limit: int = 8) -> Column:
    pattern = rf"{tx.START}[A-Z][{LETTERS}‑'-]+"
    found = F.transform(F.regexp_extract_all(_front(page), F.lit(pattern), F.lit(0)), lambda w: F.lower(w))
    return F.slice(F.array_distinct(_unless_stop(found, 1)), 1, limit)


def metadata_year(filename: Column, page: Column) -> Column:
    named = F.nullif(F.regexp_extract(_strip_stamp(filename), r"(?:^|[_\-\s.])((?:19|20)\d{2})(?:$|[_\-\s.])", 1), F.lit(""))
    return F.coalesce(named, tx.year_of(page))


def journal_tokens(page: Column, authors: Column, limit: int = 5) -> Column:
    of = F.regexp_extract(page, rf"(?i)Journal\s+of\s+[{LETTERS}\s]+", 0)
    named = _unless_stop(F.transform(F.split(of, r"\s+"), lambda w: F.lower(w)), 2)
    lines = F.array_join(F.slice(F.split(page, "\n"), 1, 10), "\n")
    short = F.transform(F.regexp_extract_all(lines, F.lit(rf"(?i){tx.START}(?:{JOURNAL_WORDS}){tx.END}"), F.lit(0)), lambda w: F.lower(w))
    short = F.filter(short, lambda w: (F.length(w) > 2) & ~F.array_contains(authors, w))
    return F.slice(F.array_distinct(F.concat(named, short)), 1, limit)


def title_tokens(page: Column, limit: int = 8) -> Column:
    """Words of the longest run of title-like lines; the first run wins ties."""
    lines = F.slice(F.filter(F.transform(F.split(_front(page), "\n"), lambda ln: F.trim(F.regexp_replace(ln, r"^\s+|\s+$", ""))), lambda ln: ln != ""), 1, 20)

    def skipped(ln: Column) -> Column:
        return (
            ln.rlike(r"^10\.\d{4}") | ln.rlike(r"(?i)^(?:Received|Revised|Accepted|Published|DOI|http|©)")
            | (ln.rlike(r"^\d") & (F.length(ln) < 20)) | (F.length(ln) < 8)
        )

    state = F.struct(F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit("").alias("best"), F.lit(0).alias("best_n"))

    def step(acc: Column, ln: Column) -> Column:
        cur = F.when(skipped(ln), "").when(acc["cur"] == "", ln).otherwise(F.concat_ws(" ", acc["cur"], ln))
        n = F.when(skipped(ln), 0).otherwise(acc["n"] + F.length(ln))
        better = n > acc["best_n"]
        return F.struct(cur.alias("cur"), n.alias("n"), F.when(better, cur).otherwise(acc["best"]).alias("best"),
                        F.when(better, n).otherwise(acc["best_n"]).alias("best_n"))

    block = F.aggregate(lines, state, step, lambda acc: acc["best"])
    words = F.transform(F.split(block, r"[\s–—\-,;:()]+"), lambda w: F.lower(F.regexp_replace(w, rf"^[^{LETTERS}]+|[^{LETTERS}]+$", "")))
    return F.slice(F.array_distinct(_unless_stop(words, 3)), 1, limit)


def citation_metadata(docs: DataFrame) -> DataFrame:
    """Structured citation metadata of documents.  Input: reference_id, filename, content_text, display_alias."""
    page = first_page(F.col("content_text"))
    rows = docs.withColumn("_page", page).withColumn("author_tokens", author_tokens(F.col("_page")))
    stripped = _strip_stamp(F.col("filename"))
    stem = F.regexp_replace(stripped, r"\.[^.]+$", "")
    doi = F.regexp_replace(F.regexp_extract(tx.text_or_empty(F.col("content_text")), r"10\.\d{4,}/\S+", 0), r"[.,;:)\]}>]+$", "")
    return rows.select(
        "reference_id", F.lower(F.get(F.split(stem, r"[_\-\s.]+"), F.lit(0))).alias("first_author"), "author_tokens",
        metadata_year(F.col("filename"), F.col("_page")).alias("year"), F.nullif(doi, F.lit("")).alias("doi"),
        journal_tokens(F.col("_page"), F.col("author_tokens")).alias("journal_tokens"), title_tokens(F.col("_page")).alias("title_tokens"),
        tx.norm_inline(F.lower(F.regexp_replace(stem, r"[_\-]+", " "))).alias("normalized_filename"),
        F.lower(F.trim(F.col("display_alias"))).alias("normalized_alias"),
    )


# ---- library match by metadata and name ----


def parsed_citations(citations: DataFrame) -> DataFrame:
    """citation_id, doi, year, first_author, normalized and distinct keyword tokens."""
    stripped = tx.strip_citation_number(F.col("citation_text"))
    rows = citations.withColumn("normalized", un.norm_match(stripped))
    return rows.select(
        "citation_id", tx.doi_of(F.col("citation_text")).alias("doi"), tx.year_of(stripped).alias("year"),
        F.nullif(F.regexp_extract("normalized", "^([a-z]+)", 1), F.lit("")).alias("first_author"), "normalized",
        F.array_distinct(tx.cite_keywords(F.col("normalized"))).alias("tokens"),
    )


def _keyword_list(values: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), tx.cite_keywords_latin)))


def phrase_prefix(normalized: Column, values: Column, min_words: int) -> Column:
    """A value of enough keywords starts, in its first five, inside the citation."""

    def hit(v: Column) -> Column:
        words = tx.cite_keywords_latin(v)
        return (F.size(words) >= min_words) & F.contains(normalized, F.array_join(F.slice(words, 1, 5), " "))

    return (normalized != "") & F.exists(F.coalesce(values, F.array().cast("array<string>")), hit)


def library_index(metadata: DataFrame, names: DataFrame) -> DataFrame:
    """Reference side of the match: metadata tokens and normalised names, computed once."""
    rows = names.select("reference_id", un.norm_match(F.col("name")).alias("name_n"), un.norm_match(F.col("original_name")).alias("orig_n"))
    meta = metadata.select(
        "reference_id", F.nullif(F.get(F.split(tx.norm_match_latin(F.col("first_author")), " "), F.lit(0)), F.lit("")).alias("m_first"),
        F.col("year").alias("m_year"), F.lower("doi").alias("m_doi"), _keyword_list(F.col("author_tokens")).alias("m_auth"),
        _keyword_list(F.col("title_tokens")).alias("m_title"), _keyword_list(F.col("journal_tokens")).alias("m_jour"),
        F.col("title_tokens").alias("raw_title"), F.col("journal_tokens").alias("raw_jour"),
    )
    return rows.join(shuffled(meta), "reference_id", "left")


def score_metadata() -> Column:
    """First rule that holds, in the fixed order; columns of parsed_citations and library_index."""

    def shared(name: str) -> Column:
        return F.size(F.array_intersect(F.col("tokens"), F.coalesce(F.col(name), F.array().cast("array<string>"))))

    first = F.coalesce(F.col("first_author") == F.col("m_first"), F.lit(False))
    year = F.coalesce(F.col("year") == F.col("m_year"), F.lit(False))
    auth, title, jour = shared("m_auth"), shared("m_title"), shared("m_jour")
    title_ok = (title >= 2) | phrase_prefix(F.col("normalized"), F.col("raw_title"), 2)
    bonus = F.when(jour > 0, 0.1).otherwise(0.0) + F.when(title > 0, 0.1).otherwise(0.0)
    return (
        F.when(F.coalesce(F.col("doi") == F.col("m_doi"), F.lit(False)), 1.0)
        .when(first & year, F.least(F.lit(0.98), F.round(F.lit(0.8) + bonus, 9)))
        .when(first & title_ok, 0.78)
        .when((auth >= 2) & ((jour >= 1) | title_ok), 0.76)
        .when((auth >= 1) & title_ok, 0.72)
        .when(auth >= 3, 0.66)
        .when(first & ((jour >= 1) | phrase_prefix(F.col("normalized"), F.col("raw_jour"), 1)), 0.68)
        .when((auth >= 1) & year, 0.6)
        .otherwise(0.0)
    )


def score_name() -> Column:
    """Name fallback: equal .95, contained .7, else half the share of name words (from .6, two words)."""
    n = F.col("normalized")
    names = [F.col("name_n"), F.col("orig_n")]
    equal = reduce(lambda a, b: a | b, [n == x for x in names])
    inside = reduce(lambda a, b: a | b, [(F.length(x) >= 4) & (F.contains(n, x) | F.contains(x, n)) for x in names])

    def share(x: Column) -> Column:
        words = tx.cite_keywords(x)
        hits = F.size(F.filter(words, lambda w: F.array_contains(F.col("tokens"), w)))
        ratio = hits / F.greatest(F.size(words), F.lit(1))
        return F.when((ratio >= 0.6) & (hits >= 2), ratio * 0.5).otherwise(0.0)

    return F.when(n == "", 0.0).when(equal, 0.95).when(inside, 0.7).otherwise(F.round(F.greatest(*[share(x) for x in names]), 9))


# What a document can score that is met by a key of this kind.
ROUTE_CAPS = {"doi": 1.0, "first": 0.98, "author": 0.76, "equal": 0.95, "inside": 0.7, "around": 0.7, "word": 0.5}


def citation_routes(parsed: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys by which a citation and a document can meet, as needles (query_id, needle, part, weight, least) and postings (needle, item).

    Routes: equal DOI, equal first author, a shared author token, equal name, the name contained in the citation or the citation in
    the name (looked up through their words), two shared name words.
    """
    needles, postings = [], []

    def key(route: str, text: Column) -> Column:
        return F.concat(F.lit(route + "\x1f"), text)

    def add(route: str, left: DataFrame, right: DataFrame) -> None:
        # a share of words counts from two of them on
        needles.append(left.select(F.col("citation_id").alias("query_id"), key(route, F.col("key")).alias("needle"), F.lit(route).alias("part"),
                                   F.lit(ROUTE_CAPS[route]).alias("weight"), F.lit(2 if route == "word" else 1).alias("least")))
        postings.append(right.select(key(route, F.col("key")).alias("needle"), F.col("reference_id").alias("item")))

    def cited(value: Column) -> DataFrame:
        return parsed.select("citation_id", value.alias("key"))

    def known(value: Column) -> DataFrame:
        return index.select("reference_id", value.alias("key"))

    add("doi", cited(F.col("doi")), known(F.col("m_doi")))
    add("first", cited(F.col("first_author")), known(F.col("m_first")))
    add("author", cited(F.explode("tokens")), known(F.explode("m_auth")))
    named = index.select("reference_id", F.explode(F.array_distinct(F.array("name_n", "orig_n"))).alias("key"))
    whole = cited(F.col("normalized")).filter("key <> ''")
    add("equal", whole, named)
    long_names = named.filter(F.length("key") >= 4)
    inner = substring_hits(parsed, ["citation_id"], "normalized", long_names.select(F.col("key").alias("needle")))
    add("inside", inner.select("citation_id", F.col("needle").alias("key")), long_names)
    outer = substring_hits(long_names.select("key").distinct(), ["key"], "key", whole.select(F.col("key").alias("needle")))
    add("around", whole, outer.join(shuffled(long_names), "key").select("reference_id", F.col("needle").alias("key")))
    add("word", cited(F.explode("tokens")), named.select("reference_id", F.explode(F.array_distinct(tx.cite_keywords(F.col("key")))).alias("key")))
    union = lambda rows: reduce(lambda a, b: a.unionByName(b), rows).filter("needle IS NOT NULL").distinct()
    return union(needles), union(postings)


def match_citations(citations: DataFrame, index: DataFrame, mode: str = "server", floor: float = config.LIBRARY_CITATION_MIN) -> DataFrame:
    """Best library document per citation: citation_id, reference_id, score; equal ones go to the smaller id.

    ``mode`` ui uses the name only where the metadata say nothing, server takes the better of both.  A key that most documents share is
    not expanded for a citation that a rarer key has settled at a higher score (see topk.py).
    """
    # each route reads both
    parsed, index = durable(parsed_citations(citations)), durable(index)
    needles, postings = citation_routes(parsed, index)
    meta, name = score_metadata(), score_name()
    value = F.greatest(meta, name) if mode == "server" else F.when(meta > 0, meta).otherwise(name)

    def score(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(shuffled(parsed.withColumnRenamed("citation_id", "query_id")), "query_id").join(
            shuffled(index.withColumnRenamed("reference_id", "item")), "item")
        return rows.select("query_id", "item", value.alias("score")).filter(F.col("score") >= floor)

    out = topk.best(durable(needles), durable(postings), score, 1, [], floor, "max")
    return out.select(F.col("query_id").alias("citation_id"), F.col("item").alias("reference_id"), "score")


# ---- printed pages ----


def resolve_printed_page(citations: DataFrame, pages: DataFrame, floor: int = 8) -> DataFrame:
    """Physical page on which the first cited page number is printed.

    citations: citation_id, doc_id, citation_text; pages: doc_id, page, page_text.  Null page below the floor.
    """
    r = tx.page_range(F.col("citation_text"))
    wanted = citations.withColumn("r", r).filter("r IS NOT NULL").select("citation_id", "doc_id", F.col("r.start").cast("string").alias("target"), F.col("r.label").alias("label"))
    # blank lines do not count in the distance to the page edge
    kept = F.filter(F.transform(F.split("page_text", r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    lines = pages.withColumn("lines", kept).select("doc_id", "page", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    # only lines with digits can hold a page number: join on the digit runs of the line
    runs = lines.withColumn("target", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\d+"), F.lit(0)))))
    met = wanted.join(runs, ["doc_id", "target"])
    t, ln = F.col("target"), F.col("line")
    edge = F.least(F.col("i"), F.col("n") - 1 - F.col("i"))
    explicit = F.regexp_extract_all(F.lower(ln), F.lit(rf"(?:^|{tx.EDGE})(?:page|p\.?)[\s#:.-]*(\d+){tx.END}"), F.lit(1))
    wrapped = F.regexp_extract_all(ln, F.lit(r"(?:^|[|/·•-])\s*(\d+)(?=\s*(?:$|[|/·•-]))"), F.lit(1))
    score = (
        F.lit(1) + F.when(edge <= 1, 6).when(edge <= 3, 4).when(edge <= 5, 2).otherwise(0)
        + F.when(ln == t, 9).when(F.array_contains(explicit, t), 8).when(F.length(ln) <= F.length(t) + 2, 7).when(F.length(ln) <= 20, 4).otherwise(0)
        + F.when(F.array_contains(wrapped, t), 2).otherwise(0)
        - F.when(tx.year_of(ln).isNotNull() & (F.length(ln) > 24), 2).otherwise(0)
    )
    best = met.withColumn("score", score).groupBy("citation_id").agg(F.max(F.struct("score", (-F.col("page")).alias("p"))).alias("b"))
    out = wanted.join(best, "citation_id", "left")
    found = F.coalesce("b.score", F.lit(0))
    return out.select(
        "citation_id", "label", F.when(found >= floor, -F.col("b.p")).alias("page"), F.greatest(F.lit(0), found).alias("match_score")
    )


def file_index(files: DataFrame) -> DataFrame:
    """First author, last year, journal tokens and kind from file names (column filename)."""
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    tokens = F.filter(
        F.transform(F.split(F.trim(F.regexp_replace(stem, r"[_\s]+", " ")), " "), lambda w: F.regexp_replace(w, r"^-+|-+$", "")), lambda w: w != ""
    )
    rows = files.withColumn("_t", tokens).withColumn("_low", F.transform("_t", lambda w: F.regexp_replace(F.lower(w), r"[,.]+$", "")))
    is_prefix = F.transform("_low", lambda w: w.isin(*SURNAME_PREFIXES))
    lead = F.coalesce(F.nullif(F.array_position(is_prefix, False), F.lit(0)), F.size("_low")).cast("int")  # prefixes, then the surname
    author = F.array_join(F.slice("_low", 1, F.greatest(F.lit(1), lead)), " ")
    years = F.regexp_extract_all(stem, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    year = F.when(F.size(years) > 0, F.element_at(years, -1))
    rest = F.slice("_t", F.greatest(F.lit(1), lead) + 1, F.size("_t"))
    parts = F.flatten(F.transform(rest, lambda w: F.split(w, r"[-.,;()\[\]]+")))
    cleaned = F.transform(parts, lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z0-9]", "")))
    journal = F.filter(
        cleaned,
        lambda w: (F.length(w) > 1) & ~w.isin(*FILE_STOP_WORDS) & ~F.coalesce(w == year, F.lit(False))
        & ~(w.rlike(r"^\d+$") & (F.length(w) > 4)) & ~w.rlike(r"^v\d"),
    )
    return rows.select("filename", author.alias("first_author"), year.alias("year"), journal.alias("journal_tokens"), tx.file_type(F.col("filename")).alias("kind"))


def ref_ordinal(number: Column, fallback: Column) -> Column:
    """Positive number of a reference, else its place; flags the made-up ones."""
    parsed = F.regexp_extract(tx.text_or_empty(number), r"^\s*([-+]?\d{1,9})", 1).try_cast("int")
    valid = F.coalesce(parsed > 0, F.lit(False))
    return F.struct(F.when(valid, parsed).otherwise(F.greatest(F.lit(1), fallback)).alias("ordinal"), (~valid).alias("synthetic"))
