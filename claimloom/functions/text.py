"""Text column expressions.

Patterns are written for ASCII word boundaries and a Unicode blank class, because the
JVM's own ``\\b`` and ``\\s`` follow other rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank class, boundaries, word lists and patterns.
BLANK = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_W = "A-Za-z0-9_"
START = f"(?<![{_W}])"
END = f"(?![{_W}])"
EDGE = f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"

CLAIM_STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did "
    "will would could should may might can shall this that these those it its not no than as if when where which "
    "who whom what how all each every both few more most other some such only also very just about above after "
    "before between during through into over under again further then once here there any up out so we they he "
    "she me him her my your our their us them"
).split()
CITATION_STOP_WORDS = (
    "the and for from with that this are was were has have been not but its also can may all doi vol etal etc "
    "study studies journal review"
).split()
GENERIC_LABELS = ("global slide annotation", "global notes annotation", "visual area")
LABEL_PHRASES = ("prescribing information",)
LABEL_WORDS = ("pi", "uspi", "ifu", "ppi")
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
SUPERSCRIPT_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
NUMBER = rf"{START}\d+(?:\.\d+)?%?{EDGE}"
P_VALUE = rf"{START}p{BLANK}*[<=>]{BLANK}*0?\.\d+{END}"
SAMPLE_SIZE = rf"{START}n{BLANK}*[=:]?{BLANK}*\d+{END}"
HAZARD = rf"{START}hr{BLANK}*0?\.\d+{END}"
QUALIFIERS = (
    (P_VALUE, 3.0),
    (rf"{START}(?:95|90|99)%{BLANK}*ci{END}", 2.0),
    (rf"{START}confidence interval{END}", 2.0),
    (rf"{START}hazard ratio{END}", 2.0),
    (rf"{START}odds ratio{END}", 2.0),
    (rf"{START}risk ratio{END}", 2.0),
    (rf"{START}relative risk{END}", 2.0),
    (SAMPLE_SIZE, 1.5),
    (rf"{START}(?:mean|median|standard deviation|std\.?|se){EDGE}", 1.0),
    (rf"{START}vs\.?{EDGE}|{START}versus{END}|{START}compared with{END}", 1.0),
)
CLAIM_UNITS = rf"\d+(?:\.\d+)?%|{START}\d+{BLANK}*(?:days?|months?|years?|patients?|cases?|visits?){END}"
CLAIM_SIGNALS = (
    rf"{START}(?:only|better|improved|associated|significant|fewer|shorter|greater|reduced|increased|risk|outcome|"
    rf"delay|diagnosis|consultation){END}"
)
DANGLING = rf"{START}(?:a|an|and|or|the|to|of|with|from|for|in)$"
# end of fixed values


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a let expression)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_inline(c: Column) -> Column:
    """Collapse blanks to one space and trim."""
    return F.trim(F.regexp_replace(text_or_empty(c), BLANK + "+", " "))


def norm_memo(c: Column) -> Column:
    """Key of identical claim texts."""
    return norm_inline(F.lower(text_or_empty(c)))


def norm_alias(c: Column) -> Column:
    return norm_inline(F.regexp_replace(F.lower(text_or_empty(c)), rf"[^a-z0-9 \t\n\r\f\x0b]", " "))


def norm_quote(c: Column) -> Column:
    return norm_inline(
        F.regexp_replace(F.lower(text_or_empty(c)), BLANK[:-1].replace("[", "[^a-z0-9%.<>=", 1) + "]", " ")
    )


def norm_position(c: Column) -> Column:
    """Letters, digits, underscore and blanks only."""
    return norm_inline(F.regexp_replace(F.lower(text_or_empty(c)), BLANK.replace("[", "[^a-z0-9_", 1), ""))


def norm_span(c: Column) -> Column:
    """As norm_position, keeping percent, dollar, dot and comma."""
    return norm_inline(F.regexp_replace(F.lower(text_or_empty(c)), BLANK.replace("[", "[^a-z0-9_%$.,", 1), ""))


def norm_evidence(c: Column) -> Column:
    expanded = reduce(lambda acc, lig: F.replace(acc, F.lit(lig[0]), F.lit(lig[1])), LIGATURES, text_or_empty(c))
    return F.lower(norm_inline(expanded))


def split_blank(c: Column) -> Column:
    """Blank-separated words of an already normalised text; empty list for an empty text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def _word_list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def keywords(c: Column) -> Column:
    """Distinct claim keywords in order of appearance."""
    cleaned = F.regexp_replace(F.lower(text_or_empty(c)), BLANK.replace("[", "[^a-z0-9-", 1), " ")
    words = F.split(norm_inline(cleaned), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*CLAIM_STOP_WORDS)))


def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _unspaced(arr: Column) -> Column:
    return F.transform(arr, lambda t: F.regexp_replace(t, BLANK + "+", ""))


def numeric_tokens(c: Column) -> Column:
    """Numbers, p-values and sample sizes; the percent sign stays only before a word character."""
    low = F.lower(text_or_empty(c))
    return F.array_distinct(
        F.concat(_matches(low, NUMBER), _unspaced(_matches(low, P_VALUE)), _unspaced(_matches(low, SAMPLE_SIZE)))
    )


def quote_numbers(c: Column) -> Column:
    """Numbers and p-values of a quote (p may follow a letter here)."""
    low = F.lower(text_or_empty(c))
    p = rf"p{BLANK}*[<>=]{BLANK}*0?\.\d+"
    return F.array_distinct(F.concat(_matches(low, NUMBER), _unspaced(_matches(low, p))))


def claim_terms(c: Column) -> Column:
    """Struct of token and numeric terms; percent signs are kept."""
    low = norm_inline(F.lower(text_or_empty(c)))
    numeric = rf"{START}\d+(?:\.\d+)?%?|{P_VALUE}|{SAMPLE_SIZE}|{HAZARD}"
    return F.struct(
        F.array_distinct(_matches(low, r"[a-z0-9][a-z0-9.%/-]{2,}")).alias("tokens"),
        F.array_distinct(_matches(low, numeric)).alias("numeric"),
    )


def evidence_terms(c: Column) -> Column:
    """Sorted distinct terms, evidence-script alphabet."""
    low = norm_inline(F.lower(text_or_empty(c)))
    tokens = F.filter(_matches(low, r"[a-zA-Z0-9\-%\.]+"), lambda t: F.length(t) > 2)
    numeric = rf"{START}\d+(?:\.\d+)?%?|hr{BLANK}*0?\.\d+|p{BLANK}*[<=>]{BLANK}*0?\.\d+{END}"
    return F.struct(
        F.array_sort(F.array_distinct(tokens)).alias("tokens"),
        F.array_sort(F.array_distinct(_matches(low, numeric))).alias("numeric"),
    )


def numeric_signature(c: Column) -> Column:
    """Percentages, p-values, sample sizes and all numbers as four sets."""
    low = F.lower(text_or_empty(c))

    def as_set(pattern: str) -> Column:
        return F.array_distinct(_unspaced(_matches(low, pattern)))

    return F.struct(
        as_set(rf"{START}\d+(?:\.\d+)?%").alias("percentages"),
        as_set(P_VALUE).alias("p_values"),
        as_set(SAMPLE_SIZE).alias("sample_sizes"),
        as_set(rf"{START}\d+(?:\.\d+)?{END}").alias("numbers"),
    )


def sentences(c: Column) -> Column:
    """Split after .!? before a capital, digit or opening bracket."""
    parts = F.split(norm_inline(c), r"(?<=[.!?])" + BLANK + r"+(?=[A-Z0-9(])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def strip_markdown(c: Column) -> Column:
    steps = (
        (r"(?s)```.*?```", " "),
        (r"`([^`]+)`", "$1"),
        (r"!\[[^\]]*\]\([^)]+\)", " "),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?m)^[#>\-*+\d.)" + BLANK[1:] + "+", ""),
        (r"\|", " "),
        (r"[_~]", " "),
    )
    return norm_inline(reduce(lambda acc, s: F.regexp_replace(acc, s[0], s[1]), steps, text_or_empty(c)))


def parse_superscript(c: Column) -> Column:
    """'1,3-5' to [1,3,4,5]; only 1..50 stay."""
    parts = F.split(F.trim(text_or_empty(c)), r"[,\s]+")

    def expand(part: Column) -> Column:
        lo = F.regexp_extract(part, r"^(\d{1,9})[-–—](\d{1,9})$", 1)
        hi = F.regexp_extract(part, r"^(\d{1,9})[-–—](\d{1,9})$", 2)
        first = F.greatest(F.expr("1"), lo.cast("int"))
        last = F.least(F.expr("50"), hi.cast("int"))
        return (
            F.when((lo != "") & (first <= last), F.sequence(first, last))
            .when(part.rlike(r"^\d{1,9}$"), F.array(part.try_cast("int")))
            .otherwise(F.expr("array()").cast("array<int>"))
        )

    return F.filter(F.flatten(F.transform(parts, expand)), lambda n: (n >= 1) & (n <= 50))


def parse_glyph_refs(c: Column) -> Column:
    """Reference numbers written in superscript digits, in order, 1..199."""
    runs = _matches(text_or_empty(c), f"[{SUPERSCRIPT_DIGITS}]+")
    numbers = F.transform(runs, lambda r: F.translate(r, SUPERSCRIPT_DIGITS, "0123456789").try_cast("int"))
    return F.filter(numbers, lambda n: n.isNotNull() & (n > 0) & (n < 200))


def parse_trailing_refs(c: Column) -> Column:
    """Digits at the end of a line, comma or blank separated, 1..199."""
    tail = F.regexp_extract(text_or_empty(c), r"[\d,\s]+$", 0)
    numbers = F.transform(F.split(tail, r"[\s,·]+"), lambda p: p.try_cast("int"))
    return F.filter(numbers, lambda n: n.isNotNull() & (n > 0) & (n < 200))


def expand_end_page(start: Column, raw_end: Column) -> Column:
    """Full end page of an abbreviated range: 671-83 gives 683."""
    s, e = start.cast("string"), raw_end
    prefix_len = F.greatest(F.lit(0), F.length(s) - F.length(e))
    prefix = F.substring(s, F.lit(1), prefix_len)
    joined = F.concat(prefix, e).try_cast("int")
    bumped = F.concat((prefix.try_cast("int") + 1).cast("string"), e).try_cast("int")
    end = e.try_cast("int")
    return (
        F.when((F.length(e) >= F.length(s)) | (end >= start), end)
        .when((joined < start) & (prefix_len > 0), bumped)
        .otherwise(joined)
    )


def page_range(c: Column) -> Column:
    """Start, end and label of the pages a citation names, or null."""
    src = norm_inline(F.regexp_replace(text_or_empty(c), r"^\s*\d+\.\s*", ""))
    ranges = (
        r"(?i)(?:pp?\.\s*)(\d{1,5})\s*[-–]\s*(\d{1,5})(?!\d)",
        r":\s*(\d{1,5})\s*[-–]\s*(\d{1,5})(?!\d)",
        r"(?:^|[,(;\s])(\d{1,5})\s*[-–]\s*(\d{1,5})(?!\d)(?:$|[).,;\s])",
    )
    singles = (r"(?i)(?:pp?\.\s*)(\d{1,5})(?!\s*[-–]\s*\d)", r":\s*(\d{1,5})(?!\s*[-–]\s*\d)(?!\d)")

    def candidates(t: Column) -> Column:
        pairs = [F.struct(F.regexp_extract(t, p, 1).alias("a"), F.regexp_extract(t, p, 2).alias("b")) for p in ranges]
        pairs += [F.struct(F.regexp_extract(t, p, 1).alias("a"), F.lit("").alias("b")) for p in singles]
        return F.array(*pairs)

    def resolve(pair: Column) -> Column:
        start = pair["a"].try_cast("int")
        end = F.when(pair["b"] == "", start).otherwise(expand_end_page(start, pair["b"]))
        label = F.when(pair["b"] == "", pair["a"].try_cast("int").cast("string")).otherwise(
            F.concat_ws("-", start.cast("string"), end.cast("string"))
        )
        return F.struct(start.alias("start"), end.alias("end"), label.alias("label"))

    hits = F.transform(F.filter(bind(src, candidates), lambda pair: pair["a"] != ""), resolve)
    return F.get(F.filter(hits, lambda r: r["end"] >= r["start"]), F.lit(0))


def figure_label(c: Column) -> Column:
    """'Fig. 3' or 'Table2' at the start of a text as 'fig 3', 'table 2'."""
    hit = F.regexp_extract(F.trim(text_or_empty(c)), r"(?i)^(fig\.?\s*\d+|figure\s*\d+|table\s*\d+|box\s*\d+)", 1)
    flat = norm_inline(F.replace(F.lower(hit), F.lit("."), F.lit("")))
    spaced = F.regexp_replace(flat, r"(fig|figure|table|box)(\d)", "$1 $2")
    return F.when(hit != "", spaced)


def year_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_or_empty(c), rf"{START}(?:19|20)\d{{2}}{END}", 0), F.lit(""))


def strip_citation_number(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), r"^\d+\.\s*", "")


def doi_of(c: Column) -> Column:
    raw = F.regexp_extract(strip_citation_number(c), r"10\.\d{4,}/\S+", 0)
    return F.nullif(F.lower(F.regexp_replace(raw, r"[.,;)\]]+$", "")), F.lit(""))


def weak_claim(c: Column) -> Column:
    """Too short, too few words, or only a region label."""
    return bind(norm_inline(c), _weak)


def _weak(t: Column) -> Column:
    words = F.size(F.split(t, " "))
    generic = F.lower(t).isin(*GENERIC_LABELS)
    return (
        (t == "")
        | generic
        | (F.length(t) < 24)
        | ((words < 5) & ~t.rlike(r"\d"))
        | t.rlike(r"(?i)^(?:visual|chart|table|figure|image) (?:area|region|content)$")
        | t.rlike(r"^[^A-Za-z0-9_]+$")
    )


def claim_like(c: Column) -> Column:
    """True for a statement that carries a number with unit or a signal word and reads as a sentence."""
    t = norm_inline(c)
    words = F.split(t, " ")
    titled = F.size(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]+")))
    signal = t.rlike("(?i)" + CLAIM_UNITS) | t.rlike("(?i)" + CLAIM_SIGNALS)
    heading = ~t.rlike(r"[%\d]") & (titled >= F.greatest(F.lit(5.0), F.size(words) * 0.65))
    return (
        ~weak_claim(c)
        & signal
        & ~heading
        & ~t.rlike("(?i)" + DANGLING)
        & ~(t.contains("•") & ~t.rlike(r"[.!?)]$"))
    )


def qualifier_score(c: Column) -> Column:
    t = text_or_empty(c)
    return reduce(
        lambda acc, q: acc + F.when(t.rlike("(?i)" + q[0]), q[1]).otherwise(0.0), QUALIFIERS, F.lit(0.0)
    )


def resolve_confidence(c: Column, fallback: Column) -> Column:
    """Number or numeric string to 0..1; values in (1,100] are percentages."""
    number = F.regexp_extract(text_or_empty(c), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    scaled = F.when((number > 1) & (number <= 100), number / 100.0).otherwise(number)
    return F.when(number.isNull(), fallback).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def stable_hash(c: Column) -> Column:
    """32-bit rolling hash 31*h + code unit, 8 hex digits."""
    chars = F.filter(F.split(text_or_empty(c), ""), lambda ch: ch != "")
    value = F.aggregate(chars, F.lit(0).cast("long"), lambda h, ch: (h * 31 + F.ascii(ch)) % F.lit(4294967296))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def display_alias(c: Column) -> Column:
    """Readable title from a file name."""
    steps = (
        (r"\.[^.]+$", ""),
        (r"[_\-.]+", " "),
        (r"^\d{4}[\s-]\d{2}[\s-]\d{2}\s*", ""),
        (r"(?i)^v\d+(?:\.\d+)?\s*", ""),
        (r"(?i)^[A-Z]{2,4}-[A-Z]{2,4}-\d+\s*", ""),
        (r"(?i)\s*(?:FINAL|DRAFT|v\d+(?:\.\d+)?|copy)\s*$", ""),
    )
    t = norm_inline(reduce(lambda acc, s: F.regexp_replace(acc, s[0], s[1]), steps, text_or_empty(c)))
    titled = F.array_join(
        F.transform(F.split(t, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " "
    )
    cut = F.when(F.length(titled) > 100, F.regexp_replace(F.substring(titled, 1, 100), r"\s\w*$", "")).otherwise(titled)
    return F.coalesce(F.nullif(cut, F.lit("")), c)


def snippet(text: Column, claim: Column, before: int = 80, length: int = 360) -> Column:
    """Window of the text around the first long claim keyword found in it."""
    return snippet_of(norm_inline(text), norm_evidence(text), claim, before, length)


def snippet_of(flat: Column, low: Column, claim: Column, before: int = 80, length: int = 360) -> Column:
    """``snippet`` for a text whose inline and evidence forms are at hand, as where many claims share it."""
    words = F.filter(cite_keywords_latin(claim), lambda w: F.length(w) >= 5)
    # a long text is searched up to the first keyword it holds
    found = bind(low, lambda t: F.aggregate(words, F.lit(0), lambda p, w: F.when(p > 0, p).otherwise(F.position(w, t))))
    anchor = F.greatest(F.coalesce(found, F.lit(0)), F.lit(1)) - 1

    def cut(start: Column) -> Column:
        body = F.trim(F.substring(flat, start + 1, F.lit(length)))
        return F.when(start > 0, F.concat(F.lit("..."), body)).otherwise(body)

    return F.when(flat != "", bind(F.greatest(F.lit(0), anchor - before), cut))


def claim_type(c: Column) -> Column:
    t = F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "_")
    return (
        F.when(t.isin("bullet", "image", "table", "text"), t)
        .when(
            t.isin("figure", "chart", "diagram", "visual", "visual_area", "llamaparse_line", "llamaparse_window"), "image"
        )
        .when(t == "structured_box", "table")
    )


def file_type(c: Column) -> Column:
    """Document kind from a lower-case file name."""
    t = F.lower(text_or_empty(c))
    return (
        F.when(reduce(lambda acc, m: acc | t.contains(m), LABEL_PHRASES, F.lit(False)), "prescribing_info")
        .when(t.rlike(r"(?<![a-zA-Z])(?:" + "|".join(LABEL_WORDS) + r")(?![a-zA-Z])"), "prescribing_info")
        .when(t.contains("nccn"), "guideline")
        .when(t.rlike(r"(?<![a-zA-Z])dof(?![a-zA-Z])") | t.contains("data on file"), "data_on_file")
        .when(t.contains("found"), "organization")
        .otherwise("paper")
    )


# Latin letters with diacritics and the base letters NFKD leaves after the marks are dropped.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"
# end of fixed values


def _match_form(c: Column) -> Column:
    plain = F.regexp_replace(c, "['’]", "")
    return F.lower(F.trim(F.regexp_replace(plain, "[^a-zA-Z0-9]+", " ")))


def norm_match_latin(c: Column) -> Column:
    """Match form for Latin-1 letters, JVM only: marks dropped, other symbols blank, lower case."""
    return _match_form(F.translate(text_or_empty(c), _MARKED, _PLAIN))


def cite_keywords_latin(c: Column) -> Column:
    return cite_keywords(norm_match_latin(c))


def cite_keywords(normalised: Column) -> Column:
    """Citation keywords of a text already in match form; duplicates stay."""
    return F.filter(F.split(normalised, " "), lambda w: (F.length(w) > 2) & ~w.isin(*CITATION_STOP_WORDS))
