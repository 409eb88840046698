"""Rule-based fact mining (survey group F).  Pages have doc_id, page and text (optionally markdown)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as tx
from claimloom.operators.prefix import running_totals

# Category patterns, the order that settles ties, stop words and noise starts.
CATEGORY_WORDS = {
    "dosage": "dose|dosage|dosed|dosing|mg|mcg|g|ml|tablet|capsule|once daily|twice daily|titrat|administer|administration|maintenance dose",
    "safety": "adverse event|adverse reaction|safety|warning|warnings|boxed warning|black box|contraindicat|toxicity|tolerab|discontinuation|serious adverse|side effect",
    "mechanism": "mechanism of action|pharmacology|pharmacokinetic|pharmacodynamic|receptor|agonist|antagonist|binds|binding|channel|half-life",
    "population": "patients?|subjects?|adults?|pediatric|children|cohort|baseline|inclusion|exclusion|demographic|population|participants?",
    "endpoint": "primary endpoint|secondary endpoint|endpoint|end point|composite endpoint|outcome measure|response rate|seizure frequency",
    "statistical": r"p\s*[<=>]\s*0?\.\d+|confidence interval|hazard ratio|odds ratio|risk ratio|relative risk|ci|median|mean|standard deviation|nnt",
    "regulatory": "approved|approval|indication|indicated|prescribing information|label|labeling|fda|ema|boxed warning|contraindicated|medication guide",
    "efficacy": r"reduction|reduced|improvement|improved|efficacy|effective|superior|inferior|compared with|versus|vs\.?|responders?|benefit|treated",
}
CATEGORY_ORDER = ("dosage", "regulatory", "safety", "mechanism", "endpoint", "efficacy", "population", "statistical")
FACT_STOP_WORDS = (
    "a an and are as at be been being but by for from had has have if in into is it its may more most no not of on or our so such "
    "than that the their them there these they this those to was were which with would"
).split()
NOISE_START = rf"(?i)^(?:copyright|all rights reserved|references|contents|table of contents){tx.END}"
STATISTICS = rf"(?i){tx.START}(?:p\s*[<=>]\s*0?\.\d+|hr\s*0?\.\d+|hazard ratio|odds ratio|confidence interval|n\s*[=:]?\s*\d+){tx.END}"
TRIAL_WORDS = rf"(?i){tx.START}(?:phase\s+[ivx]+|randomized|double-blind|placebo|trial|study|cohort){tx.END}"
# end of fixed values


def has_number(c: Column) -> Column:
    return c.rlike(tx.NUMBER)


def in_category(c: Column, name: str) -> Column:
    words = CATEGORY_WORDS[name]
    # the first letters are looked at ahead of the boundary, which is dearer
    first = "".join(sorted({x for w in words.split("|") for x in (w[0], w[0].upper())}))
    return c.rlike(rf"(?=[{first}]){tx.START}(?i:{words}){tx.EDGE}")


def is_noise(c: Column) -> Column:
    return (F.length(c) < 24) | (F.size(F.split(c, " ")) < 4) | c.rlike(NOISE_START)


def clean(c: Column) -> Column:
    """Blanks collapsed; daggers set apart."""
    return tx.norm_inline(F.regexp_replace(tx.text_or_empty(c), r"\s*([†‡§]+)\s*", " $1 "))


# What the words of a text can add to its score, besides numbers and daggers.
_WORD_POINTS = ((lambda c: c.rlike(STATISTICS), 2), (lambda c: c.rlike(TRIAL_WORDS), 1), *((lambda c, n=n: in_category(c, n), 1) for n in CATEGORY_WORDS))


def word_marks(c: Column) -> Column:
    """Which of the word patterns occur; one that does not occur in a text does not occur in its sentences either."""
    return F.array(*[held(c) for held, _ in _WORD_POINTS])


def fact_score(c: Column, marks: Column | None = None) -> Column:
    """``marks`` (of the text or of one that it is a sentence of) spares patterns that cannot occur."""
    possible = (lambda i: F.get(marks, F.lit(i))) if marks is not None else (lambda i: F.lit(True))
    parts = [
        F.when(has_number(c), 2).otherwise(0), F.when(c.rlike("[†‡§]"), 1).otherwise(0),
        *[F.when(possible(i) & held(c), points).otherwise(0) for i, (held, points) in enumerate(_WORD_POINTS)],
    ]
    return reduce(lambda a, b: a + b, parts)


def _marked_score(marks: Column) -> Column:
    """The score of a text without numbers and daggers, from the marks of its own."""
    return reduce(lambda a, b: a + b, [F.when(F.get(marks, F.lit(i)), points).otherwise(0) for i, (_, points) in enumerate(_WORD_POINTS)])


def fact_category(c: Column) -> Column:
    """Category with most hits; a number speaks for efficacy and statistics; ties by fixed order."""
    number = F.when(has_number(c), 1).otherwise(0)
    scored = []
    for i, name in enumerate(CATEGORY_ORDER):
        score = F.when(in_category(F.lower(c), name), 1).otherwise(0)
        if name in ("efficacy", "statistical"):
            score = score + number
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    return F.array_max(F.array(*scored))["name"]


def fact_keywords(c: Column) -> Column:
    """Numbers, the first two word pairs, then words: six at most."""
    words = F.filter(
        F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9-]{2,}"), F.lit(0)), lambda w: ~w.isin(*FACT_STOP_WORDS)
    )

    def build(ws: Column) -> Column:
        pairs = F.transform(F.slice(ws, 1, 2), lambda w, i: F.when(i + 1 < F.size(ws), F.concat_ws(" ", w, F.get(ws, i + 1))))
        nums = F.flatten(F.array(*[
            F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), lambda t: F.lower(tx.norm_inline(t)))
            for p in ("(?i)" + tx.P_VALUE, "(?i)" + tx.SAMPLE_SIZE, "(?i)" + tx.HAZARD, tx.NUMBER)
        ]))
        return F.slice(F.array_distinct(F.concat(nums, F.array_compact(pairs), ws)), 1, 6)

    return tx.bind(words, build)


def fact_blocks(pages: DataFrame) -> DataFrame:
    """Distinct usable blocks of a page: stripped markdown paragraphs and text lines, in order of appearance."""
    text = F.transform(F.split(tx.text_or_empty(F.col("text")), r"\n+"), clean)
    blocks = text
    if "markdown" in pages.columns:
        md = F.transform(F.split(tx.text_or_empty(F.col("markdown")), r"\n{2,}"), lambda p: clean(tx.strip_markdown(p)))
        blocks = F.concat(md, text)
    usable = F.array_distinct(F.filter(blocks, lambda t: ~is_noise(t)))
    return pages.select("doc_id", "page", F.posexplode(usable).alias("block_no", "block"))


def fact_segments(blocks: DataFrame, per_page: int = config.FACTS_PER_PAGE) -> DataFrame:
    """Best scored blocks and sentences of a page: doc_id, page, text, score, seg_rank."""
    # the block itself stands ahead of its sentences; a sentence that is the whole block adds nothing to it
    def segments(parts: Column) -> Column:
        placed = F.transform(parts, lambda t, i: F.struct((i + 1).alias("pos"), t.alias("text")))
        return F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.col("block").alias("text"))), F.filter(placed, lambda x: (x["text"] != F.col("block")) & ~is_noise(x["text"])))

    # scored inside the array, so that no pattern is searched twice; the block's own marks are its score
    def score(x: Column, marks: Column) -> Column:
        own = F.when(has_number(x["text"]), 2).otherwise(0) + F.when(x["text"].rlike("[†‡§]"), 1).otherwise(0) + _marked_score(marks)
        return F.when(x["pos"] == 0, own).otherwise(fact_score(x["text"], marks))

    marked = tx.bind(word_marks(F.col("block")), lambda marks: F.transform(tx.bind(tx.sentences(F.col("block")), segments), lambda x: F.struct(
        x["pos"].alias("pos"), x["text"].alias("text"), score(x, marks).alias("score"))))
    kept = F.transform(F.filter(marked, lambda x: x["score"] >= 2), lambda x: F.struct(x["pos"].alias("pos"), clean(x["text"]).alias("text"), x["score"].alias("score")))
    scored = blocks.select("doc_id", "page", "block_no", F.explode(kept).alias("x")).select("doc_id", "page", "block_no", "x.*")
    # the first segment of the best score stands for a lower-case text; its place is that of the first one seen
    best = scored.groupBy("doc_id", "page", F.lower("text").alias("k")).agg(
        F.max_by(F.struct("text", "score"), F.struct("score", -F.col("block_no"), -F.col("pos"))).alias("s"),
        F.min(F.struct("block_no", "pos")).alias("first"),
    )
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("s.score"), F.length("s.text"), "first")
    return best.withColumn("seg_rank", F.row_number().over(w)).filter(F.col("seg_rank") <= per_page).select(
        "doc_id", "page", "s.text", "s.score", "seg_rank"
    )


def normalize_facts(segments: DataFrame, prefix: int = 120) -> DataFrame:
    """Facts of a document: first of equal starts, numbered in page and rank order, category and keywords set."""
    key = F.lower(F.substring("text", 1, prefix))
    firsts = segments.groupBy("doc_id", key.alias("k")).agg(F.min(F.struct("page", "seg_rank", "text")).alias("f"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("f.page", "f.seg_rank"))
    return firsts.select(
        "doc_id", F.format_string("fact_%03d", n).alias("fact_id"), F.col("f.page").alias("page"), F.col("f.text").alias("text"),
        fact_category(F.col("f.text")).alias("category"), fact_keywords(F.col("f.text")).alias("keywords"),
    )


def mine_facts(pages: DataFrame) -> DataFrame:
    return normalize_facts(fact_segments(fact_blocks(pages)))


def fact_line(alias: Column, text: Column, category: Column, cap: int = config.INVENTORY_FACT_CHARS) -> Column:
    t = tx.norm_inline(text)
    short = F.when(F.length(t) <= cap, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, cap - 3)), F.lit("...")))
    tail = F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit(" | "), category)).otherwise("")
    return F.when(t != "", F.concat(F.lit("- ["), alias, F.lit("] "), short, tail))


def fact_inventory(facts: DataFrame, brand: str, order: list[str], header_chars: int, budget: int = config.INVENTORY_MAX_CHARS) -> DataFrame:
    """Inventory lines of a brand in order, up to the first that would pass the budget.

    ``order`` tells lines of a brand apart.  Running sums are taken partition by partition, and partitions that begin beyond the budget are
    left out, so no brand is sorted in one task (see prefix.py).
    """
    lines = facts.withColumn("line", fact_line(F.col("alias"), F.col("text"), F.col("category"))).filter("line IS NOT NULL")
    size = F.length("line") + 1
    sums = running_totals(lines, [brand], order, {"before": size, "earlier": F.lit(1)}, budget - header_chars)
    rows = sums.withColumn("line_no", (F.col("earlier") + 1).cast("int")).withColumn("total_chars", F.col("before") + size + header_chars)
    return rows.drop("before", "earlier").filter(F.col("total_chars") <= budget)


def fact_summary(docs: DataFrame, facts: DataFrame) -> DataFrame:
    f = facts.select("reference_id", "extraction_status", F.greatest(F.lit(0), F.coalesce(F.size("facts"), F.lit(0))).alias("facts_count"))
    return docs.select("reference_id", "brand").join(f, "reference_id", "left").na.fill(0, ["facts_count"])


def status_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy(F.coalesce("extraction_status", F.lit("none")).alias("status")).agg(
        F.count("*").alias("documents"), F.sum("facts_count").alias("facts")
    )


def fact_feedback(events: DataFrame) -> DataFrame:
    """Confirmed and rejected counts per fact set; every decision but 'confirmed' counts as rejected."""
    ok = F.col("decision") == "confirmed"
    return events.groupBy("reference_id").agg(
        F.sum(F.when(ok, 1).otherwise(0)).alias("confirmed"), F.sum(F.when(ok, 0).otherwise(1)).alias("rejected")
    )


def merge_facts(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest fact row per reference; a status update without facts keeps the facts already there."""
    both = base.unionByName(updates)
    latest = F.max_by(F.struct("extraction_status", "error_message"), "updated_at")
    facts = F.max_by(F.struct("facts", "model_used"), F.when(F.col("facts").isNotNull(), F.col("updated_at")))
    g = both.groupBy("reference_id").agg(latest.alias("s"), facts.alias("f"), F.max("updated_at").alias("updated_at"))
    return g.select("reference_id", "s.extraction_status", "s.error_message", "f.facts", "f.model_used", "updated_at")
