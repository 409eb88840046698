"""Versions, lineage, retention, patterns and export (survey group V)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as tx
from claimloom.operators import topk
from claimloom.operators.joins import salted_join
from claimloom.session import durable

# ---- versions ----


def number_versions(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Number new snapshots per document after the highest number already stored."""
    top = existing.groupBy("document_hash").agg(F.max("version_number").alias("_top"))
    n = F.row_number().over(Window.partitionBy("document_hash").orderBy(*order))
    rows = new.withColumn("_n", n).join(top, "document_hash", "left")
    return rows.withColumn("version_number", F.coalesce("_top", F.lit(0)) + F.col("_n")).drop("_top", "_n")


def latest_version(versions: DataFrame, brand: str | None = None) -> DataFrame:
    """Latest snapshot of every document (of one brand where given); only keys and numbers are shuffled."""
    rows = versions if brand is None else versions.filter(F.col("brand_id") == brand)
    top = rows.groupBy("document_hash").agg(F.max("version_number").alias("version_number"))
    return rows.join(top, ["document_hash", "version_number"], "left_semi")


def version_at(versions: DataFrame, number: int) -> DataFrame:
    return versions.filter(F.col("version_number") == number)


def latest_per_document(versions: DataFrame) -> DataFrame:
    """Latest version per brand and document; both the maximum and the row must belong to the brand."""
    top = versions.groupBy("brand_id", "document_hash").agg(F.max("version_number").alias("version_number"))
    return versions.join(top, ["brand_id", "document_hash", "version_number"], "left_semi")


def diff_versions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edits between two snapshots: keys, annotation_id, edit_type.  Columns: x, y, refs."""
    a = old.select(*keys, "annotation_id", F.struct("x", "y", "refs").alias("before"))
    c = new.select(*keys, "annotation_id", F.struct("x", "y", "refs").alias("after"))
    both = a.join(c, [*keys, "annotation_id"], "full_outer")
    b, n = F.col("before"), F.col("after")
    moved = (b["x"] != n["x"]) | (b["y"] != n["y"])
    grown = F.size(n["refs"]) > F.size(b["refs"])
    changed = ~F.coalesce(F.array_sort(b["refs"]) == F.array_sort(n["refs"]), F.lit(False))
    kinds = (
        F.when(b.isNull(), F.array(F.lit("add_missed")))
        .when(n.isNull(), F.array(F.lit("delete")))
        .otherwise(
            F.array_compact(F.array(F.when(moved, "move"), F.when(grown, "ref_add").when(changed, "ref_change")))
        )
    )
    return both.select(*keys, "annotation_id", F.explode(kinds).alias("edit_type"))


# ---- lineage ----


def latest_edges(edges: DataFrame) -> DataFrame:
    """Latest lineage edge with a parent per document."""
    rows = edges.filter(F.col("parent_hash").isNotNull())
    best = rows.groupBy("document_hash").agg(F.max_by(F.struct("parent_hash", "similarity_score"), F.struct("created_at", "edge_id")).alias("e"))
    return best.select("document_hash", "e.parent_hash", "e.similarity_score")


def children(edges: DataFrame) -> DataFrame:
    """Children per parent, newest first."""
    w = Window.partitionBy("parent_hash").orderBy(F.desc("created_at"), F.desc("edge_id"))
    rows = edges.filter(F.col("parent_hash").isNotNull())
    return rows.select("parent_hash", "document_hash", F.row_number().over(w).alias("child_no"))


def ancestors(edges: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All ancestors with their depth: document_hash, ancestor, depth; of ``documents`` (document_hash) only, where given.

    Each round doubles the reach: a jump table holds every document's ancestor 1, 2, 4, ... steps up, and the ancestors found so
    far jump once.  Rounds end when nothing new is found, so chains may be of any length and cycles end; a
    document is not its own ancestor.
    """
    jump = durable(latest_edges(edges).select(F.col("document_hash").alias("at"), F.col("parent_hash").alias("to")))
    first = jump.select(F.col("at").alias("document_hash"), F.col("to").alias("ancestor"), F.lit(1).alias("depth"))
    if documents is not None:
        first = first.join(documents.select("document_hash").distinct(), "document_hash", "left_semi")
    reach = durable(first.filter(~F.col("document_hash").eqNullSafe(F.col("ancestor"))))
    step = 1
    while True:
        far = reach.join(jump, F.col("ancestor") == F.col("at")).select("document_hash", F.col("to").alias("ancestor"), (F.col("depth") + step).alias("depth"))
        far = far.filter("document_hash <> ancestor").groupBy("document_hash", "ancestor").agg(F.min("depth").alias("depth"))
        grown = durable(far.join(reach.select("document_hash", "ancestor"), ["document_hash", "ancestor"], "left_anti"))
        if grown.isEmpty():
            return reach
        reach = durable(reach.unionByName(grown))
        on = jump.select(F.col("at").alias("to"), F.col("to").alias("next"))
        jump = durable(jump.join(on, "to").select("at", F.col("next").alias("to")))
        step *= 2


def lineage_by_brand(edges: DataFrame) -> DataFrame:
    """The edges of every brand, newest first (a sort by range; no brand is gathered in one task)."""
    return edges.filter(F.col("brand_id").isNotNull()).orderBy("brand_id", F.desc("created_at"), F.desc("edge_id"))


# ---- page similarity ----


def page_words(pages: DataFrame, text_col: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.col(text_col)), tx.BLANK + "+"), lambda w: F.length(w) > 2)
    return pages.withColumn("words", F.array_distinct(words))


def _page_similarity(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared > 0, shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def compare_pages(pairs: DataFrame, pages: DataFrame, small: int = 256) -> DataFrame:
    """Best old page per new page of a lineage pair, the first of equally similar ones; null where no word is shared.

    pairs: old_doc, new_doc; pages: doc_id, page, page_text.  Documents of few pages (at most ``small`` page pairs) are compared page by
    page; those of many find the best page through their rarer words (see similar_pages).
    """
    words = page_words(pages, "page_text").select("doc_id", "page", "words")
    counts = words.groupBy("doc_id").agg(F.count("*").alias("n"))
    sized = pairs.join(counts.select(F.col("doc_id").alias("new_doc"), F.col("n").alias("n_new")), "new_doc").join(
        counts.select(F.col("doc_id").alias("old_doc"), F.col("n").alias("n_old")), "old_doc", "left").na.fill(0, ["n_old"])
    sized = sized.withColumn("many", F.col("n_new") * F.col("n_old") > small)
    new = sized.join(words.select(F.col("doc_id").alias("new_doc"), F.col("page").alias("new_page"), F.col("words").alias("nw")), "new_doc")
    old = words.select(F.col("doc_id").alias("old_doc"), F.col("page").alias("old_page"), F.col("words").alias("ow"))
    both = new.filter(~F.col("many")).join(old, "old_doc", "left")
    scored = both.withColumn("similarity", F.coalesce(_page_similarity("nw", "ow"), F.lit(0.0)))
    best = scored.groupBy("old_doc", "new_doc", "new_page").agg(
        F.max("similarity").alias("similarity"),
        F.max_by("old_page", F.struct("similarity", -F.col("old_page"))).alias("old_page"),
    )
    best = best.withColumn("old_page", F.when(F.col("similarity") > 0, F.col("old_page")))
    large = durable(new.filter("many").select("old_doc", "new_doc", "new_page", "nw"))
    if large.isEmpty():
        return best
    needles, postings, score = similar_pages(large, old)
    found = topk.best(needles, postings, score, 1, ["old_doc"], combine="each").select("query_id.*", F.col("score").alias("s"), F.col("item").alias("old_page"))
    rows = large.drop("nw").join(found, ["old_doc", "new_doc", "new_page"], "left")
    return best.unionByName(rows.select("old_doc", "new_doc", "new_page", F.coalesce("s", F.lit(0.0)).alias("similarity"), "old_page"))


def similar_pages(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """Needles, postings and score for the early-terminating search of the most similar old page (see topk.py).

    A page first met at the j-th rarest of the n words of a new page shares at most n - j of them, and its similarity is at most that share.
    """
    asked = new.filter(F.size("nw") > 0).select(F.struct("old_doc", "new_doc", "new_page").alias("query_id"), "old_doc", "nw")
    weight = (1.0 / F.size("nw")).alias("weight")
    needles = asked.select("query_id", "old_doc", weight, F.explode("nw").alias("needle")).withColumn("part", F.col("needle"))
    stored = old.join(new.select("old_doc").distinct(), "old_doc", "left_semi")
    postings = durable(stored.select("old_doc", F.explode("ow").alias("needle"), F.col("old_page").alias("item")))

    def score(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(asked, "query_id").join(stored.withColumnRenamed("old_page", "item"), ["old_doc", "item"])
        return rows.withColumn("score", _page_similarity("nw", "ow")).filter(F.col("score") > 0)

    return needles, postings, score


def carry_forward(matches: DataFrame, annotations: DataFrame, threshold: float = config.CARRY_FORWARD) -> DataFrame:
    """Annotations of old pages carried to the new pages they match, flagged."""
    same = matches.filter(F.col("similarity") >= threshold).select("old_doc", "new_doc", "new_page", "old_page")
    a = annotations.withColumnRenamed("doc_id", "old_doc").withColumnRenamed("page", "old_page")
    return same.join(a, ["old_doc", "old_page"]).withColumn("carried", F.lit(True))


def document_similarity(matches: DataFrame) -> DataFrame:
    return matches.groupBy("old_doc", "new_doc").agg(F.avg("similarity").alias("similarity"), F.count("*").alias("pages"))


# ---- patterns ----


def pattern_strength(events: DataFrame, keys: list[str], order: list[str], slice_col: Column | None = None) -> DataFrame:
    """Strength of a pattern after signed steps that never go below zero.

    The clamped walk ends at S - min(0, lowest prefix sum), S being the plain sum.  A slice (a day, an hour)
    cuts a long history first: each slice gives its sum and lowest prefix, and the slices are combined in order.
    """
    part = slice_col if slice_col is not None else F.lit(0)
    rows = events.withColumn("_slice", part)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("_p", F.sum("delta").over(w)).groupBy(*keys, "_slice").agg(
        F.sum("delta").alias("_s"), F.min("_p").alias("_low"), F.count("*").alias("_n")
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    total = placed.groupBy(*keys).agg(F.sum("_s").alias("s"), F.min(F.col("_base") + F.col("_low")).alias("low"), F.sum("_n").alias("n_events"))
    return total.select(*keys, (F.col("s") - F.least(F.lit(0), F.col("low"))).alias("strength"), "n_events")


def patterns_for(patterns: DataFrame, min_strength: int = 1, top: int = 50) -> DataFrame:
    w = Window.partitionBy("brand_id").orderBy(F.desc("strength"), "pattern_type", "pattern")
    rows = patterns.filter(F.col("strength") >= min_strength)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def patterns_of_type(patterns: DataFrame, pattern_type: str) -> DataFrame:
    """Patterns of one type that have any strength, without a limit."""
    return patterns.filter((F.col("pattern_type") == pattern_type) & (F.col("strength") > 0))


# ---- results kept between runs ----


def reference_fingerprint(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Fixed-size, order-free fingerprint of a reference list (id, fact count, status).

    Two halves of a digest per entry are combined by xor, so a brand of any size is folded by partial
    aggregation instead of building one string of all its ids.
    """
    entry = F.concat_ws(
        ":", F.col("reference_id").cast("string"), F.coalesce(F.col("facts_count"), F.lit(0)).cast("string"),
        F.coalesce(F.col("extraction_status"), F.lit("")),
    )
    digest = F.sha2(entry, 256)

    def half(at: int) -> Column:
        return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")

    g = refs.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(half(1)).alias("a"), F.bit_xor(half(16)).alias("b"))
    return g.select(*keys, F.concat_ws("-", *[F.col(c).cast("string") for c in ("n", "a", "b")]).alias("fingerprint"))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def reuse_results(inputs: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Inputs with an unexpired earlier result, and the inputs still to compute."""
    valid = results.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    hits = salted_join(inputs, valid.select("cache_key", "payload"), ["cache_key"], ["input_id"])
    rest = salted_join(inputs, valid.select("cache_key"), ["cache_key"], ["input_id"], "left_anti")
    return hits, rest


def prune_results(results: DataFrame, now: Column, max_rows: int = config.CACHE_MAX_ROWS) -> DataFrame:
    """Rows that stay: not expired, and among the most recently used."""
    live = results.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return live.orderBy(F.desc("last_accessed_at"), F.desc("id")).limit(max_rows)


def merge_results(base: DataFrame, updates: DataFrame, ttl_days: int = config.CACHE_TTL_DAYS) -> DataFrame:
    """Upsert by cache key, last write wins, new expiry from the write time."""
    expiry = F.when(F.lit(ttl_days) > 0, F.col("written_at") + F.make_interval(days=F.lit(ttl_days)))
    new = updates.withColumn("expires_at", expiry)
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    cols = [c for c in base.columns if c != "cache_key"]
    last = both.groupBy("cache_key").agg(F.max_by(F.struct(*cols), F.struct("_new", "written_at", "id")).alias("r"))
    return last.select("cache_key", *[F.col(f"r.{c}").alias(c) for c in cols])


# ---- library changes ----


def apply_library_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Soft delete, restore (clears the folder), move and purge events applied to the library table.

    changes: reference_id, seq, op, folder_id, at.
    """
    op = F.col("op")
    trashing, placing = op.isin("delete", "restore"), op.isin("move", "restore")
    folded = changes.groupBy("reference_id").agg(
        F.max_by(F.struct("op", "at"), F.when(trashing, F.col("seq"))).alias("t"),
        F.max_by(F.struct("op", "folder_id"), F.when(placing, F.col("seq"))).alias("p"),
        F.max((op == "purge").cast("int")).alias("purged"),
    )
    j = docs.join(folded.withColumnRenamed("reference_id", "_r"), F.col("reference_id") == F.col("_r"), "left").drop("_r")
    j = j.filter(F.coalesce("purged", F.lit(0)) == 0)
    deleted = F.when(F.col("t.op") == "delete", F.col("t.at")).when(F.col("t.op") == "restore", None).otherwise(F.col("deleted_at"))
    folder = F.when(F.col("p.op") == "move", F.col("p.folder_id")).when(F.col("p.op") == "restore", None).otherwise(F.col("base_folder"))
    return (
        j.withColumnRenamed("folder_id", "base_folder").withColumn("deleted_at", deleted).withColumn("folder_id", folder)
        .drop("t", "p", "purged", "base_folder")
    )


def active_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("cleared_at").isNull())


def clear_sessions(sessions: DataFrame, brand: int, at: Column) -> DataFrame:
    """Soft clear of a brand's active sessions."""
    hit = (F.col("brand_id") == brand) & F.col("cleared_at").isNull()
    return sessions.withColumn("cleared_at", F.when(hit, at).otherwise(F.col("cleared_at")))


# ---- export ----


def export_rows(claims: DataFrame, references: DataFrame, evidence: DataFrame) -> DataFrame:
    """Approved claims with their notation lines: accepted evidence, else locator, else citation text.

    claims: claim_id, status, page, x, y, global_spot, text; references: claim_id, pos, reference_id, number, locator,
    citation_text; evidence: claim_id, reference_id, seq, location_annotation.
    """
    approved = claims.filter(F.col("status") == "approved")
    refs = references.join(approved.select("claim_id"), "claim_id", "left_semi").withColumn(
        "n_refs", F.count("*").over(Window.partitionBy("claim_id"))
    )
    ev = evidence.select("claim_id", "reference_id", "seq", tx.norm_inline(F.col("location_annotation")).alias("line")).filter("line <> ''")
    first = ev.groupBy("claim_id", "reference_id", F.lower("line").alias("k")).agg(F.min(F.struct("seq", "line")).alias("e"))
    direct = refs.join(first, ["claim_id", "reference_id"]).select("claim_id", "pos", "n_refs", "number", "e.seq", "e.line")
    other = refs.join(ev.select("claim_id", "reference_id").distinct(), ["claim_id", "reference_id"], "left_anti")
    fallback = F.coalesce(F.nullif(tx.norm_inline(F.col("locator")), F.lit("")), F.nullif(tx.norm_inline(F.col("citation_text")), F.lit("")))
    indirect = other.select("claim_id", "pos", "n_refs", "number", F.lit(0).cast("long").alias("seq"), fallback.alias("line")).filter("line IS NOT NULL")
    lines = direct.withColumn("seq", F.col("seq").cast("long")).unionByName(indirect)
    head = F.row_number().over(Window.partitionBy("claim_id", "pos").orderBy("seq")) == 1
    numbered = lines.withColumn("head", head).withColumn(
        "line",
        F.when(F.col("head") & (F.col("n_refs") > 1) & F.col("number").isNotNull(), F.concat(F.col("number").cast("string"), F.lit(". "), "line"))
        .otherwise(F.col("line")),
    )
    unique = numbered.groupBy("claim_id", F.lower("line").alias("k")).agg(F.min(F.struct("pos", "seq", "line")).alias("u"))
    order = Window.partitionBy("claim_id").orderBy("u.pos", "u.seq", "k")
    final = unique.select("claim_id", F.row_number().over(order).alias("line_no"), F.col("u.line").alias("notation_line"))
    spot = F.coalesce("global_spot", F.lit(False))
    side = F.when(spot | F.col("x").isNull() | (F.col("x") >= 50), "right").otherwise("left")
    y = F.when(F.col("y").isNotNull(), F.greatest(F.lit(2.0), F.least(F.lit(98.0), F.col("y")))).otherwise(F.when(spot, 15.0).otherwise(50.0))
    return approved.select(
        "claim_id", F.greatest(F.lit(1), F.coalesce("page", F.lit(1))).alias("page"), spot.alias("global_spot"), side.alias("target_side"),
        y.alias("target_y_pct"), tx.norm_inline(F.col("text")).alias("claim_text"),
    ).join(final, "claim_id")


def carry_status(new: DataFrame, saved: DataFrame, prefix: int = 60) -> DataFrame:
    """Reviewer states of the latest saved snapshot carried to re-extracted claims by page and text start."""
    key = F.substring("text", 1, prefix)
    states = (
        saved.filter(F.col("status").isNotNull() & (F.col("status") != "pending"))
        .groupBy("document_hash", "page", key.alias("_k")).agg(F.max_by("status", "ord").alias("_status"))
    )
    rows = new.withColumn("_k", key).join(states, ["document_hash", "page", "_k"], "left")
    return rows.withColumn("status", F.coalesce("_status", "status")).drop("_k", "_status")


MATCH_FIELDS = ("matched", "match_confidence", "match_tier", "reference_id", "match_reasoning")


def merge_matches(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """Replace the five match fields of claims that have a match row; nothing else changes."""
    m = matches.select("claim_id", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_{f}") for f in MATCH_FIELDS])
    rows = claims.join(m, "claim_id", "left")
    for f in MATCH_FIELDS:
        rows = rows.withColumn(f, F.when(F.col("_hit"), F.col(f"_{f}")).otherwise(F.col(f)))
    return rows.drop("_hit", *[f"_{f}" for f in MATCH_FIELDS])
