"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import alignment, ann, exact_dedup, fingerprints, jaccard_join, lm, mixing, packing, pii, quality, suffix_dedup, toxicity, whitening
from claimloom.llm.common import WORD, table
from claimloom.session import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


@register(
    "op1_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
    sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def source_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s))
    return mixing.weighted_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})


@register(
    "op2_mixing",
    f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
    r AS (SELECT *, 3 * n / w AS ratio, coalesce(sum(3 * n) OVER p, 0)::BIGINT AS full_before, coalesce(sum(w) OVER p, 0)::BIGINT AS w_before,
      sum(n) OVER ()::BIGINT AS n_all, sum(w) OVER ()::BIGINT AS w_all FROM s
      WINDOW p AS (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT arg_min((n_all - full_before) / (w_all - w_before), (ratio, w_before)) AS level FROM r
      WHERE ratio >= (n_all - full_before) / (w_all - w_before)),
    t AS (SELECT source, n, least((3 * n)::DOUBLE, level * w) AS target, floor(least((3 * n)::DOUBLE, level * w) + 0.5)::BIGINT AS quota FROM r, l),
    c AS (SELECT d.doc_id, d.size, t.n, t.target, CASE WHEN t.n > 0 THEN t.quota // t.n ELSE 0 END AS copies,
      CASE WHEN t.n > 0 THEN t.quota % t.n ELSE 0 END AS rest,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{mixing.SEED}:' || d.doc_id), d.doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, n AS source_size, target, (copies * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM c""",
)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = durable(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("source").alias("sources"), size.alias("size")))
    sizes = {r.source: r.n for r in docs.groupBy(F.col("sources")[0].alias("source")).agg(F.sum("size").alias("n")).collect()}
    targets = source_targets(sizes)
    rows = [(s, n, targets[s]) for s, n in sizes.items()]
    by_source = spark.createDataFrame(rows, "source string, source_size long, target double")
    by_source = by_source.withColumn("pattern", F.to_json(F.array("source"))).drop("source")
    return mixing.mix(docs, targets).join(by_source, "pattern").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048), 2048)


@register("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0, 5)


@register("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 2, 4, 0.7)


@register("op4_ngram_jaccard")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


@register("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@register("op5_nearest_neighbours")
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@register("op8_pseudonyms")
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a user passes a secret key; this one only makes runs comparable
    return pii.pseudonymise(table(spark, sf_dir, "documents"), b"claimloom demonstration key")


@register("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


@register("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_next(table(spark, sf_dir, "documents"))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
