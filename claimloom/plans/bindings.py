"""How the given tables become the library's domain tables, in Spark and in SQL.

The given texts hold almost no numbers, so statements get a numeric tail built from
their ids by the same expression on both sides.  Nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.plans.registry import fragment


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  A session may ask for documents to be dealt out further than their file splits
    (``claimloom.documents.partitions``, set where one file holds them all); others read them as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ways = spark.conf.get("claimloom.documents.partitions", None)
    return df.repartition(int(ways), "doc_id") if ways and name == "documents" else df


# The blank class of the text functions in the oracle's regex dialect.
SQL_BLANK = tx.BLANK


def sql_inline(col: str) -> str:
    return f"trim(regexp_replace({col}, '{SQL_BLANK}+', ' ', 'g'))"


def documents(spark, d) -> DataFrame:
    """reference_id, brand, content_text, page_count, display_alias, filename."""
    t = table(spark, d, "documents")
    return t.select(
        F.col("doc_id").alias("reference_id"),
        F.col("source").alias("brand"),
        F.col("lang"),
        F.col("text").alias("content_text"),
        F.greatest(F.lit(1), F.ceil(F.length("text") / 3000.0)).cast("long").alias("page_count"),
        F.concat(F.lit("Ref "), F.col("doc_id").cast("string")).alias("display_alias"),
    )


fragment(
    "refs",
    """SELECT doc_id AS reference_id, source AS brand, lang, text AS content_text,
    greatest(1, ceil(length(text) / 3000.0))::BIGINT AS page_count, 'Ref ' || doc_id AS display_alias FROM documents""",
)


def lines(spark, d) -> DataFrame:
    """doc_id, line_no, line: non-blank lines, blanks collapsed."""
    t = table(spark, d, "documents")
    exploded = t.select("doc_id", "source", F.posexplode(F.transform(F.split("text", "\n"), tx.norm_inline)).alias("line_no", "line"))
    return exploded.filter("line <> ''")


fragment(
    "raw_lines",
    """SELECT doc_id, source, unnest(range(len(l)))::INT AS line_no, unnest(l) AS raw
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)""",
)
fragment(
    "lines",
    f"SELECT doc_id, source, line_no, {sql_inline('raw')} AS line FROM raw_lines WHERE {sql_inline('raw')} <> ''",
    "raw_lines",
)


def statements(spark, d) -> DataFrame:
    """Lines with a numeric or clinical part added by position: doc_id, line_no, page, stmt."""
    k = F.col("doc_id") * 7 + F.col("line_no")
    s = lambda c: c.cast("string")
    stmt = (
        F.when(
            k % 7 == 0,
            F.concat("line", F.lit(" Treatment reduced relapse by "), s(k % 97), F.lit("% vs placebo (p<0.0"),
                     s(k % 9 + 1), F.lit(").")),
        )
        .when(
            k % 7 == 1,
            F.concat("line", F.lit(" Observed in n="), s(k % 400 + 20), F.lit(" patients, HR 0."), s(k % 90 + 10), F.lit(".")),
        )
        .when(k % 7 == 2, F.concat(F.lit("The primary endpoint improved in "), s(k % 89), F.lit(" adults: "), F.col("line")))
        .when(k % 7 == 3, F.concat(F.lit("Adverse events led to discontinuation of the 5 mg dose: "), F.col("line")))
        .otherwise(F.col("line"))
    )
    return lines(spark, d).select(
        "doc_id", "source", "line_no", (F.floor(F.col("line_no") / 10) + 1).cast("int").alias("page"), stmt.alias("stmt")
    )


fragment(
    "statements",
    """SELECT doc_id, source, line_no, (line_no // 10 + 1)::INT AS page,
    CASE (doc_id * 7 + line_no) % 7
      WHEN 0 THEN line || ' Treatment reduced relapse by ' || ((doc_id * 7 + line_no) % 97) || '% vs placebo (p<0.0' || ((doc_id * 7 + line_no) % 9 + 1) || ').'
      WHEN 1 THEN line || ' Observed in n=' || ((doc_id * 7 + line_no) % 400 + 20) || ' patients, HR 0.' || ((doc_id * 7 + line_no) % 90 + 10) || '.'
      WHEN 2 THEN 'The primary endpoint improved in ' || ((doc_id * 7 + line_no) % 89) || ' adults: ' || line
      WHEN 3 THEN 'Adverse events led to discontinuation of the 5 mg dose: ' || line
      ELSE line END AS stmt
    FROM lines""",
    "lines",
)


def sentence_rows(spark, d) -> DataFrame:
    """Sentences of the statements: doc_id, page, ord, text."""
    s = statements(spark, d).select("doc_id", "page", "line_no", F.posexplode(tx.sentences(F.col("stmt"))).alias("pos", "text"))
    return s.select("doc_id", "page", (F.col("line_no").cast("long") * 10000 + F.col("pos")).alias("ord"), "text")


fragment(
    "sentence_rows",
    """SELECT doc_id, page, line_no::BIGINT * 10000 + pos AS ord, text FROM (
      SELECT doc_id, page, line_no, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (
        SELECT doc_id, page, line_no, list_filter(list_transform(string_split(
          regexp_replace(stmt, '([.!?]) +([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), x -> trim(x)), x -> x <> '') AS l
        FROM statements))""",
    "statements",
)


def page_claims(spark, d) -> DataFrame:
    """Claims read from pages: one per sentence, with position, region, reference numbers and confidence."""
    s = sentence_rows(spark, d)
    n = F.length("text")
    return s.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string")).alias("claim_id"),
        "doc_id", "page", "ord", "text",
        F.when(n % 5 == 0, "notes").otherwise("slide").alias("region"),
        F.when(n % 4 == 0, F.array((n % 3 + 1).cast("int"), (n % 7 + 4).cast("int")))
        .otherwise(F.array().cast("array<int>")).alias("ref_numbers"),
        ((F.col("ord") * 37 + F.col("doc_id")) % 101 / 100.0).alias("confidence"),
        ((F.col("ord") * 7) % 100).cast("double").alias("x"),
        ((F.col("ord") * 13 + F.col("doc_id")) % 100).cast("double").alias("y"),
    )


fragment(
    "page_claims",
    """SELECT doc_id || '-' || ord AS claim_id, doc_id, page, ord, text,
    CASE WHEN length(text) % 5 = 0 THEN 'notes' ELSE 'slide' END AS region,
    CASE WHEN length(text) % 4 = 0 THEN [length(text) % 3 + 1, length(text) % 7 + 4] ELSE [] END AS ref_numbers,
    (ord * 37 + doc_id) % 101 / 100.0::DOUBLE AS confidence,
    ((ord * 7) % 100)::DOUBLE AS x, ((ord * 13 + doc_id) % 100)::DOUBLE AS y
    FROM sentence_rows""",
    "sentence_rows",
)


def claims(spark, d) -> DataFrame:
    """User turns as claims to match: claim_id, brand, page, text, confidence."""
    return claims_of(table(spark, d, "conversations"))


def claims_of(turns: DataFrame) -> DataFrame:
    t = turns.filter(F.col("role") == "user")
    tail = F.when(
        F.col("conv_id") % 2 == 0,
        F.concat(F.lit(" Relapse fell by "), (F.col("conv_id") % 97).cast("string"), F.lit("% (p<0.0"),
                 (F.col("conv_id") % 9 + 1).cast("string"), F.lit(").")),
    ).otherwise("")
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("brand"),
        (F.col("turn") + 1).cast("int").alias("page"),
        F.concat(F.col("text"), tail).alias("text"),
        (F.lit(0.5) + F.col("conv_id") % 50 / 100.0).alias("confidence"),
    )


fragment(
    "claims",
    """SELECT conv_id * 1000 + turn AS claim_id, 'src' || (conv_id % 20) AS brand, (turn + 1)::INT AS page,
    text || CASE WHEN conv_id % 2 = 0 THEN ' Relapse fell by ' || (conv_id % 97) || '% (p<0.0' || (conv_id % 9 + 1) || ').' ELSE '' END AS text,
    0.5::DOUBLE + conv_id % 50 / 100.0::DOUBLE AS confidence
    FROM conversations WHERE role = 'user'""",
)


def doc_pages(spark, d) -> DataFrame:
    """Documents cut in 3000-character pages: doc_id, brand, page, start_char, end_char, page_text."""
    t = table(spark, d, "documents").filter(F.length("text") > 0)
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(3000))
    p = t.select("doc_id", F.col("source").alias("brand"), "text", F.posexplode(starts).alias("i", "start_char"))
    body = F.substring(F.col("text"), F.col("start_char") + 1, F.lit(3000))
    return p.select(
        "doc_id", "brand", (F.col("i") + 1).alias("page"), "start_char",
        (F.col("start_char") + F.length(body)).alias("end_char"), body.alias("page_text"),
    )


fragment(
    "doc_pages",
    """SELECT doc_id, brand, (s // 3000 + 1)::INT AS page, s AS start_char, (s + length(substring(text, s + 1, 3000)))::INT AS end_char,
    substring(text, s + 1, 3000) AS page_text FROM (
      SELECT doc_id, source AS brand, text, unnest(range(0, length(text), 3000))::INT AS s FROM documents)""",
)


def passages(spark, d) -> DataFrame:
    """Pages with a numeric tail and a vector: passage_id, reference_id, brand, page, text, embedding."""
    p = doc_pages(spark, d)
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    total = table(spark, d, "embeddings").agg(F.count("*")).scalar()
    k = F.col("doc_id") * 7 + F.col("page")
    numbered = p.select(
        (F.col("doc_id") * 1000 + F.col("page")).alias("passage_id"),
        F.col("doc_id").alias("reference_id"), "brand", "page", "start_char", "end_char",
        F.concat("page_text", F.lit(" Relapse fell by "), (k % 97).cast("string"), F.lit("% (p<0.0"),
                 (k % 9 + 1).cast("string"), F.lit(").")).alias("passage_text"),
        (F.col("doc_id") * 31 + F.col("page")).alias("slot"),
    )
    return numbered.withColumn("vec_id", F.col("slot") % total).join(vectors, "vec_id").drop("slot", "vec_id")


fragment(
    "passages",
    """SELECT doc_id * 1000 + page AS passage_id, doc_id AS reference_id, brand, page, start_char, end_char,
    page_text || ' Relapse fell by ' || ((doc_id * 7 + page) % 97) || '% (p<0.0' || ((doc_id * 7 + page) % 9 + 1) || ').' AS passage_text,
    embedding::DOUBLE[] AS embedding
    FROM doc_pages JOIN embeddings ON vec_id = (doc_id * 31 + page) % (SELECT count(*) FROM embeddings)""",
    "doc_pages",
)


def claim_vectors(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """Claims (all, or the given ones) with a vector."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    total = table(spark, d, "embeddings").agg(F.count("*")).scalar()
    c = (claims(spark, d) if rows is None else rows).withColumn("slot", F.floor(F.col("claim_id") / 1000) * 17 + F.col("page"))
    return c.withColumn("vec_id", F.col("slot") % total).join(vectors, "vec_id").drop("slot", "vec_id")


fragment(
    "claim_vectors",
    """SELECT claims.*, embedding::DOUBLE[] AS embedding FROM claims
    JOIN embeddings ON vec_id = ((claim_id // 1000) * 17 + page) % (SELECT count(*) FROM embeddings)""",
    "claims",
)


def stmt_pages(spark, d) -> DataFrame:
    """Statements as page texts; one group is one page."""
    g = statements(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "stmt"))).alias("l"))
    return g.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["stmt"]), "\n").alias("text"))


def fact_sets(spark, d) -> DataFrame:
    """Per document, the facts mined from all its pages, with a vector: reference_id, brand, facts, embedding."""
    from claimloom.operators.facts import mine_facts

    order = F.struct(F.length("fact_id").alias("n"), "fact_id", "text", "page")
    # one group is the facts of one document, at most ten a page
    sets = mine_facts(stmt_pages(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("f"))
    facts = F.transform("f", lambda f: F.struct(f["text"].alias("text"), f["page"].alias("page")))
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    total = table(spark, d, "embeddings").agg(F.count("*")).scalar()
    brands = table(spark, d, "documents").select("doc_id", F.col("source").alias("brand"))
    return (
        sets.join(brands, "doc_id").select(F.col("doc_id").alias("reference_id"), "brand", facts.alias("facts"))
        .withColumn("vec_id", (F.col("reference_id") * 31 + 1) % total)
        .join(vectors, "vec_id")
        .drop("vec_id")
    )


fragment(
    "fact_sets",
    """SELECT s.*, embedding::DOUBLE[] AS embedding FROM (
      SELECT doc_id AS reference_id, source AS brand, list({'text': f.text, 'page': page} ORDER BY fact_no) AS facts
      FROM facts f JOIN documents USING (doc_id) GROUP BY doc_id, source) s
    JOIN embeddings ON vec_id = (reference_id * 31 + 1) % (SELECT count(*) FROM embeddings)""",
    "facts",
)
