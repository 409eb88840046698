"""Marks of a block spare its sentences the patterns that cannot occur in them."""

from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import facts as fc


def test_sentences_score_alike_with_the_marks_of_their_block(spark):
    blocks = ["Dose was 5 mg vs. placebo in 10 adults. The receptor binds well. Nothing here at all.", "p<0.05 vs. (n=12) patients! HR 0.7 in phase II trial? Approved by the FDA.",
              "vs. A label was vs. (treated) cohort. † improved baseline with 3 ci.", "plain words only"]
    df = spark.createDataFrame([(b,) for b in blocks], "block string")
    rows = df.select("block", fc.word_marks(F.col("block")).alias("marks"), F.explode(F.concat(F.array("block"), tx.sentences(F.col("block")))).alias("s"))
    got = rows.select(fc.fact_score(F.col("s")).alias("whole"), fc.fact_score(F.col("s"), F.col("marks")).alias("spared")).collect()
    assert len(got) > 12 and all(r.whole == r.spared for r in got) and max(r.whole for r in got) >= 6
    pages = spark.createDataFrame([(1, 1, b) for b in blocks], "doc_id long, page int, text string")
    for r in fc.fact_segments(fc.fact_blocks(pages)).withColumn("again", fc.fact_score(F.col("text"))).collect():
        assert r.score == r.again
