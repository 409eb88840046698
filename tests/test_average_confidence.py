from claimloom.operators import reports as rp


def test_average_confidence_does_not_depend_on_the_order_of_rows(spark):
    # 0.3 over eight rows is 3.75 percent, which rounds up; as doubles in this order the sum falls short of it
    values = [0.01, 0.02, 0.07, 0.01, 0.06, 0.05, 0.05, 0.03]
    for rows in (values, values[::-1], sorted(values)):
        df = spark.createDataFrame([(1, True, v) for v in rows] + [(1, False, 0.9)], "run int, matched boolean, match_confidence double").coalesce(1)
        assert rp.matching_stats(df, ["run"]).head().avg_confidence == 3.8
