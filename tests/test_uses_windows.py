from pyspark.sql import functions as F

from marlstone.operators import writing


def test_only_windows_that_can_be_first_are_looked_at(spark):
    text = "other " * 50 + "red apple " + "other " * 3 + "apple red red apple " + "other " * 50 + "red"
    rows = spark.createDataFrame([(text, ["red apple", "missing word"])], "t string, p array<string>")
    df = writing.close_variants(rows, "t", "p")
    assert "array_distinct(flatten(" in df._jdf.queryExecution().optimizedPlan().toString()  # words that begin or end such windows
    r = df.first()
    assert (r.matched, list(r.counts), r.total) == ("red apple", [3, 0], 3)
    none = writing.close_variants(rows.limit(1).select(F.lit("").alias("t"), "p"), "t", "p").first()
    assert (none.matched, list(none.counts), none.total) == (None, [0, 0], 0)
