from marlstone.functions.settled import EVERY, spread


def test_rows_are_spread_by_their_number(spark):
    assert spread(spark.range(10 * EVERY).coalesce(1)).rdd.getNumPartitions() == 10
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
