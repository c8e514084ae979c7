"""Keys that many requests share: looked up right, and not in one task."""

from pyspark.sql import functions as F

from loomspark.operators.graph import flagged


def test_rows_of_a_frequent_key_are_spread(spark):
    rows = spark.range(40_000).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 4 == 0, "gone").when(F.col("id") % 4 == 1, "here").when(F.col("id") % 4 == 2, F.concat(F.lit("k"), F.col("id"))).alias("key"))
    ids = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("id")).unionByName(spark.createDataFrame([("here",), ("here",), (None,)], "id string"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        out = flagged(rows, "key", ids, "there", many=1000)
        assert out.columns == ["ordinal", "key", "there"]
        got = out.withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(got) == 40_000 and got.ordinal.is_unique
    want = (got.ordinal % 4 == 1) | ((got.ordinal % 4 == 2) & (got.ordinal < 20_000))
    assert (got.there.notna() == want).all()
    assert got.groupby("task").size().max() < 2 * 40_000 / 16
