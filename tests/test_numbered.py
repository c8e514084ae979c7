"""Numbers of rows in an order, without one task for all of them."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark import plans
from loomspark.sources.shared import numbered


def test_numbers_equal_a_window_over_all_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "", "a", "10", "9", "é", *map(str, range(40))]), rng.choice([None, *range(30)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "id string, version long").repartition(7)
    want = df.withColumn("n", F.row_number().over(Window.orderBy(F.asc_nulls_last("id"), F.asc_nulls_last("version"))))
    order = lambda x: [tuple(r) for r in x.orderBy("n").collect()]
    assert order(numbered(df, ["id", "version"], "n")) == order(want)
    assert numbered(df.limit(0), ["id", "version"], "n").collect() == []


def test_ordinals_of_insertions_are_dense(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/conversations.parquet").count()
    got = sorted(r.ordinal for r in plans.QUERIES["memory_insert_outcomes"](spark, sf).select("ordinal").collect())
    assert got == [*range(1, n + 1), *range(1_000_000_001, 1_000_000_001 + n)]
