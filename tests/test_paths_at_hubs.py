"""Path searches for a table of pairs: counting without making what is not kept."""

import random
import threading

from pyspark.sql import functions as F

from loomspark.operators.graph import find_paths, find_paths_many


def test_work_of_multigraphs_equals_single_searches(spark):
    rng = random.Random(7)
    rows = [(f"a{rng.randrange(25)}", x, rng.choice(["uses", "related_to"]), y) for x, y in ((f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(30))]
    rows += [("loop", "n1", "uses", "n1"), ("open", "n1", "uses", None)]
    a = spark.createDataFrame(rows, "id string, subject string, relation string, object string")
    pairs = [(i, f"n{i}", f"n{(i * 3 + 1) % 7}") for i in range(7)]
    pairs = [p for p in pairs if p[1] != p[2]]
    for most in (12, 10_000):
        many = find_paths_many(a, spark.createDataFrame(pairs, "request_id int, start string, end string"), "either", 3, max_work=most).collect()
        for i, start, end in pairs:
            got = sorted(tuple(r)[1:] for r in many if r.request_id == i)
            one = find_paths(a, start, end, "either", 3, max_work=most).collect()
            assert [(r[0], r[1], r[5], r[6]) for r in got] == sorted((r[0], r[1], r[5], r[6]) for r in one)
            assert sorted(r[2:4] for r in got) == sorted(tuple(r)[2:4] for r in one)


def test_requests_at_a_hub(spark):
    """n * n states would take very long to be made and counted: jobs are cancelled after two minutes."""
    n = 250_000
    leaf = F.concat(F.lit("leaf:"), F.col("id"))
    a = spark.range(n).select(F.col("id").cast("string").alias("id"), leaf.alias("subject"), F.lit("part_of").alias("relation"), F.lit("hub").alias("object"))
    r = spark.range(n).select(F.col("id").alias("request_id"), leaf.alias("start"), F.lit("nowhere").alias("end"))
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = find_paths_many(a, r, "either", 3, max_work=75).groupBy("outcome", "work").count().collect()
    finally:
        late.cancel()
    assert [tuple(x) for x in got] == [("work_exhausted", 76, n)]
