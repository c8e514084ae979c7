"""Ticks and reconciliation: runs converge, replays leave nothing twice."""

import time

from loomspark.streaming import sweeps


def test_ticks_run_the_job(spark, tmp_path):
    seen = []
    for _ in range(8):  # a run within a second of the last one has no tick
        if len(seen) < 2:
            sweeps.ticks(spark, seen.append, str(tmp_path / "c"), once=True).awaitTermination()
            time.sleep(1)
    assert seen == [0, 1]


def test_reconciliation_converges(spark, tmp_path):
    rows = [(f"m{i}", 1, "t", "text" * i, ["c"]) for i in range(5)]
    memories = lambda: spark.createDataFrame(rows, "id string, version long, title string, content string, concepts array<string>")
    path = str(tmp_path / "embeddings")
    spark.createDataFrame([("m0", 1, [1.0])], "id string, version long, embedding array<float>").write.parquet(f"{path}/tick=100")
    stored = lambda: spark.read.parquet(path)
    job = sweeps.reconcile_embeddings(memories, stored, path, lambda texts: [[float(len(x))] for x in texts], limit=3)
    job(0)
    job(0)  # a replay
    assert sorted(r.id for r in stored().collect()) == ["m0", "m1", "m2", "m3"]
    job(1)
    job(2)
    got = stored().collect()
    assert sorted((r.id, r.tick) for r in got) == [("m0", 100), ("m1", 0), ("m2", 0), ("m3", 0), ("m4", 1)]
    assert all(r.embedding for r in got)
