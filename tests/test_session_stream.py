"""The queue against the stream for any cut into micro-batches; silence."""

import json
import random
import time

import pytest

from loomspark.operators.session_queue import SubmissionQueue, serve_all
from loomspark.streaming import session_stream

SCHEMA = "session_id string, seq long, kind string, ingested_ms long"


def _stream(spark, tmp_path, batches, capacity, silence_ms=86_400_000, wait=0):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", session_stream.PROVIDER)
    landing = tmp_path / "landing"
    landing.mkdir()
    got = []
    for n, batch in enumerate(batches):
        (landing / f"{n:03}.json").write_text("".join(json.dumps(dict(zip(("session_id", "seq", "kind", "ingested_ms"), r, strict=True))) + "\n" for r in batch))
        time.sleep(wait)
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(landing))
        out = session_stream.sessions(rows, capacity, silence_ms)
        out.writeStream.foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start().awaitTermination()
    return got


def test_queue_rules():
    q = SubmissionQueue(2)
    assert q.serve(1, "sent") == [] and q.serve(2, "observation") == [("start", 2), ("observation", 2)]
    assert q.serve(3, "observation") == [("observation", 3)] and q.serve(4, "observation") == [("overflow", 4)]
    assert q.serve(5, "sent") == [("sent:start", 2)] and q.serve(6, "observation") == [("overflow", 6)]
    assert q.serve(7, "sent") == [("sent:observation", 2)] and q.serve(8, "observation") == [("observation", 8)]
    assert q.serve(9, "start") == [] and q.serve(10, "end") == [("end", 10)] and q.serve(11, "observation") == []
    assert q.serve(12, "end") == [] and [q.serve(13, "sent")[0][0] for _ in range(3)] == ["sent:observation", "sent:observation", "sent:end"]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_for_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"s{rng.randint(0, 5)}", n, rng.choice(["observation"] * 6 + ["sent"] * 3 + ["start", "end"]), int(time.time() * 1000)) for n in range(150)]
    want = sorted(tuple(r) for r in serve_all(spark.createDataFrame(rows, SCHEMA), 3).collect())
    cuts = sorted(rng.sample(range(1, 150), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 150], strict=True)]
    assert sorted(_stream(spark, tmp_path, batches, 3)) == want
    assert {r[3] for r in want} >= {"overflow", "start", "end", "sent:observation"}


def test_silence_is_reported_once(spark, tmp_path):
    now = int(time.time() * 1000)
    batches = [[("a", 1, "observation", now), ("b", 1, "observation", now + 3_600_000)], [("b", 2, "sent", now)], [("b", 3, "sent", now)]]
    got = _stream(spark, tmp_path, batches, 9, silence_ms=1, wait=1)
    assert [(r[0], r[4]) for r in got if r[3] == "inactive"] == [("a", now)]
