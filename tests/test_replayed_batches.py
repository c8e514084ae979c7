"""Micro-batches that fail and are replayed, against redelivered events."""

import json

import pytest

from loomspark.streaming import ledger_stream as L


def _event(session, kind="session_start"):
    e = {"event_type": kind, "session_id": session, "project_name": "p", "current_working_directory": "/w", "timestamp": "2024-05-01T00:00:00.000Z"}
    return json.dumps(e | ({"hook_type": "", "data": {}} if kind == "observation" else {}))


def _batch(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "json string")


def _sessions(spark, target, table):
    return sorted(r.session_id for r in spark.read.parquet(f"{target}/{table}").collect())


def test_replayed_batch_leaves_each_row_once(spark, tmp_path):
    target, naps = str(tmp_path), []
    batch = _batch(spark, _event("a"), _event("b", "observation"), "{}")

    def failing(df, path):
        if "raw_observations" in path:
            raise OSError("the store is away")
        L._write(df, path)

    with pytest.raises(L.PersistError, match="raw_observations: store_error"):
        L.append_batch(target, write=failing, sleep=naps.append)(batch, 0)
    assert naps == [1.0, 1.0] and _sessions(spark, target, "session_events") == ["a"]
    L.append_batch(target)(batch, 0)
    assert _sessions(spark, target, "session_events") == ["a"] and _sessions(spark, target, "raw_observations") == ["b"]
    assert spark.read.parquet(f"{target}/quarantine").count() == 1
    # the same event in another batch is a delivery of its own
    L.append_batch(target)(_batch(spark, _event("a")), 1)
    rows = spark.read.parquet(f"{target}/session_events").collect()
    assert [r.session_id for r in rows] == ["a", "a"] and len({r.receipt_id for r in rows}) == 2 and {r.batch_id for r in rows} == {0, 1}
    got = {(r.batch_id, r["of"]): (r.outcome, r.n_rows, r.tries) for r in spark.read.parquet(f"{target}/outcomes").collect()}
    assert got[0, "raw_observations"] == ("persisted", 1, 1) and got[1, "quarantine"] == ("persisted", 0, 1)


def test_a_third_try_persists(spark, tmp_path):
    tries = []

    def flaky(df, path):
        tries.append(path)
        if len(tries) < 3:
            raise OSError
        L._write(df, path)

    assert L.persist(_batch(spark, "x"), f"{tmp_path}/t", flaky, lambda _: None) == ("persisted", 1, 3)


def test_other_rows_than_written_are_unconfirmed(spark, tmp_path):
    def losing(df, path):
        L._write(df.limit(1), path)

    assert L.persist(_batch(spark, "x", "y"), f"{tmp_path}/t", losing)[0] == "unconfirmed_write"
