"""The ledger as a stream: JSON lines land in a folder, valid events are stored by kind.

Delivery is at least once and nothing is deduplicated: a redelivered event is a row of its
own, with its own receipt.  A replayed micro-batch is not a redelivery: each batch owns the
partition ``batch_id=N`` of every table and replaces it whole, so that a batch that fails
between two tables and runs again leaves each of its rows once.

A partition is written up to three times, a second apart, and then read again: its outcome is
persisted, store_error (every try failed) or unconfirmed_write (other rows than were written).
Both failures end the query; the batch is replayed when it starts again.  Outcomes are kept in a
table of their own.

Invalid rows go to a quarantine table with their fault.  There is no watermark: late events are
always taken and change a session's counts, which makes it eligible again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger

TRIES, BACKOFF_MS = 3, 1_000
PERSISTED, STORE_ERROR, UNCONFIRMED = "persisted", "store_error", "unconfirmed_write"


class PersistError(RuntimeError):
    def __init__(self, table: str, outcome: str) -> None:
        super().__init__(f"{table}: {outcome}")
        self.outcome = outcome


def source(spark: SparkSession, landing: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(landing).select(F.col("value").alias("json"))


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def persist(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = _write, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, int]:
    """(outcome, rows, tries) of replacing the table at ``path`` by ``df``."""
    rows = df.count()
    for n in range(1, TRIES + 1):
        try:
            write(df, path)
            break
        except Exception:  # whatever the store says: the try has failed
            if n == TRIES:
                return STORE_ERROR, rows, n
            sleep(BACKOFF_MS / 1000)
    stored = df.sparkSession.read.schema(df.schema).parquet(path).count()
    return (PERSISTED if stored == rows else UNCONFIRMED), rows, n


def append_batch(target: str, clock=F.current_timestamp, write: Callable[[DataFrame, str], None] = _write, sleep: Callable[[float], None] = time.sleep):
    """A ``foreachBatch`` function that stores a batch in three tables below ``target``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        checked = ledger.validate(batch).persist()
        try:
            events, observations = ledger.route(checked, clock())
            for table, rows in (("session_events", events), ("raw_observations", observations), ("quarantine", checked.filter("fault is not null").select("json", "fault"))):
                outcome, n, tries = persist(rows, f"{target}/{table}/batch_id={batch_id}", write, sleep)
                spark = batch.sparkSession
                spark.createDataFrame([(table, outcome, n, tries)], "table string, outcome string, n_rows long, tries int").coalesce(1).write.mode("overwrite").parquet(f"{target}/outcomes/batch_id={batch_id}/of={table}")
                if outcome != PERSISTED:
                    raise PersistError(table, outcome)
        finally:
            checked.unpersist()

    return run


def start(spark: SparkSession, landing: str, target: str, checkpoint: str, once: bool = True, clock=F.current_timestamp, every: str = "1 minute"):
    """Runs what has landed (``once``), or polls ``every`` minute."""
    w = source(spark, landing).writeStream.foreachBatch(append_batch(target, clock)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
