"""Jobs that run every minute: ticks as a stream, and the reconciliation of embeddings.

A tick is a micro-batch of a rate source; its number is the job's argument, so that a tick that is
replayed after a failure runs under the same number.  Jobs are written to converge: what an
earlier run has stored is not made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import limits
from ..operators import memory
from .ledger_stream import PERSISTED, PersistError, persist


def ticks(spark: SparkSession, job: Callable[[int], None], checkpoint: str, every: str = "1 minute", once: bool = False):
    """Runs ``job(number)`` at each tick, one at a time; a job that fails ends the query."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    w = rate.writeStream.foreachBatch(lambda _, number: job(number)).option("checkpointLocation", checkpoint)
    return (w.trigger(once=True) if once else w.trigger(processingTime=every)).start()


def reconcile_embeddings(memories: Callable[[], DataFrame], embeddings: Callable[[], DataFrame], target: str, embedder, limit: int = limits.EMBED_BATCH) -> Callable[[int], None]:
    """A job that embeds the first ``limit`` versions without an embedding, by id and version.

    ``memories`` and ``embeddings`` read the tables as they are at a tick; results go to the tick's
    own partition below ``target``, which a replay replaces."""

    def run(number: int) -> None:
        m, held = memories(), embeddings()
        # what an earlier try of this tick has stored is replaced
        held = held.filter(f"tick != {number}") if "tick" in held.columns else held
        keys = memory.list_missing(m, held, limit)
        made = memory.embed(memory.render(m.join(keys, ["id", "version"], "left_semi")), embedder)
        outcome, _, _ = persist(made.persist(), f"{target}/tick={number}")
        made.unpersist()
        if outcome != PERSISTED:
            raise PersistError("embeddings", outcome)

    return run
