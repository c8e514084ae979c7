"""Sessions as a stateful stream: the submission queue, and sessions that fall silent.

State is kept by session in the state store (RocksDB): whether the session is new, active or
closing and when it was last observed (a value), and what waits in its queue (a list of at most
the capacity and two lifecycle entries).  A timer runs from the last observation's time of
ingestion; when it ends, inclusively, the session is reported inactive once, and again only after
further observations.  Output does not depend on how the input is cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import limits
from ..operators.session_queue import OUTPUT, SubmissionQueue

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class SessionProcessor(StatefulProcessor):
    def __init__(self, capacity: int, silence_ms: int) -> None:
        self.capacity, self.silence_ms = capacity, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "state string, observed_ms long")
        self.waiting = handle.getListState("waiting", "entry long, kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.status.get() if self.status.exists() else None
        state, observed = (held[0], held[1]) if held else ("new", None)
        queue = SubmissionQueue(self.capacity, state, [(int(e), k) for e, k in self.waiting.get()] if self.waiting.exists() else [])
        last, out = observed, []
        for pdf in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: r.seq):
            out += [(key[0], pdf.seq, k, *what) for k, what in enumerate(queue.serve(int(pdf.seq), pdf.kind))]
            if pdf.kind == "observation":
                last = max(last or 0, int(pdf.ingested_ms))
        self.status.update((queue.state, last))
        if queue.waiting:
            self.waiting.put([(e, k) for e, k in queue.waiting])
        else:
            self.waiting.clear()
        if last != observed:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.silence_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield pd.DataFrame([(key[0], None, 0, "inactive", self.status.get()[1])], columns=COLUMNS).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def sessions(submissions: DataFrame, capacity: int, silence_ms: int = limits.ELIGIBLE_HOURS * 3_600_000) -> DataFrame:
    """A stream of session_id, seq, kind, ingested_ms -> session_id, seq, ordinal, emitted, entry, as
    ``session_queue.serve_all`` has it, and rows ``inactive`` whose entry is the last observation's time.

    The session's state store provider has to be ``PROVIDER``."""
    processor = SessionProcessor(capacity, silence_ms)
    return submissions.groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")
