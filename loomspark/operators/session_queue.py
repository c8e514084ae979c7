"""A session's submission queue: what is admitted, dropped and sent, in order.

Submissions of a session (seq, kind) are served one by one.  ``start`` opens a new session,
``observation`` opens it if need be, ``end`` closes it for good; ``sent`` takes the oldest entry
off the queue.  Only observations count against the capacity, and only the one that comes when
it is reached is dropped; starts and ends always enter.  One rule serves batches and streams.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "session_id string, seq long, ordinal int, emitted string, entry long"


class SubmissionQueue:
    """The state of one session: new, active or closing; the entries that wait, oldest first."""

    def __init__(self, capacity: int, state: str = "new", waiting: list[tuple[int, str]] | None = None) -> None:
        self.capacity, self.state, self.waiting = capacity, state, deque(waiting or [])
        self.observations = sum(kind == "observation" for _, kind in self.waiting)

    def serve(self, seq: int, kind: str) -> list[tuple[str, int]]:
        """(what happens, the entry that it happens to)."""
        if kind == "sent":
            if not self.waiting:
                return []
            entry, was = self.waiting.popleft()
            self.observations -= was == "observation"
            return [(f"sent:{was}", entry)]
        if self.state == "closing":
            return []
        if kind == "observation" and self.observations >= self.capacity:
            return [("overflow", seq)]
        out = []
        if self.state == "new" and kind != "end":
            self.state = "active"
            out.append(("start", seq))
        if kind == "end":
            self.state = "closing"
            out.append(("end", seq))
        if kind == "observation":
            self.observations += 1
            out.append(("observation", seq))
        self.waiting += [(entry, what) for what, entry in out]
        return out


def serve_all(submissions: DataFrame, capacity: int) -> DataFrame:
    """session_id, seq, kind -> session_id, seq, ordinal, emitted, entry: a sorted stream of each
    session's submissions, whose state is its queue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, queue = None, None
        for pdf in batches:
            out = []
            for session, seq, kind in zip(pdf["session_id"].tolist(), pdf["seq"].tolist(), pdf["kind"].tolist(), strict=True):
                if session != now:
                    now, queue = session, SubmissionQueue(capacity)
                out += [(session, seq, k, *what) for k, what in enumerate(queue.serve(seq, kind))]
            yield pd.DataFrame(out, columns=["session_id", "seq", "ordinal", "emitted", "entry"])

    rows = submissions.select("session_id", F.col("seq").cast("long").alias("seq"), "kind").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return rows.mapInPandas(run, OUTPUT)
