"""Operator 11: repair of the structure of conversations.

A forward Viterbi pass over each conversation's rows in order, over the four states of the
grammar ``(s?(ua)+)?`` (nothing yet, after system, after user, after assistant).  Each state
carries the least (cost, audit string) that reaches it; after each row the layer is closed by
at most two inserts.  Rows arrive sorted and are streamed: a conversation of any length holds
four costs, the ends of four audit strings in which the states still differ, and the rows not
yet decided.  States that cannot win any more go, so that these ends stay short.

Partial strings of one cost at one row never are prefixes of each other (a longer one would
hold more inserts, which cost), so the least string of a state stays least in whatever follows.

Scale: one shuffle, by conv_id; marks of repeated rows are a window inside of it.  A row is
judged in the JVM; Python runs the sequence.  A conversation that holds a third of all rows is
one task's stream, of bounded memory: its audit depends on its rows one after the other.

Defined results: null role, text, conv_id and turn count as one space in what they say; rows
without conv_id are one conversation, returned with a null conv_id; rows of equal turn stand by
role, then text; repeated rows are duplicates; empty texts are blank; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Costs of the edits, and what each undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the symbol, for the states that allow it.
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_EITHER = {**_AFTER["u"], **_AFTER["a"]}  # what user or assistant, whichever fits, leads to
_LEGAL = {"su", "ua", "au"}
_FLUSH = 32
_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with deterministic faults: conv_id, turn, role, text, copy, dropped."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("dropped"))


def judged(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order, with their first fault; ``rows`` as from ``damaged``."""
    rows = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "dropped", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first(), "copy")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(F.col("dropped"), "dropped").when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    marked = rows.withColumn("nth", F.row_number().over(same))
    return marked.select("conv_id", "turn", "role", "text", fault.alias("fault"), "copy").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")


class Repair:
    """The repair of one conversation, row by row."""

    def __init__(self) -> None:
        self.gaps = self.illegal = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.turn = self.before = None
        self.turns = 0
        self.layer: dict[int, tuple[int, str]] = self._closed({START: (0, "")})
        self.open: deque[tuple[str, str]] = deque()  # rows whose edit is not decided yet
        self.audit: list[str] = []
        self.at, self.sha, self.any = START, hashlib.sha256(), False

    @staticmethod
    def _closed(layer: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
        for _ in range(2):
            for state, (cost, said) in list(layer.items()):
                to, by = _EITHER[state], (cost + INSERT, said + "I")
                if to not in layer or by < layer[to]:
                    layer[to] = by
        # states that lose to another one whatever follows: that one can do the same, at most by
        # an insert, or a deletion in place of the one system row that only the start can keep
        best = min(layer[s][0] + more for s, more in ((USER, INSERT), (ASSISTANT, 0)) if s in layer)
        spare = {START: DELETE, SYSTEM: 0, USER: INSERT, ASSISTANT: 0}
        return {s: x for s, x in layer.items() if x[0] <= best + spare[s]}

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if fault == "dropped":
            return
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in _LEGAL:
            self.illegal += 1
        self.before = initial
        self.open.append((role, text))
        new: dict[int, tuple[int, str]] = {}

        def reach(state: int, cost: int, said: str) -> None:
            if state not in new or (cost, said) < new[state]:
                new[state] = (cost, said)

        more = TRUNCATED if fault == "truncated" else 0
        for state, (cost, said) in self.layer.items():
            reach(state, cost + DELETE, said + "D")
            if fault not in ("blank", "duplicate"):
                if (to := _AFTER.get(initial, {}).get(state)) is not None:
                    reach(to, cost + more, said + "K")
                reach(_EITHER[state], cost + more + REROLE, said + "R")
        self.layer = self._closed(new)
        if len(self.open) % _FLUSH == 0:
            self._decide(os.path.commonprefix([said for _, said in self.layer.values()]))

    def _decide(self, said: str) -> None:
        """The edits that all states share are final: hash what they leave."""
        for edit in said:
            role, text = ("", "") if edit == "I" else self.open.popleft()
            if edit == "D":
                continue
            if edit == "K":
                self.at = _AFTER[role[:1]][self.at]
            else:
                self.at = _EITHER[self.at]
                role = "user" if self.at == USER else "assistant"
            self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True
        self.audit.append(said)
        self.layer = {s: (cost, x[len(said) :]) for s, (cost, x) in self.layer.items()}

    def result(self) -> dict:
        cost, said = min(self.layer[s] for s in (START, ASSISTANT) if s in self.layer)
        self._decide(said)
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return {"gaps": gaps, **self.counts, "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, work, done = None, None, []
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _SCHEMA.split(", ")])
    for batch in batches:
        for conv, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
            if work is None or conv != now:
                if work is not None:
                    done.append({"conv_id": now, **work.result()})
                now, work = conv, Repair()
            work.add(turn, role, text, fault)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if work is not None:
        done.append({"conv_id": now, **work.result()})
    yield pa.RecordBatch.from_pylist(done, schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (as from ``damaged``): faults, cost, audit, digest of the repaired text."""
    return judged(rows).select("conv_id", "turn", "role", "text", "fault").mapInArrow(_repair, _SCHEMA)


def undamaged(rows: DataFrame) -> DataFrame:
    """``rows`` as ``repair`` takes them, without faults added."""
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"))


def op11_conversations(spark, sf_dir):
    return repair(damaged(table(spark, sf_dir, "conversations")))
