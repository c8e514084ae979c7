"""The event ledger: validation, routing, adapters' projections, row-change events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_failure, timestamp_ms

LIFECYCLE = ("session_start", "session_end")
#: Event kinds that the two adapter versions pass on.
ADAPTER_V1 = ("session.created", "session.deleted", "session.updated", "session.status", "session.idle", "message.updated", "message.part.updated", "session.error")
ADAPTER_V2 = ("session.created", "session.deleted", "session.execution.started", "session.execution.succeeded", "session.execution.interrupted", "session.text.ended", "session.reasoning.ended", "session.execution.failed", "session.step.failed", "session.compaction.failed")
#: Hooks of the two adapter versions, passed on as observations like event kinds.
HOOKS_V1 = ("chat.message", "tool.execute.before", "tool.execute.after")
HOOKS_V2 = ("session.prompt", "tool.execute.before", "tool.execute.after")
OBSERVATION_FIELDS = {"event_type", "session_id", "project_name", "current_working_directory", "timestamp", "hook_type", "data"}
LIFECYCLE_FIELDS = OBSERVATION_FIELDS - {"hook_type", "data"}


def validate(events: DataFrame) -> DataFrame:
    """Queue events as JSON text (column ``json``) -> fields, ``fault`` (null: valid), epoch_ms.

    The field set must match exactly, and fields other than ``data`` must be strings, of which
    only session_id must not be empty; the first fault in the order below is reported."""
    # types come from the parsed value: a number or an object is no string
    plain = sorted(OBSERVATION_FIELDS - {"data"})
    df = events.withColumns({"keys": F.array_sort(F.json_object_keys("json")), "parsed": F.try_parse_json("json")})
    kind = lambda k: F.schema_of_variant(F.try_variant_get("parsed", f"$.{k}", "variant"))
    df = df.withColumns({k: F.when(kind(k) == "STRING", F.try_variant_get("parsed", f"$.{k}", "string")) for k in plain} | {"data": F.get_json_object("json", "$.data"), "data_kind": kind("data")})
    df = df.withColumn("epoch_ms", timestamp_ms(F.col("timestamp")))
    obs = F.col("event_type") == "observation"
    fields = lambda names: F.array(*[F.lit(x) for x in sorted(names)])
    fault = first_failure(
        (F.col("keys").isNull() | F.col("parsed").isNull(), "not_an_object"),
        (~F.coalesce(F.col("event_type").isin(*LIFECYCLE, "observation"), F.lit(False)), "event_type"),
        (F.col("keys") != F.when(obs, fields(OBSERVATION_FIELDS)).otherwise(fields(LIFECYCLE_FIELDS)), "fields"),
        (F.col("session_id").isNull() | (F.col("session_id") == ""), "session_id"),
        (F.col("project_name").isNull(), "project_name"),
        (F.col("current_working_directory").isNull(), "current_working_directory"),
        (F.col("epoch_ms").isNull(), "timestamp"),
        (obs & F.col("hook_type").isNull(), "hook_type"),
        (obs & ~F.coalesce(F.col("data_kind").startswith("OBJECT"), F.lit(False)), "data"),
    )
    return df.withColumn("fault", fault).drop("keys", "parsed", "data_kind")


def doubles(c):
    """JSON text with every number written as a double, as Arrow-batched Python."""
    import json
    import math

    def walk(x):
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            if not math.isfinite(float(x)):
                raise ValueError
            return float(x)
        return x

    def refuse(_):
        raise ValueError

    def one(t):
        try:
            return json.dumps(walk(json.loads(t, parse_constant=refuse)), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, OverflowError):
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run(c)


def route(valid: DataFrame, ingested_at) -> tuple[DataFrame, DataFrame]:
    """(session_events, raw_observations) rows of valid events; every delivery is a row."""
    base = [F.uuid().alias("receipt_id"), "session_id", "event_type", "project_name", "current_working_directory", F.col("timestamp").alias("source_timestamp_rfc3339"), F.timestamp_millis("epoch_ms").alias("source_timestamp_utc"), ingested_at.alias("ingested_at")]
    ok = valid.filter("fault is null")
    return ok.filter(F.col("event_type").isin(*LIFECYCLE)).select(*base), ok.filter("event_type = 'observation'").select(*base, "hook_type", "data")


def basename(c):
    """Last path part with / or \\ as separators, trailing separators ignored."""
    return F.nullif(F.regexp_extract(c, r"([^/\\]+)[/\\]*$", 1), F.lit(""))


def session_metadata(events: DataFrame) -> DataFrame:
    """session_id, seq, event_dir, wrapper_dir, worktree, plugin_dir -> + cwd, project.

    The directory is the event's, else the wrapper's, else the last one that the session had,
    else the plugin's; the project is the last part of the work tree, else of the directory."""
    own = F.coalesce("event_dir", "wrapper_dir")
    past = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cwd = F.coalesce(own, F.last(own, ignorenulls=True).over(past), F.col("plugin_dir"))
    return events.withColumn("cwd", cwd).withColumn("project", F.coalesce(basename(F.col("worktree")), basename(F.col("cwd"))))


def derived(events: DataFrame, prefix: str = "opencode.v1.", kinds: tuple[str, ...] = (*ADAPTER_V1, *HOOKS_V1)) -> DataFrame:
    """session_id, seq, kind, delta -> ledger events: created starts before it is observed,
    deleted ends after it; streamed deltas and unknown kinds are not passed on."""
    ok = events.filter(F.col("kind").isin(*kinds) & ~((F.col("kind") == "message.part.updated") & F.col("delta").isNotNull()))
    e = lambda t, h: F.struct(F.lit(t).alias("event_type"), h.alias("hook_type"))
    none, hook = F.lit(None).cast("string"), F.concat(F.lit(prefix), "kind")
    out = F.when(F.col("kind") == "session.created", F.array(e("session_start", none), e("observation", hook))).when(F.col("kind") == "session.deleted", F.array(e("observation", hook), e("session_end", none))).otherwise(F.array(e("observation", hook)))
    return ok.select("session_id", "seq", F.posexplode(out).alias("ordinal", "e")).select("session_id", "seq", "ordinal", "e.*")


def ordered_runtime(events: DataFrame) -> DataFrame:
    """session_id, seq, event_type -> what the runtime emits: a first observation starts its
    session, nothing follows an end, a second start is dropped, and so is the end of a session
    that never started."""
    past = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)).over(past), F.lit(0))
    end = F.col("event_type") == "session_end"
    df = events.withColumn("started", n(~end) > 0)
    df = df.withColumn("ended", n(end & F.col("started")) > 0)
    none = F.array().cast("array<string>")
    dropped = F.col("ended") | ((F.col("event_type") == "session_start") & F.col("started")) | (end & ~F.col("started"))
    emit = F.when(dropped, none).when((F.col("event_type") == "observation") & ~F.col("started"), F.array(F.lit("session_start"), F.lit("observation"))).otherwise(F.array("event_type"))
    return df.select("session_id", "seq", F.posexplode(emit).alias("ordinal", "emitted"))


def row_changes(events: DataFrame, db: str, table: str, most_keys: int) -> DataFrame:
    """db, table, op, affected_rows, returning, at, truncated -> + reason (null: accepted)."""
    name = F.regexp_replace(F.lower("table"), r"^public\.", "")
    keys = F.col("returning")
    reason = first_failure(
        (F.col("db") != db, "unrelated"),
        (name != table.lower(), "unrelated"),
        (F.col("op") != "insert", "unrelated"),
        (F.coalesce(F.col("truncated"), F.lit(False)), "truncated"),
        (~F.col("at").between(0, 253402300799999), "malformed"),
        (keys.isNull() | (F.size(keys) == 0), "malformed"),
        (F.size(keys) > most_keys, "oversized"),
        (F.size(F.array_distinct(keys)) != F.size(keys), "duplicate"),
        (F.size(keys) != F.col("affected_rows"), "malformed"),
    )
    return events.withColumn("reason", reason)
