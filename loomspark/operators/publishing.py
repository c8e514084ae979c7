"""Publishing of a session's results: staging, loading, marking, superseding, comparing.

As everywhere, a step is a function of (state, requests) that gives outcomes and new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import fenced

CLAIM_KEY = ["attempt_id", "lease_token", "session_id", "source_revision"]
#: The fields of a memory version that a repeated publication must agree in.
MEMORY_FIELDS = ("id", "version", "type", "title", "content", "created_at", "updated_at", "concepts", "files", "session_ids", "source_observation_ids")


def supersede(attempts: DataFrame, loaded: DataFrame) -> DataFrame:
    """loaded (attempt_id, lease_token, source_revision, lifecycle_count, observation_count: as
    recomputed) -> attempt_id, outcome, state.

    current: all three agree; superseded: a claimed attempt whose source has moved on;
    unconfirmed_commit: a staged or publishing one; invalid_response: any other state;
    lease_lost: another token holds it."""
    a = attempts.select("attempt_id", F.col("lease_token").alias("token"), F.col("source_revision").alias("revision"), F.col("lifecycle_count").alias("l"), F.col("observation_count").alias("o"), "state")
    j = loaded.join(a, "attempt_id")
    same = (F.col("revision") == F.col("source_revision")) & (F.col("l") == F.col("lifecycle_count")) & (F.col("o") == F.col("observation_count"))
    moved = F.when(F.col("state") == "claimed", F.when(F.col("token") == F.col("lease_token"), "superseded").otherwise("lease_lost")).when(F.col("state").isin("staged", "publishing"), "unconfirmed_commit").otherwise("invalid_response")
    outcome = F.when(same, "current").otherwise(moved)
    return j.select("attempt_id", outcome.alias("outcome"), F.when(outcome == "superseded", "superseded").otherwise(F.col("state")).alias("state"))


def stage(attempts: DataFrame, existing: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts staged, candidates inserted).

    requests: the claim's key and ``candidates``, an array of (fingerprint, memory_id) in order.
    A claimed attempt becomes staged; its candidates get the ordinals from 0 on; those whose
    (session, fingerprint) is stored, or that an earlier ordinal has, are left out."""
    ok = requests.join(attempts.filter("state = 'claimed'").select(*CLAIM_KEY), CLAIM_KEY, "left_semi")
    rows = ok.select("attempt_id", "session_id", F.posexplode("candidates").alias("ordinal", "c")).select("attempt_id", "session_id", "ordinal", "c.*")
    first = F.row_number().over(Window.partitionBy("session_id", "fingerprint").orderBy("attempt_id", "ordinal"))
    rows = rows.withColumn("nr", first).filter("nr = 1").drop("nr").join(existing.select("session_id", "fingerprint"), ["session_id", "fingerprint"], "left_anti")
    return ok.select("attempt_id", F.lit("staged").alias("state")), rows.select("attempt_id", "ordinal", "session_id", "fingerprint", "memory_id")


def load_unpublished(attempts: DataFrame, candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (the claim's key) -> attempt_id, state publishing, candidates: the unpublished
    ones by ordinal, an empty list without any; a row per staged or publishing attempt."""
    ok = fenced(attempts, requests.select(*CLAIM_KEY), ("staged", "publishing")).select("attempt_id")
    rest = candidates.filter("published_at is null").join(ok, "attempt_id", "left_semi")
    # collect_list leaves nulls out: an attempt without candidates has an empty list
    per = rest.groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "fingerprint", "memory_id"))).alias("candidates"))
    empty = F.array().cast("array<struct<ordinal:int,fingerprint:string,memory_id:string>>")
    return ok.join(per, "attempt_id", "left").select("attempt_id", F.lit("publishing").alias("state"), F.coalesce("candidates", empty).alias("candidates"))


def mark_published(attempts: DataFrame, candidates: DataFrame, requests: DataFrame, now) -> DataFrame:
    """requests (the claim's key, memory_id) -> attempt_id, memory_id, published_at, state: the
    first time of publication stays; requests that no candidate meets give no row."""
    ok = fenced(attempts, requests.select(*CLAIM_KEY, "memory_id").distinct(), ("staged", "publishing")).select("attempt_id", "memory_id")
    return ok.join(candidates.select("attempt_id", "memory_id", "published_at"), ["attempt_id", "memory_id"]).select("attempt_id", "memory_id", F.coalesce("published_at", now).alias("published_at"), F.lit("publishing").alias("state"))


def publish(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal and the eleven fields) -> ordinal, outcome.

    inserted: the key is new; else the stored version is read again and all fields compared:
    existing_equivalent or mismatch.  An invalid request is unknown.  Requests for one key are
    served by ordinal, so that a later one meets what the first has stored."""
    whole = F.struct(*[F.col(c) for c in MEMORY_FIELDS])
    stored = memories.select("id", "version", whole.alias("stored"))
    first = F.first(whole).over(Window.partitionBy("id", "version").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    valid = F.coalesce((F.col("id") != "") & (F.col("version") >= 1) & (F.col("title") != "") & (F.col("content") != ""), F.lit(False))
    good = requests.filter(valid).withColumn("earlier", first).join(stored, ["id", "version"], "left")
    held = F.coalesce("stored", "earlier")
    out = good.select("ordinal", F.when(held.isNull(), "inserted").when(held.eqNullSafe(whole), "existing_equivalent").otherwise("mismatch").alias("outcome"))
    return out.unionByName(requests.filter(~valid).select("ordinal", F.lit("unknown").alias("outcome")))


def source_cutoff(entries: DataFrame) -> DataFrame:
    """session_id, source_cutoff: the latest time of ingestion over the loaded entries."""
    return entries.groupBy("session_id").agg(F.max("ingested_at").alias("source_cutoff"))
