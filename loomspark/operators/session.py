"""Session post-processing: eligibility, claims, transcripts, candidates, state changes.

Every step is a pure function of (state, requests, now); ``now`` is a parameter."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import limits
from ..functions.text import first_failure, framed, framed_bytes, trim_unicode, uuid5
from ..sources.shared import written

REVISION_NAMESPACE = "5b0c1c54-31a4-5f0c-9f0e-6f3e0a9d2c11"
ACTIVE = ("claimed", "staged", "publishing")
#: The legal changes of an attempt's state.
TRANSITIONS = (("claimed", "staged"), ("claimed", "retryable"), ("claimed", "superseded"), ("staged", "publishing"), ("staged", "retryable"), ("publishing", "complete"), ("publishing", "retryable"), ("retryable", "claimed"))


def eligible(lifecycle: DataFrame, observations: DataFrame, records: DataFrame, now) -> DataFrame:
    """Sessions to process: ended, or last observed at least 24 hours ago (inclusive), and
    without a record or with other counts than it has."""
    l = lifecycle.groupBy("session_id").agg(F.count(F.lit(1)).alias("lifecycle_count"), F.bool_or(F.col("event_type") == "session_end").alias("ended"), F.max("ingested_at").alias("l_last"))
    o = observations.groupBy("session_id").agg(F.count(F.lit(1)).alias("observation_count"), F.max("ingested_at").alias("o_last"))
    s = l.join(o, "session_id", "full_outer").select("session_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("lifecycle_count", "observation_count")], F.coalesce("ended", F.lit(False)).alias("ended"), "o_last")
    r = records.select("session_id", F.col("lifecycle_count").alias("r_l"), F.col("observation_count").alias("r_o"))
    s = s.join(r, "session_id", "left")
    due = F.col("ended") | (F.col("o_last") <= now - F.expr(f"INTERVAL {limits.ELIGIBLE_HOURS} HOURS"))
    changed = ~F.col("lifecycle_count").eqNullSafe(F.col("r_l")) | ~F.col("observation_count").eqNullSafe(F.col("r_o"))
    return s.filter(due & changed).select("session_id", "lifecycle_count", "observation_count", "ended")


def identities(lifecycle: DataFrame, observations: DataFrame) -> DataFrame:
    return lifecycle.select("session_id", "event_type", "receipt_id").unionByName(observations.select("session_id", "event_type", "receipt_id"))


def claim_batch(sessions: DataFrame, lifecycle: DataFrame, observations: DataFrame, batch: int = limits.SWEEP_BATCH) -> DataFrame:
    """The first ``batch`` eligible sessions with their ordered sources and source revision."""
    top = sessions.orderBy("session_id").limit(batch)
    per = identities(lifecycle, observations).join(top.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "receipt_id"))).alias("sources"))
    return top.join(per, "session_id").withColumn("source_revision", revision(F.col("sources")))


def revision(sources, namespace: str = REVISION_NAMESPACE):
    """Version-5 identifier over the sorted (event_type, receipt_id) pairs, each framed."""
    frame = F.array_join(F.transform(sources, lambda s: F.concat(s["event_type"], F.lit("\0"), s["receipt_id"], F.lit("\n"))), "")
    return uuid5(namespace, frame)


def transcript(lifecycle: DataFrame, observations: DataFrame) -> DataFrame:
    """session_id, position, ...: by source time, ingest time, start < observation < end, receipt."""
    cols = ["session_id", "event_type", "receipt_id", "source_timestamp_utc", "ingested_at"]
    rank = F.when(F.col("event_type") == "session_start", 0).when(F.col("event_type") == "observation", 1).otherwise(2)
    both = lifecycle.select(*cols).unionByName(observations.select(*cols)).withColumn("type_rank", rank)
    order = Window.partitionBy("session_id").orderBy("source_timestamp_utc", "ingested_at", "type_rank", "receipt_id")
    return both.withColumn("position", F.row_number().over(order))


def transcript_faults(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """snapshots (snapshot_id) and their entries (snapshot_id, position, session_id, receipt_id)
    -> snapshot_id, n_entries, fault: no entries, or at the first entry at fault another
    session than the first entry's, or a receipt that an earlier entry has."""
    per = Window.partitionBy("snapshot_id").orderBy("position")
    mixed = F.col("session_id") != F.first("session_id").over(per)
    again = F.row_number().over(Window.partitionBy("snapshot_id", "receipt_id").orderBy("position")) > 1
    e = entries.withColumn("fault", F.when(mixed, "entries:mixed_session_ids").when(again, "entries:duplicate_receipt_id"))
    found = e.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("position"))).alias("found"))
    j = snapshots.join(found, "snapshot_id", "left")
    return j.select("snapshot_id", F.coalesce("n", F.lit(0)).alias("n_entries"), F.when(F.col("n").isNull(), "entries:empty").otherwise(F.col("found")).alias("fault"))


def snapshot(lifecycle: DataFrame, observations: DataFrame, prior: DataFrame) -> DataFrame:
    """The transcript with ``in_scope``: observations that the session's prior transcript
    (session_id, receipt_id) does not hold, which alone may support new memories."""
    t = transcript(lifecycle, observations)
    old = prior.select("session_id", "receipt_id").distinct().withColumn("old", F.lit(True))
    return t.join(old, ["session_id", "receipt_id"], "left").withColumn("in_scope", (F.col("event_type") == "observation") & F.col("old").isNull()).drop("old")


def memory_scope(observations: DataFrame, prior: DataFrame) -> DataFrame:
    """Observation receipts that the session's previous projection does not have."""
    return observations.select("session_id", "receipt_id").join(prior.select("session_id", "receipt_id"), ["session_id", "receipt_id"], "left_anti")


def claim(attempts: DataFrame, requests: DataFrame, now, lease_seconds: int = limits.LEASE_SECONDS) -> DataFrame:
    """requests (ordinal, session_id, source_revision, token) -> outcome per request.

    A session has one open attempt at most.  If that is retryable and due, or its lease has run
    out (its state stays), the session's first request takes it over, whatever revision it asks
    for: ``claimed_revision`` is the attempt's own.  Without an open attempt the first request
    whose revision is stored nowhere yet is inserted.  All others are not claimed."""
    open_ = attempts.filter(F.col("state").isin(*ACTIVE, "retryable")).select("session_id", F.col("source_revision").alias("held"), "state", F.col("lease_expires_at").alias("lease"), "next_attempt_at")
    known = attempts.select("source_revision").distinct().withColumn("known", F.lit(True))
    j = requests.join(open_, "session_id", "left").join(known, "source_revision", "left")
    per = Window.partitionBy("session_id")
    first = F.row_number().over(per.orderBy("ordinal")) == 1
    fresh = F.col("known").isNull()
    first_fresh = F.row_number().over(per.orderBy(fresh.desc(), "ordinal")) == 1
    due, over = (F.col("state") == "retryable") & (F.col("next_attempt_at") <= now), F.col("state").isin(*ACTIVE) & (F.col("lease") <= now)
    j = j.withColumns({"first": first, "first_fresh": first_fresh & fresh})
    outcome = F.when(F.col("first") & due, "reclaimed_retryable").when(F.col("first") & over, "reclaimed_expired").when(F.col("held").isNull() & F.col("first_fresh"), "inserted").otherwise("not_claimed")
    j = j.withColumn("outcome", outcome)
    revision_of = F.when(F.col("outcome") == "inserted", F.col("source_revision")).when(F.col("outcome") != "not_claimed", F.col("held"))
    state = F.when(F.col("outcome").isin("reclaimed_retryable", "inserted"), "claimed").when(F.col("outcome") == "reclaimed_expired", F.col("state"))
    lease = F.when(F.col("outcome") != "not_claimed", now + F.make_interval(secs=F.lit(lease_seconds)))
    return j.select("ordinal", "session_id", "source_revision", "token", "outcome", revision_of.alias("claimed_revision"), state.alias("new_state"), lease.alias("lease_expires_at"))


def renew(attempts: DataFrame, token: str, now, lease_seconds: int = limits.LEASE_SECONDS) -> DataFrame:
    """Attempts with the lease moved on where the token matches, the state is active and the
    lease has not run out."""
    ok = (F.col("lease_token") == token) & F.col("state").isin(*ACTIVE) & (F.col("lease_expires_at") > now)
    return attempts.withColumn("lease_expires_at", F.when(ok, now + F.make_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_expires_at")))


def legal(changes: DataFrame) -> DataFrame:
    """from_state, to_state -> + legal."""
    spark = changes.sparkSession
    t = spark.createDataFrame(list(TRANSITIONS), "from_state string, to_state string").withColumn("legal", F.lit(True))
    return changes.join(F.broadcast(t), ["from_state", "to_state"], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))


#: Type and version of memories made from candidates.
CANDIDATE_TYPE, CANDIDATE_VERSION = "session-derived", 1


def candidate_faults(generated: DataFrame, scope: DataFrame) -> DataFrame:
    """session_id, title, content, concepts, receipts (and more) -> + fault, the first one of a
    candidate, null if it is valid; ``scope``: the observations (session_id, receipt_id) it may cite.

    An empty list of concepts is valid, an empty concept is not."""
    nul = lambda c: F.instr(c, "\0") > 0
    cited = generated.select("session_id", F.explode("receipts").alias("receipt_id")).distinct()
    foreign = cited.join(scope.select("session_id", "receipt_id").distinct(), ["session_id", "receipt_id"], "left_anti").groupBy(F.col("session_id").alias("f_session")).agg(F.collect_set("receipt_id").alias("foreign"))
    rows = generated.join(foreign, F.col("session_id") == F.col("f_session"), "left").drop("f_session")
    fault = first_failure(
        (F.col("title") == "", "title:empty"),
        (nul(F.col("title")), "title:contains_nul"),
        (F.col("content") == "", "content:empty"),
        (nul(F.col("content")), "content:contains_nul"),
        (F.exists("concepts", nul), "concepts:contains_nul"),
        (F.size("receipts") < 1, "supporting_receipt_ids:empty"),
        (F.size(F.array_distinct("receipts")) < F.size("receipts"), "supporting_receipt_ids:duplicate"),
        (F.coalesce(F.arrays_overlap("receipts", "foreign"), F.lit(False)), "supporting_receipt_ids:outside_memory_scope"),
        (F.exists("concepts", lambda c: trim_unicode(c) == ""), "concepts:empty"),
        ((trim_unicode(F.col("title")) == "") | (trim_unicode(F.col("content")) == ""), "canonical_payload:invalid"),
    )
    return rows.withColumn("fault", fault).drop("foreign")


def candidates(generated: DataFrame, namespace: str = REVISION_NAMESPACE) -> DataFrame:
    """session_id, title, content, concepts, receipts (valid ones) -> one row per content fingerprint.

    Title and content are trimmed, concepts trimmed, lower-cased, sorted; receipts of equal
    fingerprints are merged; ``ordinal`` follows the fingerprint."""
    concepts = F.array_sort(F.transform("concepts", lambda c: F.lower(trim_unicode(c))))
    df = generated.withColumns({"type": F.lit(CANDIDATE_TYPE), "title": trim_unicode(F.col("title")), "content": trim_unicode(F.col("content")), "concepts": concepts})
    body = F.concat(framed(F.lit(str(CANDIDATE_VERSION))), framed(F.col("type")), framed(F.col("title")), framed(F.col("content")), F.aggregate(F.transform("concepts", framed), F.unhex(F.lit("")), lambda a, x: F.concat(a, x)))
    df = df.withColumn("fingerprint", F.sha2(body, 256))
    out = df.groupBy("session_id", "fingerprint").agg(F.min(F.struct("type", "title", "content", "concepts")).alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("receipts")))).alias("receipts"))
    # the digest itself is framed, not its hexadecimal text
    ident = F.concat(framed(F.col("session_id")), framed_bytes(F.unhex("fingerprint")))
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("fingerprint")) - 1
    return out.select("session_id", pos.alias("ordinal"), "fingerprint", uuid5(namespace, ident).alias("memory_id"), "c.*", "receipts")


def stage_candidates(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New candidates whose (session, fingerprint) is not stored yet."""
    return new.join(existing.select("session_id", "fingerprint"), ["session_id", "fingerprint"], "left_anti")


def promote(attempts: DataFrame, staged: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, promoted attempts): a publishing attempt without unpublished candidates and
    without another open attempt of its session replaces the session's record."""
    open_ = attempts.filter(F.col("state").isin(*ACTIVE, "retryable")).select("session_id", F.col("attempt_id").alias("o_attempt"))
    ready = attempts.filter("state = 'publishing'").join(staged.filter("published_at is null").select("attempt_id"), "attempt_id", "left_anti")
    ready = ready.join(open_, (ready["session_id"] == open_["session_id"]) & (F.col("attempt_id") != F.col("o_attempt")), "left_anti")
    new = ready.select("session_id", F.col("source_revision").alias("n_revision"), F.col("lifecycle_count").alias("n_l"), F.col("observation_count").alias("n_o"))
    merged = records.join(new, "session_id", "full_outer").select("session_id", F.coalesce("n_revision", "source_revision").alias("source_revision"), F.coalesce("n_l", "lifecycle_count").alias("lifecycle_count"), F.coalesce("n_o", "observation_count").alias("observation_count"))
    return merged, ready.select("attempt_id", "session_id")


#: Failure categories with the stage they arise in and when they may be tried again.
FAILURES = (
    ("invalid_configuration", "startup", "never"),
    ("registration_mismatch", "startup", "never"),
    ("source_conflict", "source", "never"),
    ("lease_lost", "lease", "after_lease_expiry"),
    ("provider_transient", "provider", "after_backoff"),
    ("provider_contract", "provider", "after_backoff"),
    ("provider_authentication", "provider", "after_backoff"),
    ("provider_unsupported_contract", "provider", "after_backoff"),
    ("provider_request_size", "provider", "after_backoff"),
    ("memory_unknown", "memory", "after_backoff"),
    ("memory_mismatch", "memory", "after_backoff"),
    ("repository_invocation", "repository", "after_lease_expiry"),
    ("repository_unconfirmed_commit", "repository", "after_lease_expiry"),
    ("repository_invalid_response", "repository", "after_lease_expiry"),
)


def failure_taxonomy(spark) -> DataFrame:
    return spark.createDataFrame(list(FAILURES), "category string, stage string, retryability string")


def fenced(attempts: DataFrame, requests: DataFrame, states: tuple[str, ...] = ACTIVE) -> DataFrame:
    """requests (attempt_id, lease_token, session_id, source_revision, ...) joined with the
    attempts that agree in all four and are in one of ``states``."""
    keys = ["attempt_id", "lease_token", "session_id", "source_revision"]
    return requests.join(attempts.filter(F.col("state").isin(*states)), keys)


def retry(attempts: DataFrame, failures: DataFrame, now, lease_seconds: int = limits.LEASE_SECONDS) -> DataFrame:
    """failures (attempt_id, lease_token, session_id, source_revision, category, jitter_ms) ->
    attempt_id, outcome, state, next_attempt_at, a row per failure.

    The lease is renewed first, and so has to be held still.  Repository failures wait for the
    renewed lease to end, provider and memory failures 60 s and the jitter (10 s at most), to the
    full second.  A lost lease, a category that is never tried again, an attempt in another
    state or of another token, session or revision: skipped, and nothing changes."""
    spark = attempts.sparkSession
    keys = ["attempt_id", "lease_token", "session_id", "source_revision"]
    ok = attempts.filter(F.col("state").isin(*ACTIVE) & (F.col("lease_expires_at") > now)).select(*keys, F.lit(True).alias("held"))
    stored = attempts.select("attempt_id", "state", F.col("next_attempt_at").alias("stored_next"))
    j = failures.join(ok, keys, "left").join(stored, "attempt_id", "left").join(F.broadcast(failure_taxonomy(spark)), "category", "left")
    later = F.timestamp_seconds(F.ceil((F.unix_millis(now) + 60_000 + F.least("jitter_ms", F.lit(10_000))) / 1000))
    go = F.coalesce(F.col("held") & (F.col("category") != "lease_lost") & (F.col("retryability") != "never"), F.lit(False))
    when = F.when(F.col("stage") == "repository", now + F.make_interval(secs=F.lit(lease_seconds))).otherwise(later)
    return j.select("attempt_id", "category", F.when(go, "retryable").otherwise("skipped").alias("outcome"), F.when(go, "retryable").otherwise(F.col("state")).alias("state"), F.when(go, when).otherwise(F.col("stored_next")).alias("next_attempt_at"))


def _compact(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _bytes(x: str) -> int:
    return len(x.encode("utf-8", "surrogatepass"))


def _fragments(position: int, kind: str, content: str, budget: int) -> Iterator[str]:
    """JSON of the pieces of an entry, each as long as its envelope and the brackets of a list leave room for."""
    at = n = 0
    while True:
        # a character takes a byte at least: no piece reaches beyond this
        rest = content[at : at + budget]
        said = lambda k, rest=rest, n=n: _compact({"position": position, "fragment": n, "kind": kind, "content": rest[:k]})
        fits = lambda k: _bytes(said(k)) + 2 <= budget
        low, high = (len(rest), len(rest)) if fits(len(rest)) else (0, len(rest) - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if fits(mid) else (low, mid - 1)
        if low == 0 and rest:
            raise ValueError("the byte budget is too small for one character")
        if not fits(low):
            raise ValueError("the byte budget is too small for an envelope")
        yield said(low)
        at, n = at + low, n + 1
        if at >= len(content):
            return


def _packed(rows: Iterator[tuple[object, str]], budget: int) -> Iterator[tuple[object, int, str, int]]:
    """(key, item) with equal keys together -> (key, number, JSON list, items): lists are filled in
    order up to the budget; one list is held at a time."""
    now, number, held, size = None, 0, [], 2
    for key, item in rows:
        n = _bytes(item)
        if held and (key != now or size + n + 1 > budget):
            yield now, number, f"[{','.join(held)}]", len(held)
            number, held, size = number + 1, [], 2
        if key != now:
            now, number = key, 0
        size += n + bool(held)
        held.append(item)
    if held:
        yield now, number, f"[{','.join(held)}]", len(held)


def _in_frames(rows: Iterator[tuple], columns: list[str], most_bytes: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Rows in frames of bounded text."""
    frame, size = [], 0
    for row in rows:
        frame.append(row)
        size += sum(len(x) if isinstance(x, str) else sum(map(len, x)) for x in row if isinstance(x, (str, list)))
        if size >= most_bytes or len(frame) >= 10_000:
            yield pd.DataFrame(frame, columns=columns)
            frame, size = [], 0
    yield pd.DataFrame(frame, columns=columns)


def chunks(entries: DataFrame, budget: int = limits.CHUNK_BYTES) -> DataFrame:
    """session_id, position, kind, content -> session_id, chunk, json.

    Entries are serialised in order; one that does not fit alone is cut at the longest prefix
    that fits with its envelope; pieces are packed greedily.  Entries are a sorted stream, of
    which one chunk is held at a time: a session may be larger than memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces():
            for pdf in batches:
                for session, position, kind, content in zip(pdf["session_id"].tolist(), pdf["position"].tolist(), pdf["kind"].tolist(), pdf["content"].tolist(), strict=True):
                    for piece in _fragments(int(position), kind, content or "", budget):
                        yield session, piece

        yield from _in_frames(((key, number, text) for key, number, text, _ in _packed(pieces(), budget)), ["session_id", "chunk", "json"])

    rows = entries.select("session_id", "position", "kind", "content").repartition("session_id").sortWithinPartitions("session_id", "position")
    return rows.mapInPandas(run, "session_id string, chunk int, json string")


def generate(parts: DataFrame, generator) -> DataFrame:
    """Calls ``generator(json) -> dict(summary_sentences, concepts)`` per chunk."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            made = [generator(x) for x in pdf["json"]]
            yield pd.DataFrame({"session_id": pdf["session_id"].values, "chunk": pdf["chunk"].values, "summary_sentences": [m["summary_sentences"] for m in made], "concepts": [m["concepts"] for m in made]})

    return parts.mapInPandas(run, "session_id string, chunk int, summary_sentences array<string>, concepts array<string>")


def _final(made: dict) -> dict:
    sentences, concepts = [x.strip() for x in made["summary_sentences"]], [x.strip() for x in made["concepts"]]
    if not 1 <= len(sentences) <= limits.SUMMARY_SENTENCES or not all(sentences):
        raise ValueError("a summary has 1 to 5 sentences")
    if len(concepts) != limits.FINAL_CONCEPTS or not all(concepts) or len({x.lower() for x in concepts}) != len(concepts):
        raise ValueError("a final result has 10 different concepts")
    return {"summary_sentences": sentences, "concepts": concepts}


def reduce(generated: DataFrame, reducer, budget: int = limits.CHUNK_BYTES) -> DataFrame:
    """session_id, chunk, summary_sentences, concepts -> one row a session.

    A session's results are packed in order into JSON payloads of at most ``budget`` bytes;
    ``reducer(payload) -> dict(summary_sentences, concepts)`` makes one result of each, level by
    level until one is left, a single result included.  A level that does not get shorter, or a
    result that does not fit alone, is an error: the budget is too small.

    A level is one sorted stream over all sessions that are not done, written to the shared
    folder: payloads are held one at a time, and a lost executor repeats a level's part only."""
    schema = "session_id string, chunk int, summary_sentences array<string>, concepts array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def items():
            for pdf in batches:
                for session, sentences, concepts in zip(pdf["session_id"].tolist(), pdf["summary_sentences"].tolist(), pdf["concepts"].tolist(), strict=True):
                    item = _compact({"summary_sentences": list(sentences), "concepts": list(concepts)})
                    if _bytes(item) + 2 > budget:
                        raise ValueError("the byte budget is too small for one result")
                    yield session, item

        def reduced():
            for key, number, payload, _ in _packed(items(), budget):
                made = _final(reducer(payload))
                yield key, number, made["summary_sentences"], made["concepts"]

        yield from _in_frames(reduced(), ["session_id", "chunk", "summary_sentences", "concepts"])

    # results are made once: a level is both counted and reduced
    level, done = written(generated.select("session_id", "chunk", "summary_sentences", "concepts"), "generated"), None
    while True:
        before = level.groupBy(F.col("session_id").alias("b_session")).agg(F.count(F.lit(1)).alias("b_n"))
        made = written(level.repartition("session_id").sortWithinPartitions("session_id", "chunk").mapInPandas(run, schema), "reduced")
        sizes = written(made.groupBy(F.col("session_id").alias("n_session")).agg(F.count(F.lit(1)).alias("n")).join(before, F.col("n_session") == F.col("b_session")).select("n_session", "n", "b_n"), "sizes")
        if not sizes.filter("n > 1 and n >= b_n").isEmpty():
            raise ValueError("the byte budget is too small: a level did not get shorter")
        ready = made.join(sizes.filter("n = 1"), F.col("session_id") == F.col("n_session"), "left_semi")
        done = ready if done is None else done.unionByName(ready)
        level = made.join(sizes.filter("n > 1"), F.col("session_id") == F.col("n_session"), "left_semi")
        if level.isEmpty():
            return done.select("session_id", "summary_sentences", "concepts")


def normal_concepts(c):
    """Trimmed concepts, null unless all are non-empty and distinct without regard to case."""
    t = F.transform(c, trim_unicode)
    ok = F.forall(t, lambda x: x != "") & (F.size(F.array_distinct(F.transform(t, F.lower))) == F.size(t))
    return F.when(ok, t)


def tally(outcomes: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return outcomes.agg(n("staged"), n("completed"), n("retryable"), n("skipped"))
