"""Queries over the event ledger and session post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import session as P
from . import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _records(lifecycle, observations):
    """A record for every third session, with its true counts for every sixth."""
    both = lifecycle.withColumn("l", F.lit(1)).withColumn("o", F.lit(0)).unionByName(observations.withColumn("l", F.lit(0)).withColumn("o", F.lit(1)))
    s = both.groupBy("session_id").agg(F.sum("l").cast("long").alias("lifecycle_count"), F.sum("o").cast("long").alias("observation_count"))
    user = F.split("session_id", ":")[0].cast("long")
    return s.filter(user % 3 == 0).withColumn("lifecycle_count", F.col("lifecycle_count") + F.when(user % 6 == 0, 0).otherwise(1))


ELIGIBLE = f"""{X.LEDGER}, s AS (SELECT session_id, count(*) FILTER (event_type != 'observation') AS l, count(*) FILTER (event_type = 'observation') AS o, coalesce(bool_or(event_type = 'session_end'), false) AS ended, max(ts) FILTER (event_type = 'observation') AS o_last FROM led GROUP BY 1),
 rec AS (SELECT session_id, l + CASE WHEN CAST(split_part(session_id, ':', 1) AS BIGINT) % 6 = 0 THEN 0 ELSE 1 END AS l, o FROM s WHERE CAST(split_part(session_id, ':', 1) AS BIGINT) % 3 = 0),
 eli AS (SELECT s.session_id, s.l AS lifecycle_count, s.o AS observation_count, ended FROM s LEFT JOIN rec r USING (session_id) WHERE (ended OR o_last <= TIMESTAMP '{X.NOW}' - INTERVAL 24 HOUR) AND (s.l IS DISTINCT FROM r.l OR s.o IS DISTINCT FROM r.o))"""


@query("session_eligible", f"WITH {ELIGIBLE} SELECT * FROM eli")
def session_eligible(spark, d):
    l, o = X.ledger(spark, d)
    return P.eligible(l, o, _records(l, o), X.now())


@query("session_claim_batch", f"WITH {ELIGIBLE}, top AS (SELECT * FROM eli ORDER BY session_id LIMIT 10) SELECT t.session_id, t.lifecycle_count, t.observation_count, string_agg(event_type || '/' || receipt_id, ',' ORDER BY event_type, receipt_id) AS sources FROM top t JOIN led USING (session_id) GROUP BY ALL")
def session_claim_batch(spark, d):
    l, o = X.ledger(spark, d)
    c = P.claim_batch(P.eligible(l, o, _records(l, o), X.now()), l, o)
    return c.select("session_id", "lifecycle_count", "observation_count", F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["event_type"], s["receipt_id"])), ",").alias("sources"))


_NS = P.REVISION_NAMESPACE.replace("-", "")


#: A version-5 identifier of the bytes {0}, namespace included.
_UUID5 = "(SELECT substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', (('0x' || substr(u, 17, 1))::INTEGER & 3) + 1, 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12) FROM (SELECT sha1({0}) AS u))"


@query("session_source_revision", f"WITH {X.LEDGER}, f AS (SELECT session_id, string_agg(hex(encode(event_type)) || '00' || hex(encode(receipt_id)) || '0A', '' ORDER BY event_type, receipt_id) AS frames FROM led GROUP BY 1) SELECT session_id, " + _UUID5.format(f"unhex('{_NS}' || frames)") + " AS source_revision FROM f")
def session_source_revision(spark, d):
    l, o = X.ledger(spark, d)
    per = P.identities(l, o).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "receipt_id"))).alias("sources"))
    return per.select("session_id", P.revision(F.col("sources")).alias("source_revision"))


@query("session_transcript", f"WITH {X.LEDGER} SELECT session_id, receipt_id, event_type, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, CASE event_type WHEN 'session_start' THEN 0 WHEN 'observation' THEN 1 ELSE 2 END, receipt_id) AS INTEGER) AS position FROM led")
def session_transcript(spark, d):
    return P.transcript(*X.ledger(spark, d)).select("session_id", "receipt_id", "event_type", "position")


@query("session_memory_scope", f"WITH {X.LEDGER} SELECT session_id, receipt_id FROM led WHERE event_type = 'observation' AND CAST(receipt_id AS BIGINT) % 3 != 0")
def session_memory_scope(spark, d):
    _, o = X.ledger(spark, d)
    return P.memory_scope(o, o.filter(F.col("receipt_id").cast("long") % 3 == 0))


def _attempts(spark, d):
    c = X.read(spark, d, "customer")
    k = F.col("c_custkey")
    state = F.element_at(F.array(*[F.lit(s) for s in ("claimed", "staged", "publishing", "retryable", "complete", "superseded")]), (k % 6 + 1).cast("int"))
    at = lambda minutes: X.now() + F.make_interval(mins=minutes.cast("int"))
    return c.select(F.concat(F.lit("a"), k).alias("attempt_id"), F.when(k % 12 == 8, F.concat(F.lit("p"), k)).otherwise(F.concat(F.lit("s"), F.floor(k / 2))).alias("session_id"), F.concat(F.lit("r"), k).alias("source_revision"), state.alias("state"), F.concat(F.lit("t"), k % 10).alias("lease_token"), at(k % 7 - 3).alias("lease_expires_at"), F.when(k % 6 == 3, at(k % 5 - 2)).alias("next_attempt_at"), (k % 4).alias("lifecycle_count"), (k % 9).alias("observation_count"))


ATTEMPTS = f"""att AS (SELECT 'a' || c_custkey AS attempt_id, CASE WHEN c_custkey % 12 = 8 THEN 'p' || c_custkey ELSE 's' || CAST(c_custkey // 2 AS BIGINT) END AS session_id, 'r' || c_custkey AS source_revision, ['claimed', 'staged', 'publishing', 'retryable', 'complete', 'superseded'][c_custkey % 6 + 1] AS state, 't' || c_custkey % 10 AS lease_token,
 TIMESTAMP '{X.NOW}' + to_minutes(c_custkey % 7 - 3) AS lease_expires_at, CASE WHEN c_custkey % 6 = 3 THEN TIMESTAMP '{X.NOW}' + to_minutes(c_custkey % 5 - 2) END AS next_attempt_at, c_custkey % 4 AS lifecycle_count, c_custkey % 9 AS observation_count FROM customer)"""


def _one_open(spark, d):
    """Attempts as the claim finds them: one open attempt a session at most."""
    k = F.substring("attempt_id", 2, 20).cast("long")
    return _attempts(spark, d).filter((k % 6 >= 4) | ((F.floor(k / 2) % 2 == 0) == (k % 6).isin(0, 3)))


ONE_OPEN = "one AS (SELECT * FROM att WHERE CAST(substr(attempt_id, 2) AS BIGINT) % 6 >= 4 OR (CAST(substr(attempt_id, 2) AS BIGINT) // 2 % 2 = 0) = (CAST(substr(attempt_id, 2) AS BIGINT) % 6 IN (0, 3)))"


@query(
    "session_claim_states",
    f"""WITH {ATTEMPTS}, {ONE_OPEN}, req AS (SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 10 = 7 THEN 'n' || c_custkey // 20 ELSE 's' || c_custkey // 2 END AS session_id, CASE WHEN c_custkey % 5 IN (0, 2) THEN 'x' ELSE 'r' END || c_custkey AS source_revision FROM customer),
 open AS (SELECT * FROM one WHERE state NOT IN ('complete', 'superseded')),
 due AS (SELECT q.*, o.state, o.source_revision AS held, row_number() OVER (PARTITION BY q.session_id ORDER BY ordinal) AS nr FROM req q JOIN open o USING (session_id) WHERE (o.state = 'retryable' AND o.next_attempt_at <= TIMESTAMP '{X.NOW}') OR (o.state != 'retryable' AND o.lease_expires_at <= TIMESTAMP '{X.NOW}')),
 new AS (SELECT ordinal, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS nr FROM req q WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.session_id = q.session_id) AND NOT EXISTS (SELECT 1 FROM one o WHERE o.source_revision = q.source_revision))
 SELECT q.ordinal, q.session_id, q.source_revision, CASE WHEN u.state = 'retryable' THEN 'reclaimed_retryable' WHEN u.state IS NOT NULL THEN 'reclaimed_expired' WHEN n.nr IS NOT NULL THEN 'inserted' ELSE 'not_claimed' END AS outcome, CASE WHEN u.nr IS NOT NULL THEN u.held WHEN n.nr IS NOT NULL THEN q.source_revision END AS claimed_revision, CASE WHEN u.state = 'retryable' OR n.nr IS NOT NULL THEN 'claimed' ELSE u.state END AS new_state
 FROM req q LEFT JOIN due u ON u.ordinal = q.ordinal AND u.nr = 1 LEFT JOIN new n ON n.ordinal = q.ordinal AND n.nr = 1""",
)
def session_claim_states(spark, d):
    k = F.col("c_custkey")
    session = F.when(k % 10 == 7, F.concat(F.lit("n"), F.floor(k / 20))).otherwise(F.concat(F.lit("s"), F.floor(k / 2)))
    req = X.read(spark, d, "customer").select(k.alias("ordinal"), session.alias("session_id"), F.concat(F.when((k % 5).isin(0, 2), "x").otherwise("r"), k).alias("source_revision"), F.lit("t").alias("token"))
    return P.claim(_one_open(spark, d), req, X.now()).select("ordinal", "session_id", "source_revision", "outcome", "claimed_revision", "new_state")


@query("session_renew", f"WITH {ATTEMPTS} SELECT attempt_id, CASE WHEN lease_token = 't1' AND state IN ('claimed', 'staged', 'publishing') AND lease_expires_at > TIMESTAMP '{X.NOW}' THEN TIMESTAMP '{X.NOW}' + INTERVAL 600 SECOND ELSE lease_expires_at END AS lease_expires_at FROM att")
def session_renew(spark, d):
    return P.renew(_attempts(spark, d), "t1", X.now()).select("attempt_id", F.col("lease_expires_at").cast("timestamp_ntz").alias("lease_expires_at"))


@query(
    "session_promote",
    f"WITH {ATTEMPTS}, st AS (SELECT attempt_id FROM att WHERE CAST(substr(attempt_id, 2) AS BIGINT) % 12 = 2), ready AS (SELECT a.* FROM att a WHERE a.state = 'publishing' AND NOT EXISTS (SELECT 1 FROM st WHERE st.attempt_id = a.attempt_id) AND NOT EXISTS (SELECT 1 FROM att b WHERE b.session_id = a.session_id AND b.attempt_id != a.attempt_id AND b.state IN ('claimed', 'staged', 'publishing', 'retryable'))) SELECT attempt_id, session_id FROM ready",
)
def session_promote(spark, d):
    a = _attempts(spark, d)
    staged = a.filter(F.substring("attempt_id", 2, 20).cast("long") % 12 == 2).select("attempt_id", F.lit(None).cast("timestamp").alias("published_at"))
    records = a.filter("state = 'complete'").select("session_id", "source_revision", "lifecycle_count", "observation_count")
    return P.promote(a, staged, records)[1]


_CATEGORY = "['lease_lost', 'repository_invocation', 'provider_transient', 'memory_mismatch', 'source_conflict'][k % 5 + 1]"


@query(
    "session_retry",
    f"""WITH {ATTEMPTS}, f AS (SELECT *, CAST(substr(attempt_id, 2) AS BIGINT) AS k FROM att), g AS (SELECT *, {_CATEGORY} AS category, CASE WHEN k % 17 = 0 THEN 'other' ELSE lease_token END = lease_token AND k % 19 != 0 AND state IN ('claimed', 'staged', 'publishing') AND lease_expires_at > TIMESTAMP '{X.NOW}' AS held FROM f), h AS (SELECT *, held AND category NOT IN ('lease_lost', 'source_conflict') AS go FROM g)
 SELECT attempt_id, category, CASE WHEN go THEN 'retryable' ELSE 'skipped' END AS outcome, CASE WHEN go THEN 'retryable' ELSE state END AS state, CASE WHEN NOT go THEN next_attempt_at WHEN category = 'repository_invocation' THEN TIMESTAMP '{X.NOW}' + INTERVAL 600 SECOND ELSE TIMESTAMP '{X.NOW}' + to_seconds(60 + CAST(ceil(least(k * 7, 10000) / 1000.0) AS BIGINT)) END AS next_attempt_at FROM h""",
)
def session_retry(spark, d):
    a = _attempts(spark, d)
    k = F.substring("attempt_id", 2, 20).cast("long")
    category = F.element_at(F.array(*[F.lit(c) for c in ("lease_lost", "repository_invocation", "provider_transient", "memory_mismatch", "source_conflict")]), (k % 5 + 1).cast("int"))
    f = a.select("attempt_id", "session_id", F.when(k % 17 == 0, "other").otherwise(F.col("lease_token")).alias("lease_token"), F.when(k % 19 == 0, "elsewhere").otherwise(F.col("source_revision")).alias("source_revision"), category.alias("category"), (k * 7).alias("jitter_ms"))
    return P.retry(a, f, X.now()).withColumn("next_attempt_at", F.col("next_attempt_at").cast("timestamp_ntz"))


@query("session_promoted_records", ORACLE_SQL["session_promote"].rsplit("SELECT attempt_id, session_id FROM ready", 1)[0] + ", rec AS (SELECT session_id, source_revision, lifecycle_count, observation_count FROM att WHERE state = 'complete') SELECT coalesce(n.session_id, r.session_id) AS session_id, coalesce(n.source_revision, r.source_revision) AS source_revision, coalesce(n.lifecycle_count, r.lifecycle_count) AS lifecycle_count, coalesce(n.observation_count, r.observation_count) AS observation_count FROM ready n FULL JOIN rec r ON n.session_id = r.session_id")
def session_promoted_records(spark, d):
    a = _attempts(spark, d)
    staged = a.filter(F.substring("attempt_id", 2, 20).cast("long") % 12 == 2).select("attempt_id", F.lit(None).cast("timestamp").alias("published_at"))
    return P.promote(a, staged, a.filter("state = 'complete'").select("session_id", "source_revision", "lifecycle_count", "observation_count"))[0]


@query(
    "failure_taxonomy",
    f"WITH {ATTEMPTS}, f AS (SELECT * FROM (VALUES " + ", ".join(str((i, *x)) for i, x in enumerate(P.FAILURES)) + f") t(n, category, stage, retryability)) SELECT attempt_id, category, stage, retryability FROM att JOIN f ON CAST(substr(attempt_id, 2) AS BIGINT) % {len(P.FAILURES)} = n",
)
def failure_taxonomy(spark, d):
    """What each attempt's failure means, by its category."""
    k = F.substring("attempt_id", 2, 20).cast("long")
    names = F.array(*[F.lit(x[0]) for x in P.FAILURES])
    failed = _attempts(spark, d).select("attempt_id", F.element_at(names, (k % len(P.FAILURES) + 1).cast("int")).alias("category"))
    return failed.join(F.broadcast(P.failure_taxonomy(spark)), "category").select("attempt_id", "category", "stage", "retryability")


@query("session_transitions", f"WITH {ATTEMPTS}, t AS (SELECT * FROM (VALUES ('claimed','staged'),('claimed','retryable'),('claimed','superseded'),('staged','publishing'),('staged','retryable'),('publishing','complete'),('publishing','retryable'),('retryable','claimed')) v(f, t)), c AS (SELECT attempt_id, state AS from_state, ['claimed', 'staged', 'publishing', 'retryable', 'complete', 'superseded'][CAST(substr(attempt_id, 2) AS BIGINT) // 6 % 6 + 1] AS to_state FROM att) SELECT attempt_id, from_state, to_state, t.f IS NOT NULL AS legal FROM c LEFT JOIN t ON t.f = from_state AND t.t = to_state")
def session_transitions(spark, d):
    """Whether each attempt may go from its state to the one that is asked for."""
    k = F.substring("attempt_id", 2, 20).cast("long")
    s = F.array(*[F.lit(x) for x in ("claimed", "staged", "publishing", "retryable", "complete", "superseded")])
    return P.legal(_attempts(spark, d).select("attempt_id", F.col("state").alias("from_state"), F.element_at(s, (F.floor(k / 6) % 6 + 1).cast("int")).alias("to_state"))).select("attempt_id", "from_state", "to_state", "legal")


def _generated(spark, d):
    c = X.read(spark, d, "conversations")
    return c.select(F.concat(F.lit("s"), (F.col("conv_id") % 10)).alias("session_id"), F.col("role").alias("type"), F.concat(F.lit("\u00a0"), F.col("role"), F.lit(" \t")).alias("title"), F.concat(F.lit(" note "), (F.col("turn") % 3), F.lit("\n")).alias("content"), F.array(F.lit(" Beta"), F.lit("alpha"), F.concat(F.lit("T"), F.col("turn") % 3)).alias("concepts"), F.array(F.concat_ws("-", "conv_id", "turn")).alias("receipts"))


_FR = "lpad(to_hex(octet_length(encode({0}))), 16, '0') || hex(encode({0}))"

@query(
    "candidate_fingerprints",
    "WITH g AS (SELECT 's' || conv_id % 10 AS session_id, 'session-derived' AS type, role AS title, 'note ' || turn % 3 AS content, list_sort(['beta', 'alpha', 't' || turn % 3]) AS concepts, conv_id || '-' || turn AS receipt FROM conversations), f AS (SELECT *, sha256(unhex(" + " || ".join(_FR.format(x) for x in ("'1'", "type", "title", "content", "concepts[1]", "concepts[2]", "concepts[3]")) + ")) AS fingerprint FROM g), x AS (SELECT session_id, fingerprint, type, title, content, array_to_string(concepts, ',') AS concepts, array_to_string(list_sort(list(DISTINCT receipt)), ',') AS receipts FROM f GROUP BY session_id, fingerprint, type, title, content, concepts) SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY fingerprint) - 1 AS INTEGER) AS ordinal, " + _UUID5.format("unhex('" + _NS + "' || " + _FR.format("session_id") + " || lpad(to_hex(32), 16, '0') || fingerprint)") + " AS memory_id FROM x",
)
def candidate_fingerprints(spark, d):
    c = P.candidates(_generated(spark, d))
    return c.select("session_id", "fingerprint", "type", "title", "content", F.array_join("concepts", ",").alias("concepts"), F.array_join("receipts", ",").alias("receipts"), "ordinal", "memory_id")


_ENVELOPE = """'{"position":' || position || ',"fragment":' || %s || ',"kind":' || to_json(kind) || ',"content":'"""


@query(
    "session_chunks",
    f"""WITH RECURSIVE e AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS position, role AS kind, text AS content FROM conversations),
 c AS (SELECT session_id, position, i, strlen(CAST(to_json(substr(content, i, 1)) AS VARCHAR)) - 2 AS n FROM (SELECT *, unnest(range(1, length(content) + 1)) AS i FROM e)),
 s AS (SELECT session_id, position, i, sum(n) OVER (PARTITION BY session_id, position ORDER BY i) AS upto FROM c),
 u AS MATERIALIZED (SELECT e.*, coalesce(cs, []) AS cs FROM e LEFT JOIN (SELECT session_id, position, list(upto ORDER BY i) AS cs FROM s GROUP BY 1, 2) USING (session_id, position)),
 f AS (SELECT *, 0 AS n, 0 AS a0, len(list_filter(cs, lambda x: x <= 595 - strlen({_ENVELOPE % "'0'"}))) AS till FROM u
  UNION ALL SELECT * EXCLUDE (n, a0, till), n + 1, till, len(list_filter(cs, lambda x: x - cs[till] <= 595 - strlen({_ENVELOPE % "(n + 1)"}))) FROM f WHERE till < len(cs)),
 p AS MATERIALIZED (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY position, n) AS k, {_ENVELOPE % "n"} || to_json(substr(content, a0 + 1, till - a0)) || '}}' AS part FROM f),
 g AS (SELECT session_id, k, part, 0 AS chunk, 2 + strlen(part) AS size FROM p WHERE k = 1
  UNION ALL SELECT p.session_id, p.k, p.part, CASE WHEN size + strlen(p.part) + 1 <= 600 THEN chunk ELSE chunk + 1 END, CASE WHEN size + strlen(p.part) + 1 <= 600 THEN size + strlen(p.part) + 1 ELSE 2 + strlen(p.part) END FROM g JOIN p ON p.session_id = g.session_id AND p.k = g.k + 1)
 SELECT session_id, chunk, '[' || string_agg(part, ',' ORDER BY k) || ']' AS json FROM g GROUP BY 1, 2""",
)
def session_chunks(spark, d):
    c = X.read(spark, d, "conversations")
    return P.chunks(c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("position"), F.col("role").alias("kind"), F.col("text").alias("content")), 600)


@query("session_chunks_reduced", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n_turns FROM conversations GROUP BY 1")
def session_chunks_reduced(spark, d):
    """Chunks, a result of each, and their reduction level by level, with stand-ins for the model
    that only count: what is left of a session tells its characters and its turns."""
    c = X.read(spark, d, "conversations")
    parts = P.chunks(c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("position"), F.col("role").alias("kind"), F.col("text").alias("content")), 600)

    def told(chars, turns):
        return {"summary_sentences": [f"{chars} {turns}"], "concepts": [f"c{i}" for i in range(10)]}

    def generator(text):
        import json

        items = json.loads(text)
        return told(sum(len(x["content"]) for x in items), sum(x["fragment"] == 0 for x in items))

    def reducer(payload):
        import json

        n = [[int(y) for y in x["summary_sentences"][0].split()] for x in json.loads(payload)]
        return told(*map(sum, zip(*n, strict=True)))

    out = P.reduce(P.generate(parts, generator), reducer, 400).withColumn("n", F.split(F.col("summary_sentences")[0], " "))
    return out.select("session_id", F.col("n")[0].cast("long").alias("n_chars"), F.col("n")[1].cast("long").alias("n_turns"))


@query("sweep_tally", f"WITH {ATTEMPTS} SELECT count(*) FILTER (state IN ('staged', 'publishing')) AS staged, count(*) FILTER (state = 'complete') AS completed, count(*) FILTER (state = 'retryable') AS retryable, count(*) FILTER (state IN ('claimed', 'superseded')) AS skipped FROM att")
def sweep_tally(spark, d):
    s = F.col("state")
    return P.tally(_attempts(spark, d).select(F.when(s.isin("staged", "publishing"), "staged").when(s == "complete", "completed").when(s == "retryable", "retryable").otherwise("skipped").alias("outcome")))


def _queue(spark, d):
    e = X.read(spark, d, "events")
    k = F.col("event_id")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(k % 5 == 0, F.concat(ts, F.lit(".12Z"))).when(k % 5 == 1, F.concat(ts, F.lit(".123z"))).when(k % 5 == 2, F.concat(ts, F.lit(".123+24:00"))).when(k % 5 == 3, F.lit("2024-02-30T00:00:00.000Z")).otherwise(F.concat(ts, F.lit(".999-01:30")))
    obs = F.to_json(F.struct(F.lit("observation").alias("event_type"), F.concat(F.lit("u"), "user_id").alias("session_id"), F.lit("p").alias("project_name"), F.lit("/w").alias("current_working_directory"), stamp.alias("timestamp"), F.col("event_type").alias("hook_type"), F.from_json("props", "map<string,string>").alias("data")))
    obs = F.when(k % 14 == 4, F.regexp_replace(obs, r'"data":.*$', '"data":[1]}')).otherwise(obs)
    start = F.to_json(F.struct(F.lit("session_start").alias("event_type"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("u"), "user_id")).alias("session_id"), F.lit("").alias("project_name"), F.lit("/w").alias("current_working_directory"), stamp.alias("timestamp")))
    return e.select("event_id", F.when(k % 2 == 0, obs).otherwise(start).alias("json"), stamp.alias("stamp"))


_OK = "event_id % 5 IN (1, 4)"


@query("ledger_validate", f"SELECT event_id, CASE WHEN event_id % 2 = 1 AND event_id % 11 = 0 THEN 'session_id' WHEN NOT ({_OK}) THEN 'timestamp' WHEN event_id % 14 = 4 THEN 'data' END AS fault, CASE event_id % 5 WHEN 1 THEN epoch_ms(date_trunc('second', ts)) + 123 WHEN 4 THEN epoch_ms(date_trunc('second', ts)) + 999 + 5400000 ELSE -1 END AS epoch_ms FROM events")
def ledger_validate(spark, d):
    return L.validate(_queue(spark, d)).select("event_id", "fault", F.coalesce("epoch_ms", F.lit(-1)).alias("epoch_ms"))


_TYPES = (
    ("session_start", "s1", None), ("session_end", "s1", None), ("observation", "s1", None), ("session_start", 5, "session_id"), ("observation", {"a": 1}, "session_id"), ("session_end", "", "session_id"),
    ("observation", None, "session_id"), ("session_end", True, "session_id"), ("session_start", ["s"], "session_id"), ("session_end:extra", "s1", "fields"), ("observation:hook", "s1", None), ("observation:number", "s1", "hook_type"),
    ("session_end:project", "s1", "project_name"), ("observation:list", "s1", "data"), ("session_start:time", "s1", "timestamp"), ("started", "s1", "event_type"), ("session_start:twice", "s1", "not_an_object"),
)


def _typed(number: int) -> str:
    """The JSON text of one of ``_TYPES``, with the event's id in place of @."""
    import json

    (name, _, change), session = _TYPES[number][0].partition(":"), _TYPES[number][1]
    e = {"event_type": name, "session_id": session, "project_name": "p@", "current_working_directory": "", "timestamp": "2024-05-01T00:00:00.000Z"}
    if name == "observation":
        e |= {"hook_type": "h", "data": {"n": 1}}
    e |= {"extra": {"hook_type": "h"}, "hook": {"hook_type": ""}, "number": {"hook_type": 7}, "project": {"project_name": None}, "list": {"data": [1]}, "time": {"timestamp": 1714521600000}}.get(change, {})
    text = json.dumps(e)
    return text[:-1] + ', "session_id": "s2"}' if change == "twice" else text


@query("ledger_types", "SELECT event_id, CASE event_id % 17 " + " ".join(f"WHEN {i} THEN '{fault}'" for i, (_, _, fault) in enumerate(_TYPES) if fault) + " END AS fault, CASE WHEN event_id % 17 IN (0, 1) THEN 'session_events' WHEN event_id % 17 IN (2, 10) THEN 'raw_observations' END AS target FROM events")
def ledger_types(spark, d):
    """Events of each kind with fields of wrong types: only strings are strings."""
    made = spark.createDataFrame([(i, _typed(i)) for i in range(len(_TYPES))], "m int, json string")
    e = X.read(spark, d, "events").select("event_id")
    e = e.join(F.broadcast(made), F.col("event_id") % 17 == F.col("m")).select("event_id", F.replace("json", F.lit("@"), F.col("event_id").cast("string")).alias("json"))
    return L.validate(e).select("event_id", "fault", F.when(F.col("fault").isNull(), F.when(F.col("event_type") == "observation", "raw_observations").otherwise("session_events")).alias("target"))


@query("observation_route", f"SELECT CASE WHEN event_id % 2 = 0 THEN 'raw_observations' ELSE 'session_events' END AS target, count(*) AS n FROM events WHERE {_OK} AND NOT (event_id % 2 = 1 AND event_id % 11 = 0) AND event_id % 14 != 4 GROUP BY 1")
def observation_route(spark, d):
    a, b = L.route(L.validate(_queue(spark, d)), X.now())
    return a.select(F.lit("session_events").alias("target")).unionByName(b.select(F.lit("raw_observations").alias("target"))).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("json_doubles", "SELECT event_id, '{\"k\":' || CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) AS VARCHAR) || '}' AS data FROM events")
def json_doubles(spark, d):
    return X.read(spark, d, "events").select("event_id", L.doubles(F.col("props")).alias("data"))


@query(
    "adapter_session_metadata",
    "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN '/home/u' || user_id || '/p' || event_id % 4 || '/' END AS own, CASE WHEN event_id % 4 = 1 THEN 'C:\\work\\tree' || event_id % 2 END AS worktree FROM events), f AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '/plugin') AS cwd FROM e) SELECT session_id, seq, cwd, coalesce(nullif(regexp_extract(worktree, '([^/\\\\]+)[/\\\\]*$', 1), ''), nullif(regexp_extract(cwd, '([^/\\\\]+)[/\\\\]*$', 1), '')) AS project FROM f",
)
def adapter_session_metadata(spark, d):
    e = X.read(spark, d, "events")
    k = F.col("event_id")
    e = e.select(F.col("user_id").cast("string").alias("session_id"), k.alias("seq"), F.lit(None).cast("string").alias("event_dir"), F.when(k % 3 == 0, F.concat(F.lit("/home/u"), "user_id", F.lit("/p"), k % 4, F.lit("/"))).alias("wrapper_dir"), F.when(k % 4 == 1, F.concat(F.lit("C:\\work\\tree"), k % 2)).alias("worktree"), F.lit("/plugin").alias("plugin_dir"))
    return L.session_metadata(e).select("session_id", "seq", "cwd", "project")


_KIND = "CASE event_type WHEN 'signup' THEN 'session.created' WHEN 'error' THEN 'session.deleted' WHEN 'view' THEN 'message.part.updated' WHEN 'click' THEN 'message.updated' ELSE 'file.edited' END"


def _adapter(spark, d):
    return X.read(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"), F.when(F.col("event_id") % 2 == 0, "x").alias("delta"))


@query(
    "adapter_derived_events",
    f"WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, {_KIND} AS kind FROM events), k AS (SELECT * FROM e WHERE kind != 'file.edited' AND NOT (kind = 'message.part.updated' AND seq % 2 = 0)) SELECT session_id, seq, CASE WHEN kind = 'session.created' THEN 1 ELSE 0 END AS ordinal, 'observation' AS event_type, 'opencode.v1.' || kind AS hook_type FROM k UNION ALL SELECT session_id, seq, 0, 'session_start', NULL FROM k WHERE kind = 'session.created' UNION ALL SELECT session_id, seq, 1, 'session_end', NULL FROM k WHERE kind = 'session.deleted'",
)
def adapter_derived_events(spark, d):
    return L.derived(_adapter(spark, d))


@query(
    "session_ordered_runtime",
    f"""WITH {X.LEDGER}, e AS (SELECT session_id, CAST(receipt_id AS BIGINT) AS seq, event_type, min(CAST(receipt_id AS BIGINT)) FILTER (event_type != 'session_end') OVER (PARTITION BY session_id) AS s_at FROM led),
 f AS (SELECT *, min(seq) FILTER (event_type = 'session_end' AND seq > s_at) OVER (PARTITION BY session_id) AS e_at FROM e),
 g AS (SELECT * FROM f WHERE s_at IS NOT NULL AND seq >= s_at AND (e_at IS NULL OR seq <= e_at) AND NOT (event_type = 'session_start' AND seq > s_at))
 SELECT session_id, seq, 0 AS ordinal, CASE WHEN event_type = 'observation' AND seq = s_at THEN 'session_start' ELSE event_type END AS emitted FROM g UNION ALL SELECT session_id, seq, 1, 'observation' FROM g WHERE event_type = 'observation' AND seq = s_at""",
)
def session_ordered_runtime(spark, d):
    l, o = X.ledger(spark, d)
    both = l.unionByName(o).select("session_id", F.col("receipt_id").cast("long").alias("seq"), "event_type")
    return L.ordered_runtime(both)


@query(
    "row_change_reasons",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unrelated' WHEN o_orderkey % 7 = 0 THEN 'unrelated' WHEN o_orderkey % 5 = 0 THEN 'truncated' WHEN o_orderkey % 17 = 0 THEN 'oversized' WHEN o_orderkey % 3 = 0 THEN 'duplicate' WHEN o_orderkey % 13 = 0 THEN 'malformed' END AS reason FROM orders",
)
def row_change_reasons(spark, d):
    o = X.read(spark, d, "orders")
    k = F.col("o_orderkey")
    key = lambda v: F.struct(k.cast("string").alias("id"), F.lit(v).alias("version"))
    e = o.select(k, F.when(k % 11 == 0, "other").otherwise("main").alias("db"), F.lit("PUBLIC.Memories").alias("table"), F.when(k % 7 == 0, "INSERT").otherwise("insert").alias("op"), F.when(k % 13 == 0, 3).otherwise(2).cast("long").alias("affected_rows"), F.when(k % 17 == 0, F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.struct(k.cast("string").alias("id"), i.cast("string").alias("version")))).when(k % 3 == 0, F.array(key("1"), key("1"))).otherwise(F.array(key("1"), key("2"))).alias("returning"), F.lit(1700000000000).alias("at"), F.when(k % 5 == 0, True).alias("truncated"))
    return L.row_changes(e, "main", "memories", 16).select("o_orderkey", "reason")
