"""Queries over graph reads by key, publishing, and the third adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import graph_reads as R
from ..operators import ledger as L
from ..operators import memory as M
from ..operators import session_adapter as A
from ..operators import publishing as B
from ..operators import session as P
from ..operators import session_queue as Q
from . import fixtures as X
from .session_queries import ATTEMPTS, _attempts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _alias_rows(spark, d):
    """Three aliases a customer: its name, the preferred one; its number; its key."""
    c = X.read(spark, d, "customer")
    k = F.col("c_custkey")
    each = F.array(
        F.struct(F.lower("c_name").alias("alias_key"), F.col("c_name").alias("display_text"), F.lit(True).alias("is_preferred")),
        F.struct(F.concat(F.lit("nr "), k).alias("alias_key"), F.concat(F.lit("Nr  "), k).alias("display_text"), F.lit(False).alias("is_preferred")),
        F.struct(F.concat(F.lit("customer:"), k).alias("alias_key"), F.concat(F.lit("CUSTOMER:"), k).alias("display_text"), F.lit(False).alias("is_preferred")),
    )
    return c.select(F.concat(F.lit("customer:"), k).alias("concept_id"), F.explode(each).alias("a")).select("concept_id", "a.*")


_ALIASES = """ali AS (SELECT 'customer:' || c_custkey AS concept_id, lower(c_name) AS alias_key, c_name AS display_text, true AS preferred FROM customer
 UNION ALL SELECT 'customer:' || c_custkey, 'nr ' || c_custkey, 'Nr  ' || c_custkey, false FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'customer:' || c_custkey, 'CUSTOMER:' || c_custkey, false FROM customer),
 named AS (SELECT concept_id, string_agg(display_text || '/' || preferred, ',' ORDER BY preferred DESC, alias_key) AS aliases FROM ali GROUP BY 1)"""


def _flat(reads):
    """Results as text, so that both engines show them alike."""
    a = F.array_join(F.transform("result.aliases", lambda a: F.concat_ws("/", a["display_text"], a["preferred"].cast("string"))), ",")
    return reads.select("ordinal", "outcome", F.col("result.id").alias("id"), F.coalesce("result.revision", F.lit(-1)).alias("revision"), F.when(F.col("result").isNotNull(), a).alias("aliases"))


@query("graph_get_concept", f"WITH {_ALIASES} SELECT c_custkey AS ordinal, 'complete' AS outcome, CASE WHEN c_custkey % 4 != 0 THEN 'customer:' || c_custkey END AS id, CASE WHEN c_custkey % 4 != 0 THEN CAST(1 AS BIGINT) ELSE -1 END AS revision, CASE WHEN c_custkey % 4 != 0 THEN aliases END AS aliases FROM customer JOIN named ON concept_id = 'customer:' || c_custkey")
def graph_get_concept(spark, d):
    c, _ = X.graph(spark, d)
    k = F.col("c_custkey")
    req = X.read(spark, d, "customer").select(k.alias("ordinal"), F.concat(F.when(k % 4 == 0, "nobody:").otherwise("customer:"), k).alias("id"))
    return _flat(R.get_concepts(c, _alias_rows(spark, d), req))


@query("graph_resolve_alias", f"WITH {_ALIASES} SELECT c_custkey AS ordinal, 'complete' AS outcome, CASE WHEN c_custkey % 3 != 2 THEN 'customer:' || c_custkey END AS id, CASE WHEN c_custkey % 3 != 2 THEN CAST(1 AS BIGINT) ELSE -1 END AS revision, CASE WHEN c_custkey % 3 != 2 THEN aliases END AS aliases FROM customer JOIN named ON concept_id = 'customer:' || c_custkey")
def graph_resolve_alias(spark, d):
    c, _ = X.graph(spark, d)
    k = F.col("c_custkey")
    # white space, case and full-width letters don't matter; white space alone has no key
    text = F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t"))).when(k % 3 == 1, F.concat(F.lit("ＮＲ   "), k)).when(k % 2 == 0, " 　").otherwise("no such name")
    return _flat(R.resolve_aliases(c, _alias_rows(spark, d), X.read(spark, d, "customer").select(k.alias("ordinal"), text.alias("text"))))


def _sources(spark, d):
    """As in the provenance fixture; every eleventh order stands for a session record."""
    s, e, m = X.provenance(spark, d)
    record = F.col("source_ref_id") % 11 == 0
    return s.withColumns({"source_kind": F.when(record, "session_record").otherwise(F.col("source_kind")), "external_version": F.when(~record, F.col("external_version"))}), e


_SOURCES = """sor AS (SELECT o_orderkey AS id, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'session_record' ELSE 'memory_version' END AS kind, CAST(o_orderkey AS VARCHAR) AS ext, CASE WHEN o_orderkey % 11 != 0 AND o_orderkey % 7 != 0 THEN o_orderkey % 5 + 1 END AS ver FROM orders)"""


def _shown(x):
    return F.concat_ws("/", x["kind"], x["memory_id"], x["version"].cast("string"), x["session_record_id"])


@query(
    "graph_get_assertion",
    f"WITH {_SOURCES}, per AS (SELECT o_custkey, string_agg(concat_ws('/', kind, CASE WHEN kind = 'memory_version' THEN ext END, ver, CASE WHEN kind = 'session_record' THEN ext END), ',' ORDER BY kind, ext, ver NULLS FIRST) AS ev FROM sor GROUP BY 1) SELECT c_custkey AS ordinal, 'complete' AS outcome, CASE WHEN c_custkey % 5 != 0 THEN 'customer:' || c_custkey END AS subject, CASE WHEN c_custkey % 5 != 0 THEN 'part_of' END AS relation, CASE WHEN c_custkey % 5 != 0 THEN 'nation:' || c_nationkey END AS object, CASE WHEN c_custkey % 5 != 0 THEN coalesce(ev, '') END AS evidence FROM customer LEFT JOIN per ON o_custkey = c_custkey",
)
def graph_get_assertion(spark, d):
    _, a = X.graph(spark, d)
    s, e = _sources(spark, d)
    k = F.col("c_custkey")
    req = X.read(spark, d, "customer").select(k.alias("ordinal"), F.concat(F.when(k % 5 == 0, "none").otherwise("c"), k).alias("id"))
    r = R.get_assertions(a, e, s, req)
    return r.select("ordinal", "outcome", F.col("result.subject_concept_id").alias("subject"), F.col("result.relation_type").alias("relation"), F.col("result.object_concept_id").alias("object"), F.when(F.col("result").isNotNull(), F.array_join(F.transform("result.evidence", _shown), ",")).alias("evidence"))


@query("graph_get_source", f"WITH {_SOURCES} SELECT id AS ordinal, 'complete' AS outcome, CASE WHEN id % 3 != 0 OR ver IS NULL THEN concat_ws('/', kind, CASE WHEN kind = 'memory_version' THEN ext END, ver, CASE WHEN kind = 'session_record' THEN ext END) END AS source FROM sor")
def graph_get_source(spark, d):
    s, _ = _sources(spark, d)
    # every third request asks for a source without version
    req = s.select(F.col("source_ref_id").alias("ordinal"), "source_kind", "external_id", F.when(F.col("source_ref_id") % 3 != 0, F.col("external_version")).alias("external_version"))
    r = R.get_sources(s, req)
    return r.select("ordinal", "outcome", F.when(F.col("result").isNotNull(), _shown(F.col("result"))).alias("source"))


@query(
    "graph_payload_guard",
    "WITH r AS (SELECT doc_id AS ordinal, octet_length(encode('{\"outcome\":\"complete\",\"result\":' || CAST(to_json({'text': text}) AS VARCHAR) || '}')) AS n, text FROM documents) SELECT ordinal, CASE WHEN n > 3000 THEN 'result_too_large' ELSE 'complete' END AS outcome, CASE WHEN n <= 3000 THEN length(text) ELSE -1 END AS n_chars FROM r",
)
def graph_payload_guard(spark, d):
    r = R.guarded(X.read(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.struct("text").alias("result")), 3000)
    return r.select("ordinal", "outcome", F.coalesce(F.length("result.text").cast("long"), F.lit(-1)).alias("n_chars"))


@query(
    "graph_alias_sets",
    "SELECT c_custkey AS ordinal, CASE c_custkey % 7 WHEN 0 THEN 'alias_set:empty' WHEN 1 THEN 'alias_set:too_long' WHEN 2 THEN 'alias:invalid' WHEN 3 THEN 'alias_set:invalid_shape' WHEN 4 THEN 'preferred_alias:invalid_shape' WHEN 5 THEN 'preferred_alias:invalid_shape' END AS fault, CASE WHEN c_custkey % 7 = 6 THEN lower(c_name) || ',other' END AS keys, CASE WHEN c_custkey % 7 = 6 THEN lower(c_name) END AS preferred_key FROM customer",
)
def graph_alias_sets(spark, d):
    c = X.read(spark, d, "customer")
    a = lambda text, preferred: F.struct(text.alias("display_text"), F.lit(preferred).alias("preferred"))
    name, other, k = F.col("c_name"), F.lit("Other"), F.col("c_custkey") % 7
    sets = F.when(k == 0, F.array().cast("array<struct<display_text:string,preferred:boolean>>")).when(k == 1, F.transform(F.sequence(F.lit(1), F.lit(65)), lambda i: F.struct(i.cast("string").alias("display_text"), (i == 1).alias("preferred")))).when(k == 2, F.array(a(name, True), a(F.lit(" \t"), False))).when(k == 3, F.array(a(name, True), a(F.upper(name), False))).when(k == 4, F.array(a(name, False), a(other, False))).when(k == 5, F.array(a(name, True), a(other, True))).otherwise(F.array(a(name, True), a(other, False)))
    r = R.alias_set_faults(c.select(F.col("c_custkey").alias("ordinal"), sets.alias("aliases")))
    return r.select("ordinal", "fault", F.array_join("keys", ",").alias("keys"), "preferred_key")


@query(
    "graph_neighbor_records",
    f"WITH {X.ASSERTIONS}, n AS (SELECT relation, 'incoming' AS orientation, subject AS neighbor, id AS assertion_id FROM asr WHERE object = 'nation:3' UNION ALL SELECT relation, 'outgoing', object, id FROM asr WHERE subject = 'nation:3'), t AS (SELECT *, CAST(row_number() OVER (ORDER BY relation, orientation, neighbor, assertion_id) AS INTEGER) AS rank FROM n ORDER BY rank LIMIT 256), ev AS (SELECT 'c' || o_custkey AS assertion_id, count(*) AS n_evidence FROM orders GROUP BY 1) SELECT rank, relation, orientation, neighbor, CAST(1 AS BIGINT) AS revision, c_name AS name, t.assertion_id, coalesce(n_evidence, 0) AS n_evidence FROM t LEFT JOIN customer ON neighbor = 'customer:' || c_custkey LEFT JOIN ev ON ev.assertion_id = t.assertion_id",
)
def graph_neighbor_records(spark, d):
    c, a = X.graph(spark, d)
    s, e, _ = X.provenance(spark, d)
    return R.neighbor_records(G.neighbors(a, "nation:3"), c, _alias_rows(spark, d), e, s)


@query("graph_order_faults", "SELECT CAST(n_nationkey + 1 AS INTEGER) AS rank, 'order' AS fault FROM (SELECT *, lag(n_name) OVER (ORDER BY n_nationkey) AS before FROM nation) WHERE before > n_name")
def graph_order_faults(spark, d):
    n = X.read(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("rank"), "n_name")
    return R.order_faults(n, ["n_name"])


def _loaded(spark, d):
    a = _attempts(spark, d)
    k = F.substring("attempt_id", 2, 20).cast("long")
    return a.select("attempt_id", F.when(k % 8 == 5, "other").otherwise(F.col("lease_token")).alias("lease_token"), F.when(k % 4 == 1, "moved").otherwise(F.col("source_revision")).alias("source_revision"), "lifecycle_count", (F.col("observation_count") + F.when(k % 4 == 3, 1).otherwise(0)).alias("observation_count"))


@query(
    "session_supersede",
    f"WITH {ATTEMPTS}, k AS (SELECT *, CAST(substr(attempt_id, 2) AS BIGINT) AS k FROM att), o AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'current' WHEN state = 'claimed' THEN CASE WHEN k % 8 = 5 THEN 'lease_lost' ELSE 'superseded' END WHEN state IN ('staged', 'publishing') THEN 'unconfirmed_commit' ELSE 'invalid_response' END AS outcome FROM k) SELECT attempt_id, outcome, CASE WHEN outcome = 'superseded' THEN 'superseded' ELSE state END AS state FROM o",
)
def session_supersede(spark, d):
    # every second customer, so that claimed attempts meet every case
    return B.supersede(_shifted(spark, d), _loaded(spark, d)).select("attempt_id", "outcome", "state")


def _shifted(spark, d):
    """Attempts whose states don't go with the parity of their number."""
    k = F.substring("attempt_id", 2, 20).cast("long")
    states = F.array(*[F.lit(s) for s in ("claimed", "staged", "publishing", "retryable", "complete", "superseded")])
    return _attempts(spark, d).withColumn("state", F.element_at(states, (F.floor(k / 2) % 6 + 1).cast("int")))


ORACLE_SQL["session_supersede"] = ORACLE_SQL["session_supersede"].replace("SELECT *, CAST(substr(attempt_id, 2) AS BIGINT) AS k FROM att", "SELECT * REPLACE (['claimed', 'staged', 'publishing', 'retryable', 'complete', 'superseded'][CAST(substr(attempt_id, 2) AS BIGINT) // 2 % 6 + 1] AS state), CAST(substr(attempt_id, 2) AS BIGINT) AS k FROM att")


def _candidates(spark, d):
    """Three candidates an attempt; some are published."""
    k = F.col("c_custkey")
    at = F.when((k + F.col("ordinal")) % 3 == 0, X.now() - F.make_interval(mins=F.col("ordinal") + 1))
    c = X.read(spark, d, "customer").filter("c_custkey % 7 != 6").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal"))
    return c.select(F.concat(F.lit("a"), k).alias("attempt_id"), "ordinal", F.concat_ws("-", F.lit("f"), k, "ordinal").alias("fingerprint"), F.concat_ws("-", F.lit("m"), k, "ordinal").alias("memory_id"), at.alias("published_at"))


_CANDIDATES = f"cand AS (SELECT 'a' || c_custkey AS attempt_id, o AS ordinal, 'f-' || c_custkey || '-' || o AS fingerprint, 'm-' || c_custkey || '-' || o AS memory_id, CASE WHEN (c_custkey + o) % 3 = 0 THEN TIMESTAMP '{X.NOW}' - to_minutes(o + 1) END AS published_at FROM customer, (VALUES (0), (1), (2)) v(o) WHERE c_custkey % 7 != 6)"


def _holders(spark, d):
    """Claims: some with another token or revision."""
    a = _attempts(spark, d)
    k = F.substring("attempt_id", 2, 20).cast("long")
    return a.select("attempt_id", "session_id", F.when(k % 9 == 4, "other").otherwise(F.col("lease_token")).alias("lease_token"), F.when(k % 9 == 7, "moved").otherwise(F.col("source_revision")).alias("source_revision"))


_FENCED = "held AS (SELECT attempt_id, session_id FROM att WHERE state IN ('staged', 'publishing') AND CAST(substr(attempt_id, 2) AS BIGINT) % 9 NOT IN (4, 7))"


@query("session_load_unpublished", f"WITH {ATTEMPTS}, {_CANDIDATES}, {_FENCED} SELECT h.attempt_id, 'publishing' AS state, coalesce(string_agg(ordinal || '/' || fingerprint || '/' || memory_id, ',' ORDER BY ordinal), '') AS candidates FROM held h LEFT JOIN cand c ON c.attempt_id = h.attempt_id AND published_at IS NULL GROUP BY 1")
def session_load_unpublished(spark, d):
    r = B.load_unpublished(_attempts(spark, d), _candidates(spark, d), _holders(spark, d))
    return r.select("attempt_id", "state", F.array_join(F.transform("candidates", lambda c: F.concat_ws("/", c["ordinal"].cast("string"), c["fingerprint"], c["memory_id"])), ",").alias("candidates"))


@query("session_mark_published", f"WITH {ATTEMPTS}, {_CANDIDATES}, {_FENCED} SELECT attempt_id, memory_id, coalesce(published_at, TIMESTAMP '{X.NOW}') AS published_at, 'publishing' AS state FROM held JOIN cand USING (attempt_id) WHERE ordinal < 2")
def session_mark_published(spark, d):
    k = F.substring("attempt_id", 2, 20)
    req = _holders(spark, d).withColumn("memory_id", F.explode(F.array(F.concat_ws("-", F.lit("m"), k, F.lit("0")), F.concat_ws("-", F.lit("m"), k, F.lit("1")), F.lit("unknown"))))
    return B.mark_published(_attempts(spark, d), _candidates(spark, d), req, X.now()).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("session_stage", f"WITH {ATTEMPTS}, ok AS (SELECT attempt_id, session_id, CAST(substr(attempt_id, 2) AS BIGINT) AS k FROM att WHERE state = 'claimed' AND CAST(substr(attempt_id, 2) AS BIGINT) % 9 NOT IN (4, 7)) SELECT attempt_id, CAST(o AS INTEGER) AS ordinal, session_id, fingerprint, 'm' || o AS memory_id FROM (SELECT *, CASE o WHEN 0 THEN 'stored' WHEN 1 THEN 'f' || k WHEN 2 THEN 'f' || k ELSE 'g' || k END AS fingerprint FROM ok, (VALUES (0), (1), (2), (3)) v(o)) WHERE o IN (1, 3)")
def session_stage(spark, d):
    a = _attempts(spark, d)
    k = F.substring("attempt_id", 2, 20)
    c = lambda fp, n: F.struct(fp.alias("fingerprint"), F.lit(f"m{n}").alias("memory_id"))
    req = _holders(spark, d).withColumn("candidates", F.array(c(F.lit("stored"), 0), c(F.concat(F.lit("f"), k), 1), c(F.concat(F.lit("f"), k), 2), c(F.concat(F.lit("g"), k), 3)))
    existing = a.select("session_id", F.lit("stored").alias("fingerprint")).distinct()
    return B.stage(a, existing, req)[1]


def _versions(spark, d):
    """Whole memory versions of conversations."""
    m = X.memories(spark, d)
    t = X.now()
    empty = F.array().cast("array<string>")
    return m.withColumns({"created_at": t, "updated_at": t, "files": empty, "session_ids": F.array("id"), "source_observation_ids": empty}).select(*B.MEMORY_FIELDS)


@query("memory_publish", "SELECT conv_id * 10 + turn AS ordinal, CASE WHEN text = '' THEN 'unknown' WHEN turn >= 6 THEN 'inserted' WHEN turn % 3 = 0 THEN 'existing_equivalent' ELSE 'mismatch' END AS outcome FROM conversations UNION ALL SELECT 1000000000 + conv_id * 10 + turn, CASE WHEN text = '' THEN 'unknown' WHEN turn >= 6 THEN 'existing_equivalent' WHEN turn % 3 = 0 THEN 'existing_equivalent' ELSE 'mismatch' END FROM conversations")
def memory_publish(spark, d):
    v = _versions(spark, d)
    turn = F.col("version") - 1
    # another list of files, or another time, is another version
    req = v.withColumns({"files": F.when((turn < 6) & (turn % 3 == 1), F.array(F.lit("f"))).otherwise(F.col("files")), "updated_at": F.when((turn < 6) & (turn % 3 == 2), F.col("updated_at") + F.expr("INTERVAL 1 MICROSECOND")).otherwise(F.col("updated_at"))})
    req = req.withColumn("ordinal", F.col("id").cast("long") * 10 + turn)
    req = req.unionByName(req.withColumn("ordinal", F.col("ordinal") + 1_000_000_000))
    return B.publish(v.filter(F.col("version") <= 6), req)


@query("session_source_cutoff", f"WITH {X.LEDGER} SELECT session_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS source_cutoff FROM led GROUP BY 1")
def session_source_cutoff(spark, d):
    l, o = X.ledger(spark, d)
    c = B.source_cutoff(l.select("session_id", "ingested_at").unionByName(o.select("session_id", "ingested_at")))
    return c.select("session_id", M.rendered_time(F.col("source_cutoff")).alias("source_cutoff"))


_FAULTS = ("", "supporting_receipt_ids:empty", "supporting_receipt_ids:outside_memory_scope", "supporting_receipt_ids:duplicate", "concepts:empty", "title:empty", "content:contains_nul", "canonical_payload:invalid")


@query("candidate_faults", "SELECT conv_id * 10 + turn AS ordinal, CASE turn % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FAULTS) if f) + " END AS fault FROM conversations")
def candidate_faults(spark, d):
    """A list of no concepts is valid; a blank concept, repeated and foreign receipts are not."""
    c = X.read(spark, d, "conversations")
    t, key = F.col("turn") % 8, F.concat_ws("-", "conv_id", "turn")
    none = F.array().cast("array<string>")
    receipts = F.when(t == 1, none).when(t == 2, F.array(key, F.lit("elsewhere"))).when(t == 3, F.array(key, key)).otherwise(F.array(key))
    cand = c.select((F.col("conv_id") * 10 + F.col("turn")).alias("ordinal"), F.concat(F.lit("s"), "conv_id").alias("session_id"), F.when(t == 5, "").when(t == 7, "\u2003 ").otherwise("title").alias("title"), F.when(t == 6, "a\0b").otherwise("text").alias("content"), F.when(t == 0, none).when(t == 4, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array("role")).alias("concepts"), receipts.alias("receipts"))
    scope = c.select(F.concat(F.lit("s"), "conv_id").alias("session_id"), key.alias("receipt_id"))
    return P.candidate_faults(cand, scope).select("ordinal", "fault")


@query("embedding_write_outcomes", "SELECT vec_id AS ordinal, CASE vec_id % 5 WHEN 0 THEN 'stored' WHEN 1 THEN 'already_present' WHEN 2 THEN 'missing_parent' WHEN 3 THEN 'malformed_response' ELSE 'backend' END AS outcome, vec_id % 5 >= 2 AS failed FROM embeddings")
def embedding_write_outcomes(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("inserted", "conflict", "missing", "invalid", "database_failure")]), (F.col("vec_id") % 5 + 1).cast("int"))
    return M.write_outcomes(X.read(spark, d, "embeddings").select(F.col("vec_id").alias("ordinal"), raw.alias("outcome"))).select("ordinal", "outcome", "failed")


@query("embedding_event_outcome", "SELECT event_id // 100 AS event, count(*) AS selected, count(*) FILTER (event_id % 10 < 6) AS stored, count(*) FILTER (event_id % 10 IN (6, 7, 8)) AS already_present, CASE WHEN min(CASE WHEN event_id % 97 = 0 AND event_id % 10 < 6 THEN event_id END) IS NOT NULL THEN 'backend' WHEN bool_or(event_id % 10 = 9) THEN 'missing' END AS error FROM events GROUP BY 1")
def embedding_event_outcome(spark, d):
    k = F.col("event_id")
    rows = X.read(spark, d, "events").select(F.floor(k / 100).alias("event"), k.alias("ordinal"), F.when(k % 10 < 6, "stored").when(k % 10 < 9, "already_present").otherwise("missing").alias("state"), F.when((k % 97 == 0) & (k % 10 < 6), "backend").alias("fault"))
    return M.event_outcomes(rows)


@query("memory_rows_all_or_nothing", "SELECT count(*) AS n, CASE WHEN count(*) FILTER (turn = 5) > 0 THEN 'version:not_positive' END AS fault FROM conversations")
def memory_rows_all_or_nothing(spark, d):
    v = _versions(spark, d)
    bad = v.withColumn("version", F.when(F.col("version") == 6, 0).otherwise(F.col("version")).cast("long"))
    return M.decode_gate(bad)


@query("distinct_source_keys", "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderkey % 11 = 0, o_orderkey % 100, CASE WHEN o_orderkey % 7 != 0 THEN o_orderkey % 5 + 1 END FROM orders)")
def distinct_source_keys(spark, d):
    k = F.col("o_orderkey")
    # a struct counts rows with a null field, which several columns would leave out
    return X.read(spark, d, "orders").agg(F.countDistinct(F.struct((k % 11 == 0).alias("a"), (k % 100).alias("b"), F.when(k % 7 != 0, k % 5 + 1).alias("c"))).alias("n"))


def _native(spark, d):
    e = X.read(spark, d, "events")
    k = F.col("event_id")
    kinds = [*A.OBSERVATIONS, "session_start", "session_shutdown", "message_end", "input", "tool_call", None]
    kind = F.element_at(F.array(*[F.lit(x).cast("string") for x in kinds]), (k % len(kinds) + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("session_id"), k.alias("seq"), kind.alias("type"), F.when(k % 3 == 0, "user").when(k % 3 == 1, "assistant").otherwise("toolResult").alias("role"))


_N_KINDS = len(A.OBSERVATIONS) + 6


@query("adapter3_classify", f"SELECT event_id AS seq, CASE WHEN event_id % {_N_KINDS} < {len(A.OBSERVATIONS)} THEN 'observation' WHEN event_id % {_N_KINDS} = {len(A.OBSERVATIONS)} THEN 'start' WHEN event_id % {_N_KINDS} = {len(A.OBSERVATIONS) + 1} THEN 'end' WHEN event_id % {_N_KINDS} = {len(A.OBSERVATIONS) + 2} AND event_id % 3 < 2 THEN 'observation' ELSE 'excluded' END AS selection FROM events")
def adapter3_classify(spark, d):
    return A.classify(_native(spark, d)).select("seq", "selection")


@query("adapter3_text_content", "SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'plain ' || event_type WHEN 1 THEN event_type || '+' WHEN 2 THEN '' END AS text FROM events")
def adapter3_text_content(spark, d):
    k = F.col("event_id")
    b = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))
    blocks = F.when(k % 4 == 1, F.array(b("text", F.col("event_type")), b("thinking", F.lit(None)), b("text", F.lit("+")))).when(k % 4 == 2, F.array(b("image", F.lit(None)))).when(k % 4 == 3, F.array(b("text", F.lit("x")), b("video", F.lit(None))))
    e = X.read(spark, d, "events").select(k.alias("seq"), F.when(k % 4 == 0, F.concat(F.lit("plain "), "event_type")).alias("content"), blocks.alias("blocks"))
    return e.select("seq", A.text_content(F.col("content"), F.col("blocks"), ("image", "thinking")).alias("text"))


def _projections() -> list[tuple[str, str, str | None, str | None]]:
    """(kind, native JSON, payload JSON, fault) with @ for the event's id."""
    import json

    j = lambda x: json.dumps(x, separators=(",", ":"), sort_keys=True)
    entry = {"firstKeptEntryId": "k", "id": "e@", "parentId": None, "timestamp": "now", "tokensBefore": 7}
    compact = {"compactionEntry": entry, "fromExtension": False, "reason": "manual", "willRetry": True}
    failed = {"aborted": True, "fromExtension": False, "reason": "overflow", "willRetry": False}
    cost = dict.fromkeys(("cacheRead", "cacheWrite", "input", "output", "total"), 0.5)
    usage = {"cacheRead": 1, "cacheWrite": 2, "input": 3, "output": 4, "totalTokens": 10, "cost": cost}
    said = {"role": "assistant", "api": "a", "model": "m", "provider": "p", "stopReason": "stop", "timestamp": 5, "usage": usage}
    text = [{"type": "text", "text": "one \"@\" "}, {"type": "thinking", "thinking": "no"}, {"type": "text", "text": "two"}]
    kept = {**said, "text": 'one "@" two'}
    tool = {"toolCallId": "c@", "toolName": "t"}
    good = [
        ("session_info_changed", {"name": "n@", "path": "/x"}, {"name": "n@"}),
        ("session_info_changed", {}, {}),
        ("session_compact", {**compact, "compactionEntry": {**entry, "summary": "long"}}, compact),
        ("session_compact", {**compact, "compactionEntry": {**entry, "parentId": "p", "fromHook": True}}, {**compact, "compactionEntry": {**entry, "parentId": "p", "fromHook": True}}),
        ("session_compact_failed", {**failed, "errorMessage": "e", "stack": []}, {**failed, "errorMessage": "e"}),
        ("agent_start", {"messages": [1]}, {}),
        ("agent_settled", {}, {}),
        ("ui_prompt_start", {"kind": "select", "reason": "ui_prompt", "options": []}, {"kind": "select", "reason": "ui_prompt"}),
        ("ui_prompt_end", {"kind": "custom", "reason": "ui_prompt", "title": "t"}, {"kind": "custom", "reason": "ui_prompt", "title": "t"}),
        ("turn_start", {"timestamp": 12, "turnIndex": 0}, {"timestamp": 12, "turnIndex": 0}),
        ("turn_end", {"turnIndex": 3, "message": {}}, {"turnIndex": 3}),
        ("message_end", {"message": {"role": "user", "content": "plain @", "timestamp": 1}}, {"role": "user", "text": "plain @", "timestamp": 1}),
        ("message_end", {"message": {"role": "user", "content": [{"type": "image", "data": "x"}], "timestamp": 1}}, {"role": "user", "text": "", "timestamp": 1}),
        ("message_end", {"message": {**said, "content": text, "responseModel": "r"}}, {**kept, "responseModel": "r"}),
        ("message_end", {"message": {**said, "content": text, "usage": {**usage, "reasoning": 9, "other": 1}}}, {**kept, "usage": {**usage, "reasoning": 9}}),
        ("tool_execution_start", {**tool, "args": {"b": [1, None], "a": "@"}}, {**tool, "args": {"b": [1, None], "a": "@"}}),
        ("tool_execution_end", {**tool, "isError": False, "result": None, "details": 1}, {**tool, "isError": False, "result": None}),
    ]
    bad = [
        ("session_info_changed", {"name": None}), ("session_compact", {**compact, "reason": "other"}), ("session_compact", {**compact, "compactionEntry": {**entry, "tokensBefore": "7"}}), ("session_compact_failed", {**failed, "aborted": "true"}),
        ("ui_prompt_start", {"kind": "menu", "reason": "ui_prompt"}), ("turn_start", {"timestamp": "12", "turnIndex": 0}), ("turn_end", {}), ("agent_start", [1]), ("message_end", {"message": {"role": "user", "content": [{"type": "video"}], "timestamp": 1}}),
        ("message_end", {"message": {**said, "content": "text"}}), ("message_end", {"message": {**said, "content": text, "usage": {**usage, "cost": {**cost, "total": None}}}}), ("message_end", {"message": 5}), ("tool_execution_start", tool), ("tool_execution_end", {**tool, "isError": 0, "result": 1}),
    ]
    none = [("message_end", {"message": {"role": "toolResult"}}), ("input", {"text": "x"}), ("session_start", {})]
    return [(k, json.dumps(x), j(p), None) for k, x, p in good] + [(k, json.dumps(x), None, "normalization") for k, x in bad] + [(k, json.dumps(x), None, "excluded") for k, x in none]


def _projections_sql() -> str:
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {q(k)}, {q(p)}, {q(f)})" for i, (k, _, p, f) in enumerate(_projections()))
    return f"""WITH p AS (SELECT * FROM (VALUES {rows}) t(m, kind, payload, fault)) SELECT event_id AS seq, replace('{{"event":"' || kind || '","payload":' || payload || ',"source":"pi","version":"1.0.0"}}', '@', CAST(event_id AS VARCHAR)) AS envelope, fault FROM events JOIN p ON event_id % {len(_projections())} = m"""


@query("adapter3_projection", _projections_sql())
def adapter3_projection(spark, d):
    """Native events of all kinds, with what is dropped from them and what makes them fail."""
    made = spark.createDataFrame([(i, k, x) for i, (k, x, _, _) in enumerate(_projections())], "m int, type string, native string")
    e = X.read(spark, d, "events").select(F.col("event_id").alias("seq"))
    e = e.join(F.broadcast(made), F.col("seq") % len(_projections()) == F.col("m")).select("seq", "type", F.replace("native", F.lit("@"), F.col("seq").cast("string")).alias("native"))
    return A.project(e).select("seq", "envelope", "fault")


@query("session_queue", """WITH RECURSIVE r AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, CASE WHEN event_id % 11 = 7 THEN 'start' WHEN event_id % 53 = 50 THEN 'end' WHEN event_id % 5 < 2 THEN 'sent' ELSE 'observation' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 s AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, 'new' AS state, '' AS q, CAST([] AS BIGINT[]) AS w, '' AS out, CAST(0 AS BIGINT) AS head FROM r WHERE n = 1
  UNION ALL SELECT session_id, n, seq, CASE WHEN contains(out, 'e') THEN 'closing' WHEN contains(out, 's') THEN 'active' ELSE state END, CASE WHEN out = 'x' OR out = 'y' OR out = 'z' THEN substr(q, 2) ELSE q || replace(out, 'v', '') END,
   CASE WHEN out IN ('x', 'y', 'z') THEN w[2:] WHEN out = 'so' THEN list_append(list_append(w, seq), seq) WHEN out IN ('s', 'o', 'e') THEN list_append(w, seq) ELSE w END, out, coalesce(w[1], 0)
   FROM (SELECT r.session_id, r.n, r.seq, state, q, w, CASE WHEN kind = 'sent' THEN CASE q[1] WHEN 's' THEN 'x' WHEN 'o' THEN 'y' WHEN 'e' THEN 'z' ELSE '' END WHEN state = 'closing' THEN '' WHEN kind = 'observation' AND len(q) - len(replace(q, 'o', '')) >= 3 THEN 'v'
     WHEN kind = 'end' THEN 'e' WHEN kind = 'start' THEN CASE state WHEN 'new' THEN 's' ELSE '' END ELSE CASE state WHEN 'new' THEN 'so' ELSE 'o' END END AS out FROM s JOIN r ON r.session_id = s.session_id AND r.n = s.n + 1)),
 o AS (SELECT session_id, seq, out, head, unnest(range(1, len(out) + 1)) AS i FROM s WHERE out != '')
 SELECT session_id, seq, CAST(i - 1 AS INTEGER) AS ordinal, CASE out[i] WHEN 'x' THEN 'sent:start' WHEN 'y' THEN 'sent:observation' WHEN 'z' THEN 'sent:end' WHEN 's' THEN 'start' WHEN 'o' THEN 'observation' WHEN 'e' THEN 'end' ELSE 'overflow' END AS emitted, CASE WHEN out IN ('x', 'y', 'z') THEN head ELSE seq END AS entry FROM o""")
def session_queue(spark, d):
    """Submissions of each user's session, of which two in five send what waits longest."""
    k = F.col("event_id")
    kind = F.when(k % 11 == 7, "start").when(k % 53 == 50, "end").when(k % 5 < 2, "sent").otherwise("observation")
    return Q.serve_all(X.read(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), k.alias("seq"), kind.alias("kind")), 3)


@query("adapter3_queue_admission", "WITH q AS (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM events) SELECT CAST(user_id AS VARCHAR) AS session_id, seq, CASE WHEN nr > 5 THEN 'overflow' WHEN nr = 1 THEN 'start,observation' ELSE 'observation' END AS admitted FROM q")
def adapter3_queue_admission(spark, d):
    e = X.read(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.lit("observation").alias("kind"))
    return A.admission(e, 5).select("session_id", "seq", "admitted")


@query("session_transcript_faults", "WITH e AS (SELECT o_custkey AS snapshot_id, o_orderkey AS position, CASE WHEN o_custkey % 5 = 1 AND o_orderkey % 3 = 0 THEN 'other' ELSE 's' || o_custkey END AS session_id, CASE WHEN o_custkey % 5 = 2 THEN o_orderkey % 4 ELSE o_orderkey END AS receipt_id FROM orders WHERE o_custkey % 5 != 3), f AS (SELECT *, session_id != first_value(session_id) OVER (PARTITION BY snapshot_id ORDER BY position) AS mixed, row_number() OVER (PARTITION BY snapshot_id, receipt_id ORDER BY position) > 1 AS again FROM e), g AS (SELECT snapshot_id, count(*) AS n, min_by(CASE WHEN mixed THEN 'entries:mixed_session_ids' ELSE 'entries:duplicate_receipt_id' END, position) FILTER (mixed OR again) AS fault FROM f GROUP BY 1) SELECT c_custkey AS snapshot_id, coalesce(n, 0) AS n_entries, CASE WHEN n IS NULL THEN 'entries:empty' ELSE fault END AS fault FROM customer LEFT JOIN g ON c_custkey = snapshot_id")
def session_transcript_faults(spark, d):
    o = X.read(spark, d, "orders").filter("o_custkey % 5 != 3")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    e = o.select(c.alias("snapshot_id"), k.alias("position"), F.when((c % 5 == 1) & (k % 3 == 0), "other").otherwise(F.concat(F.lit("s"), c)).alias("session_id"), F.when(c % 5 == 2, k % 4).otherwise(k).alias("receipt_id"))
    return P.transcript_faults(X.read(spark, d, "customer").select(F.col("c_custkey").alias("snapshot_id")), e)


@query("session_snapshot", f"WITH {X.LEDGER} SELECT session_id, receipt_id, event_type, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, CASE event_type WHEN 'session_start' THEN 0 WHEN 'observation' THEN 1 ELSE 2 END, receipt_id) AS INTEGER) AS position, event_type = 'observation' AND CAST(receipt_id AS BIGINT) % 3 != 0 AS in_scope FROM led")
def session_snapshot(spark, d):
    l, o = X.ledger(spark, d)
    prior = l.unionByName(o).filter(F.col("receipt_id").cast("long") % 3 == 0)
    return P.snapshot(l, o, prior).select("session_id", "receipt_id", "event_type", "position", "in_scope")


_V2 = [*L.ADAPTER_V2, *L.HOOKS_V2, "session.unknown", "chat.message"]


@query(
    "adapter_v2_events",
    f"WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, {_V2}[event_id % {len(_V2)} + 1] AS kind FROM events), k AS (SELECT * FROM e WHERE kind NOT IN ('session.unknown', 'chat.message')) SELECT session_id, seq, CASE WHEN kind = 'session.created' THEN 1 ELSE 0 END AS ordinal, 'observation' AS event_type, 'opencode.v2.' || kind AS hook_type FROM k UNION ALL SELECT session_id, seq, 0, 'session_start', NULL FROM k WHERE kind = 'session.created' UNION ALL SELECT session_id, seq, 1, 'session_end', NULL FROM k WHERE kind = 'session.deleted'",
)
def adapter_v2_events(spark, d):
    k = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in _V2]), (k % len(_V2) + 1).cast("int"))
    e = X.read(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), k.alias("seq"), kind.alias("kind"), F.lit(None).cast("string").alias("delta"))
    return L.derived(e, "opencode.v2.", (*L.ADAPTER_V2, *L.HOOKS_V2))


@query("adapter_v1_hooks", "SELECT event_id AS seq, 'opencode.v1.' || ['chat.message', 'tool.execute.before', 'tool.execute.after'][event_id % 4 + 1] AS hook_type FROM events WHERE event_id % 4 < 3")
def adapter_v1_hooks(spark, d):
    k = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in (*L.HOOKS_V1, "session.prompt")]), (k % 4 + 1).cast("int"))
    e = X.read(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), k.alias("seq"), kind.alias("kind"), F.lit(None).cast("string").alias("delta"))
    return L.derived(e).select("seq", "hook_type")
