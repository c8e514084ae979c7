"""Queries over the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import graph_mutations as GM
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


def _neighbors_sql(concept: str, kinds: str) -> str:
    return f"WITH {X.ASSERTIONS_USES}, e AS (SELECT subject AS src, object AS dst, id, relation, CASE WHEN relation = 'related_to' THEN 'symmetric' ELSE 'outgoing' END AS orientation FROM asr UNION ALL SELECT object, subject, id, relation, CASE WHEN relation = 'related_to' THEN 'symmetric' ELSE 'incoming' END FROM asr), x AS (SELECT * FROM e WHERE src = '{concept}' AND orientation IN ({kinds})) SELECT CAST(row_number() OVER (ORDER BY relation, orientation, dst, id) AS INTEGER) AS rank, relation, orientation, dst AS neighbor, id AS assertion_id FROM x ORDER BY 1 LIMIT 256"


for _name, _direction, _kinds in (("out", "outgoing", "'outgoing', 'symmetric'"), ("in", "incoming", "'incoming', 'symmetric'"), ("either", "either", "'outgoing', 'incoming', 'symmetric'")):

    @query(f"graph_neighbors_{_name}", _neighbors_sql("supplier:3", _kinds))
    def _neighbors(spark, d, direction=_direction):
        return G.neighbors(X.graph(spark, d, uses=True)[1], "supplier:3", direction)


@query("graph_neighbors_filtered", _neighbors_sql("nation:7", "'outgoing', 'incoming', 'symmetric'").replace("src = 'nation:7'", "src = 'nation:7' AND relation IN ('part_of', 'uses')").replace("LIMIT 256", "LIMIT 20"))
def graph_neighbors_filtered(spark, d):
    return G.neighbors(X.graph(spark, d, uses=True)[1], "nation:7", "either", ("uses", "part_of", "uses"), 20)


@query("graph_related_sources", f"WITH {X.PROVENANCE}, l AS (SELECT source_ref_id, 0 AS role FROM men WHERE concept_id = 'customer:4' UNION SELECT source_ref_id, 1 FROM evi WHERE assertion_id = 'c4'), x AS (SELECT * FROM l JOIN src USING (source_ref_id)) SELECT CAST(row_number() OVER (ORDER BY role, source_kind, external_id, external_version NULLS FIRST) AS INTEGER) AS rank, CASE role WHEN 0 THEN 'mention' ELSE 'evidence' END AS role, source_kind, external_id, coalesce(external_version, 0) AS external_version FROM x ORDER BY 1 LIMIT 256")
def graph_related_sources(spark, d):
    s, e, m = X.provenance(spark, d)
    return G.related_sources(X.graph(spark, d)[1], e, m, s, "customer:4").fillna(0, ["external_version"])


def _paths_sql(work: int) -> str:
    return f"""WITH RECURSIVE {X.ASSERTIONS}, e AS (SELECT subject AS src, object AS dst, id, 'outgoing' AS way FROM asr UNION ALL SELECT object, subject, id, 'incoming' FROM asr),
 p AS (SELECT 'customer:0' AS node, ['customer:0'] AS c, CAST([] AS VARCHAR[]) AS a, CAST([] AS VARCHAR[]) AS o UNION ALL SELECT e.dst, list_append(p.c, e.dst), list_append(p.a, e.id), list_append(p.o, e.way) FROM p JOIN e ON e.src = p.node WHERE p.node != 'customer:7' AND len(p.a) < 4 AND NOT list_contains(p.c, e.dst) AND NOT list_contains(p.a, e.id)),
 w AS (SELECT *, count(*) OVER () AS work FROM p)
 SELECT CAST(row_number() OVER (ORDER BY len(a), a, c) AS INTEGER) AS rank, CAST(len(a) AS INTEGER) AS hops, array_to_string(c, '>') AS concept_ids, array_to_string(a, '>') AS assertion_ids, array_to_string(o, '>') AS orientations, work, 'found' AS outcome FROM w WHERE node = 'customer:7' AND work <= {work}
 UNION ALL SELECT DISTINCT 0, 0, '', '', '', CAST({work} + 1 AS BIGINT), 'work_exhausted' FROM w WHERE work > {work}"""


@query("graph_paths", _paths_sql(10000))
def graph_paths(spark, d):
    return G.find_paths(X.graph(spark, d)[1], "customer:0", "customer:7", "either", 4)


@query("graph_paths_exhausted", _paths_sql(30))
def graph_paths_exhausted(spark, d):
    return G.find_paths(X.graph(spark, d)[1], "customer:0", "customer:7", "either", 4, max_work=30)


def _many_paths_sql(work: int) -> str:
    return f"""WITH RECURSIVE {X.ASSERTIONS}, e AS (SELECT subject AS src, object AS dst, id, 'outgoing' AS way FROM asr UNION ALL SELECT object, subject, id, 'incoming' FROM asr),
 r AS (SELECT c_custkey AS request_id, 'customer:' || c_custkey AS a1, 'customer:' || CASE WHEN c_custkey % 10 = 0 THEN c_custkey ELSE (c_custkey * 7 + 3) % 150 END AS a2 FROM customer WHERE c_custkey % 3 = 0),
 p AS (SELECT request_id, a2, a1 AS node, [a1] AS c, CAST([] AS VARCHAR[]) AS a, CAST([] AS VARCHAR[]) AS o FROM r WHERE a1 != a2 UNION ALL SELECT request_id, a2, e.dst, list_append(p.c, e.dst), list_append(p.a, e.id), list_append(p.o, e.way) FROM p JOIN e ON e.src = p.node WHERE p.node != a2 AND len(p.a) < 3 AND NOT list_contains(p.c, e.dst) AND NOT list_contains(p.a, e.id)),
 w AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS work FROM p),
 f AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY len(a), a, c) AS INTEGER) AS rank, CAST(len(a) AS INTEGER) AS hops, array_to_string(c, '>') AS concept_ids, array_to_string(a, '>') AS assertion_ids, array_to_string(o, '>') AS orientations, work, 'found' AS outcome FROM w WHERE node = a2 AND work <= {work})
 SELECT * FROM f WHERE rank <= 50 UNION ALL SELECT DISTINCT request_id, 0, 0, '', '', '', CAST({work} + 1 AS BIGINT), 'work_exhausted' FROM w WHERE work > {work} UNION ALL SELECT request_id, 0, 0, '', '', '', CAST(0 AS BIGINT), 'invalid_input' FROM r WHERE a1 = a2"""


@query("graph_paths_many", _many_paths_sql(75))
def graph_paths_many(spark, d):
    """A third of all customers as requests of one plan; those in large nations use up their work."""
    k = F.col("c_custkey")
    r = X.read(spark, d, "customer").filter(k % 3 == 0).select(k.alias("request_id"), F.concat(F.lit("customer:"), k).alias("start"), F.concat(F.lit("customer:"), F.when(k % 10 == 0, k).otherwise((k * 7 + 3) % 150)).alias("end"))
    return G.find_paths_many(X.graph(spark, d)[1], r, "either", 3, max_work=75)


@query("graph_invariant_audit", f"WITH {X.ASSERTIONS}, {X.CONCEPTS}, {X.PROVENANCE} SELECT 'no_evidence' AS violation, id AS item FROM asr ANTI JOIN evi ON evi.assertion_id = asr.id UNION ALL SELECT 'preferred_alias', id FROM con WHERE starts_with(id, 'nation') AND CAST(split_part(id, ':', 2) AS BIGINT) % 5 = 0")
def graph_invariant_audit(spark, d):
    c, a = X.graph(spark, d)
    number = F.split("id", ":")[1].cast("long")
    broken = F.col("id").startswith("nation") & (number % 5 == 0)
    aliases = c.select(F.col("id").alias("concept_id"), F.col("id").alias("alias_key"), (~broken).alias("is_preferred"))
    return G.audit(c, aliases, a, X.provenance(spark, d)[1])


def _aliases(c):
    """Two aliases a concept: its id, preferred, and its id in capitals."""
    return c.select(F.col("id").alias("concept_id"), F.col("id").alias("alias_key"), F.lit(True).alias("is_preferred")).unionByName(c.select(F.col("id").alias("concept_id"), F.upper("id").alias("alias_key"), F.lit(False).alias("is_preferred")))


@query("graph_create_concepts", "SELECT c_custkey AS ordinal, CASE c_custkey % 4 WHEN 0 THEN 'existing' WHEN 1 THEN 'alias_set_mismatch' WHEN 2 THEN CASE WHEN c_custkey > 0 THEN 'alias_owned' ELSE 'created' END ELSE 'created' END AS outcome FROM customer")
def graph_create_concepts(spark, d):
    c, _ = X.graph(spark, d)
    k = F.col("c_custkey")
    own = F.concat(F.lit("customer:"), k)
    last = F.concat(F.lit("customer:"), k - 1)
    keys = F.when(k % 4 == 0, F.array(F.struct(own.alias("key"), F.lit(True).alias("preferred")), F.struct(F.upper(own).alias("key"), F.lit(False).alias("preferred")))).when(k % 4 == 1, F.array(F.struct(own.alias("key"), F.lit(True).alias("preferred")))).when(k % 4 == 2, F.array(F.struct(own.alias("key"), F.lit(True).alias("preferred")), F.struct(last.alias("key"), F.lit(False).alias("preferred")))).otherwise(F.array(F.struct(F.concat(F.lit("new"), k).alias("key"), F.lit(True).alias("preferred"))))
    req = X.read(spark, d, "customer").select(k.alias("ordinal"), F.explode(keys).alias("x")).select("ordinal", "x.*")
    return GM.create_concepts(_aliases(c), req)


@query(
    "graph_create_assertions",
    "WITH r AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), e AS (SELECT o_custkey AS k, count(*) AS held FROM orders GROUP BY 1) SELECT r.k AS ordinal, CASE WHEN r.k % 5 = 0 THEN 'invalid_input' WHEN r.k % 5 = 1 THEN 'missing_concept' WHEN r.k % 5 = 2 THEN 'missing_source' WHEN r.k % 5 = 3 THEN CASE WHEN coalesce(held, 0) + CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = r.k AND o.o_orderkey = 1) THEN 0 ELSE 1 END > 32 THEN 'evidence_limit' ELSE 'existing' END ELSE 'created' END AS outcome FROM r LEFT JOIN e ON e.k = r.k",
)
def graph_create_assertions(spark, d):
    c, a = X.graph(spark, d)
    s, e, _ = X.provenance(spark, d)
    k = F.col("c_custkey")
    own, nation = F.concat(F.lit("customer:"), k), F.concat(F.lit("nation:"), F.col("c_nationkey"))
    req = X.read(spark, d, "customer").select(
        k.alias("ordinal"),
        own.alias("subject"),
        F.when(k % 5 == 4, "uses").otherwise("part_of").alias("relation"),
        F.when(k % 5 == 0, own).when(k % 5 == 1, F.lit("nobody")).otherwise(nation).alias("object"),
        F.when(k % 5 == 2, F.array(F.lit(-5).cast("long"))).otherwise(F.array(F.lit(1).cast("long"))).alias("source_ids"),
    )
    return GM.create_assertions(c, a, e, s, req)


@query("graph_delete_concepts", f"WITH {X.CONCEPTS}, {X.ASSERTIONS}, r AS (SELECT p_partkey AS ordinal, CASE p_partkey % 3 WHEN 0 THEN 'customer:' || p_partkey WHEN 1 THEN 'lone:' || p_partkey ELSE 'gone:' || p_partkey END AS id, p_partkey % 2 + 1 AS revision FROM part), k AS (SELECT id FROM con UNION ALL SELECT 'lone:' || p_partkey FROM part), u AS (SELECT subject AS id FROM asr UNION SELECT object FROM asr) SELECT r.ordinal, CASE WHEN k.id IS NULL THEN 'missing' WHEN r.revision != 1 THEN 'stale' WHEN u.id IS NOT NULL THEN 'referenced' ELSE 'deleted' END AS outcome FROM r LEFT JOIN k ON k.id = r.id LEFT JOIN u ON u.id = r.id")
def graph_delete_concepts(spark, d):
    c, a = X.graph(spark, d)
    k = F.col("p_partkey")
    p = X.read(spark, d, "part")
    lone = p.select(F.concat(F.lit("lone:"), k).alias("id"), F.lit(1).cast("long").alias("revision"))
    req = p.select(k.alias("ordinal"), F.when(k % 3 == 0, F.concat(F.lit("customer:"), k)).when(k % 3 == 1, F.concat(F.lit("lone:"), k)).otherwise(F.concat(F.lit("gone:"), k)).alias("id"), (k % 2 + 1).alias("revision"))
    return GM.delete_concepts(c.unionByName(lone), X.provenance(spark, d)[2], a, req)


@query("graph_replace_aliases", "SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 6 = 0 THEN 'missing' WHEN c_custkey % 6 = 1 THEN 'stale' WHEN c_custkey % 6 = 2 THEN 'invalid_set' WHEN c_custkey % 6 = 3 THEN 'alias_owned' ELSE 'updated' END AS outcome FROM customer")
def graph_replace_aliases(spark, d):
    c, _ = X.graph(spark, d)
    k = F.col("c_custkey")
    own = F.concat(F.lit("customer:"), k)
    req = X.read(spark, d, "customer").select(k.alias("ordinal"), F.when(k % 6 == 0, F.lit("nobody")).otherwise(own).alias("id"), F.when(k % 6 == 1, 9).otherwise(1).cast("long").alias("revision"), F.when(k % 6 == 2, F.array(own, own)).when(k % 6 == 3, F.array(own, F.lit("region:1"))).otherwise(F.array(own, F.concat(F.lit("fresh"), k))).alias("keys"), F.lit(1).alias("n_preferred"))
    return GM.replace_aliases(c, _aliases(c), req)


@query("graph_register_sources", f"WITH {X.PROVENANCE}, r AS (SELECT o_orderkey AS ordinal, 'memory_version' AS k, CAST(o_orderkey AS VARCHAR) AS e, CASE WHEN o_orderkey % 7 != 0 AND o_orderkey % 2 = 0 THEN o_orderkey % 5 + 1 END AS v FROM orders) SELECT r.ordinal, CASE WHEN s.external_id IS NOT NULL THEN 'existing' ELSE 'created' END AS outcome FROM r LEFT JOIN src s ON s.source_kind = r.k AND s.external_id = r.e AND s.external_version IS NOT DISTINCT FROM r.v")
def graph_register_sources(spark, d):
    s, _, _ = X.provenance(spark, d)
    k = F.col("o_orderkey")
    req = X.read(spark, d, "orders").select(k.alias("ordinal"), F.lit("memory_version").alias("source_kind"), k.cast("string").alias("external_id"), F.when((k % 7 != 0) & (k % 2 == 0), k % 5 + 1).alias("external_version"))
    return G.register_sources(s, req)


@query("graph_delete_sources", "SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 3 = 0 THEN 'missing' WHEN o_custkey % 2 = 0 OR starts_with(o_orderpriority, '1') THEN 'referenced' ELSE 'deleted' END AS outcome FROM orders")
def graph_delete_sources(spark, d):
    s, e, m = X.provenance(spark, d)
    k = F.col("o_orderkey")
    req = X.read(spark, d, "orders").select(k.alias("ordinal"), F.when(k % 3 == 0, -k - 1).otherwise(k).alias("source_ref_id"))
    return GM.delete_sources(s, m, e.filter(F.substring("assertion_id", 2, 20).cast("long") % 2 == 0), req)


@query("graph_mentions", "SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_concept' WHEN o_orderkey % 5 = 1 THEN 'missing_source' WHEN o_orderkey % 2 = 0 THEN CASE WHEN starts_with(o_orderpriority, '1') THEN 'existing' ELSE 'created' END ELSE CASE WHEN starts_with(o_orderpriority, '1') THEN 'deleted' ELSE 'missing_mention' END END AS outcome FROM orders")
def graph_mentions(spark, d):
    c, _ = X.graph(spark, d)
    s, _, m = X.provenance(spark, d)
    k = F.col("o_orderkey")
    req = X.read(spark, d, "orders").select(k.alias("ordinal"), F.when(k % 2 == 0, "create").otherwise("delete").alias("op"), F.when(k % 5 == 0, F.lit("nobody")).otherwise(F.concat(F.lit("customer:"), "o_custkey")).alias("concept_id"), F.when(k % 5 == 1, -k - 1).otherwise(k).alias("source_ref_id"))
    return G.mention_outcomes(c, s, m, req)


@query(
    "graph_evidence",
    "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nr FROM orders WHERE o_orderkey % 5 > 1 AND o_orderkey % 2 = 1) SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_assertion' WHEN o_orderkey % 5 = 1 THEN 'missing_source' WHEN o_orderkey % 2 = 0 THEN 'existing' WHEN nr >= n THEN 'would_orphan_evidence' ELSE 'deleted' END AS outcome FROM orders JOIN n USING (o_custkey) LEFT JOIN r USING (o_orderkey)",
)
def graph_evidence(spark, d):
    _, a = X.graph(spark, d)
    s, e, _ = X.provenance(spark, d)
    k = F.col("o_orderkey")
    req = X.read(spark, d, "orders").select(k.alias("ordinal"), F.when(k % 2 == 0, "add").otherwise("remove").alias("op"), F.when(k % 5 == 0, F.lit("nothing")).otherwise(F.concat(F.lit("c"), "o_custkey")).alias("assertion_id"), F.when(k % 5 == 1, -k - 1).otherwise(k).alias("source_ref_id"))
    return G.evidence_outcomes(a, s, e, req)


@query("graph_update_assertions", "SELECT c_custkey AS ordinal, CASE c_custkey % 7 WHEN 0 THEN 'invalid_input' WHEN 1 THEN 'missing' WHEN 2 THEN 'stale' WHEN 3 THEN 'missing_subject' WHEN 4 THEN 'missing_object' WHEN 5 THEN 'duplicate' ELSE 'updated' END AS outcome FROM customer WHERE c_custkey > 0")
def graph_update_assertions(spark, d):
    c, a = X.graph(spark, d)
    k = F.col("c_custkey")
    own, nation = F.concat(F.lit("customer:"), k), F.concat(F.lit("nation:"), F.col("c_nationkey"))
    req = X.read(spark, d, "customer").filter("c_custkey > 0").select(
        k.alias("ordinal"),
        F.when(k % 7 == 1, F.lit("nothing")).when(k % 7 == 5, F.lit("c0")).otherwise(F.concat(F.lit("c"), k)).alias("id"),
        F.when(k % 7 == 2, 9).otherwise(1).cast("long").alias("revision"),
        F.when(k % 7 == 3, F.lit("nobody")).otherwise(own).alias("subject"),
        F.when(k % 7 == 0, "likes").otherwise("part_of").alias("relation"),
        F.when(k % 7 == 4, F.lit("nobody")).otherwise(nation).alias("object"),
    )
    return GM.update_assertions(c, a, req)


@query("graph_delete_assertions", "SELECT c_custkey AS ordinal, CASE c_custkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'stale' ELSE 'deleted' END AS outcome FROM customer")
def graph_delete_assertions(spark, d):
    _, a = X.graph(spark, d)
    k = F.col("c_custkey")
    return GM.delete_assertions(a, X.read(spark, d, "customer").select(k.alias("ordinal"), F.when(k % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("c"), k)).alias("id"), F.when(k % 3 == 1, 5).otherwise(1).cast("long").alias("revision")))
