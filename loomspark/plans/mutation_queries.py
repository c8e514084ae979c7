"""Batches whose requests depend on each other, and requests made on a snapshot that has drifted.

Each query gives every customer, by its remainder, a short series of requests; its SQL names the
outcomes of the series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import graph_mutations as GM
from . import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return put


def _series(spark, d, modulus: int, rows: list[tuple], schema: str):
    """Customers with the rows of their remainder: k, ordinal (ten a customer) and the row's columns."""
    c = X.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    steps = spark.createDataFrame(rows, f"m int, step int, {schema}")
    return c.join(F.broadcast(steps), F.col("k") % modulus == F.col("m")).withColumn("ordinal", F.col("k") * 10 + F.col("step"))


def _outcomes(modulus: int, rows: list[tuple]) -> str:
    values = ", ".join(f"({m}, {step}, '{o}')" for m, step, o in rows)
    return f"SELECT c_custkey * 10 + step AS ordinal, outcome FROM customer JOIN (VALUES {values}) t(m, step, outcome) ON c_custkey % {modulus} = m"


def _key(prefix: str):
    return F.concat(F.lit(prefix), F.col("k").cast("string"))


@query("graph_ordered_concept_deletes", _outcomes(5, [(0, 1, "deleted"), (0, 2, "missing"), (1, 1, "stale"), (1, 2, "deleted"), (1, 3, "missing"), (2, 1, "snapshot_drift"), (2, 2, "snapshot_drift"), (3, 1, "snapshot_drift"), (4, 1, "referenced"), (4, 2, "referenced")]))
def graph_ordered_concept_deletes(spark, d):
    """Deleted once; drift of a revision (2) and of a set of aliases (3); mentions keep a concept (4)."""
    r = _series(spark, d, 5, [(0, 1, 1), (0, 2, 1), (1, 1, 7), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 2, 9), (3, 1, 1), (4, 1, 1), (4, 2, 1)], "revision long")
    c = X.read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    concepts = c.select(_key("lone:").alias("id"), F.lit(1).cast("long").alias("revision"))
    aliases = c.select(_key("lone:").alias("concept_id"), _key("lone:").alias("alias_key"), F.lit(True).alias("is_preferred"), _key("Lone ").alias("display_text"))
    k = F.substring("id", 6, 20).cast("long")
    before = GM.Snapshot(concepts=concepts.withColumn("revision", F.when(k % 5 == 2, 9).otherwise(1).cast("long")), aliases=aliases.withColumn("display_text", F.when(F.substring("concept_id", 6, 20).cast("long") % 5 == 3, "Other").otherwise(F.col("display_text"))))
    mentions = c.filter("k % 5 = 4").select(_key("lone:").alias("concept_id"), F.col("k").alias("source_ref_id"))
    return GM.delete_concepts(concepts, mentions, X.graph(spark, d)[1], r.select("ordinal", _key("lone:").alias("id"), "revision"), aliases, before)


@query("graph_ordered_assertion_deletes", _outcomes(5, [(0, 1, "deleted"), (0, 2, "missing"), (1, 1, "invalid_input"), (1, 2, "stale"), (1, 3, "deleted"), (2, 1, "snapshot_drift"), (3, 1, "snapshot_drift"), (4, 1, "missing"), (4, 2, "missing")]))
def graph_ordered_assertion_deletes(spark, d):
    """Deleted once; drift of an object (2) and of the set of evidence (3)."""
    r = _series(spark, d, 5, [(0, 1, 1), (0, 2, 1), (1, 1, 0), (1, 2, 3), (1, 3, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (4, 2, 1)], "revision long")
    a = X.graph(spark, d)[1].filter("id like 'c%'")
    evidence = X.read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("assertion_id"), F.col("c_custkey").alias("source_ref_id"))
    k = F.substring("id", 2, 20).cast("long")
    e = F.substring("assertion_id", 2, 20).cast("long")
    before = GM.Snapshot(assertions=a.withColumn("object", F.when(k % 5 == 2, "elsewhere").otherwise(F.col("object"))), evidence=evidence.unionByName(evidence.filter(e % 5 == 3).withColumn("source_ref_id", F.lit(-1).cast("long"))))
    return GM.delete_assertions(a, r.select("ordinal", F.when(F.col("k") % 5 == 4, _key("none")).otherwise(_key("c")).alias("id"), "revision"), evidence, before)


@query(
    "graph_ordered_updates",
    "WITH c AS (SELECT *, max(c_custkey) OVER () AS top FROM customer), o AS ("
    + _outcomes(6, [(0, 1, "updated"), (0, 2, "stale"), (0, 3, "updated"), (1, 1, "updated"), (1, 2, "missing_object"), (1, 3, "updated"), (2, 1, "updated"), (3, 1, "updated"), (3, 2, "duplicate"), (4, 1, "snapshot_drift"), (5, 1, "snapshot_drift"), (5, 2, "invalid_input")]).replace("FROM customer", "FROM c")
    + ") SELECT ordinal, outcome FROM o",
)
def graph_ordered_updates(spark, d):
    """Revisions rise from request to request (0, 1); a triple that an update has left is free for
    another assertion (3 takes that of 2) and one that is taken is not; drift (4, 5)."""
    rows = [(0, 1, 1, "region:1"), (0, 2, 1, "region:2"), (0, 3, 2, "region:2"), (1, 1, 1, "region:3"), (1, 2, 2, "nowhere"), (1, 3, 2, "region:1"), (2, 1, 1, "region:4"), (3, 1, 1, "freed"), (3, 2, 2, "taken"), (4, 1, 1, "region:1"), (5, 1, 1, "region:1"), (5, 2, 1, "itself")]
    r = _series(spark, d, 6, rows, "revision long, target string")
    concepts, a = X.graph(spark, d)
    own, last = _key("customer:"), F.concat(F.lit("customer:"), F.col("k") - 1)
    nations = X.read(spark, d, "customer").select((F.col("c_custkey") + 1).alias("after"), F.col("c_nationkey").alias("last_nation"))
    r = r.join(nations, F.col("k") == F.col("after"), "left")
    t = F.col("target")
    subject = F.when(t.isin("freed", "taken"), last).otherwise(own)
    target = F.when(t == "freed", F.concat(F.lit("nation:"), "last_nation")).when(t == "taken", "region:4").when(t == "itself", own).otherwise(t)
    k = F.substring("id", 2, 20).cast("long")
    c = a.filter("id like 'c%'")
    before = GM.Snapshot(assertions=c.withColumn("revision", F.when(k % 6 == 4, 3).otherwise(1).cast("long")).filter(k % 6 != 5))
    return GM.update_assertions(concepts, c, r.select("ordinal", _key("c").alias("id"), "revision", subject.alias("subject"), F.lit("part_of").alias("relation"), target.alias("object")), before)


@query("graph_ordered_aliases", _outcomes(4, [(0, 1, "updated"), (0, 2, "alias_owned"), (0, 3, "stale"), (1, 1, "updated"), (1, 2, "updated"), (1, 3, "updated"), (1, 4, "alias_owned"), (2, 1, "snapshot_drift"), (2, 2, "updated"), (3, 1, "invalid_set"), (3, 2, "missing"), (3, 3, "updated")]))
def graph_ordered_aliases(spark, d):
    """Two concepts a customer, a and b, that claim one new key: the first one holds it (0) until
    it leaves it (1); drift of a's aliases only (2)."""
    rows = [(0, 1, "a", 1, ["own", "new"]), (0, 2, "b", 1, ["own", "new"]), (0, 3, "a", 1, ["own"]), (1, 1, "a", 1, ["new"]), (1, 2, "a", 2, ["own"]), (1, 3, "b", 1, ["new"]), (1, 4, "a", 3, ["own", "new"]), (2, 1, "a", 1, ["own"]), (2, 2, "b", 1, ["new"]), (3, 1, "a", 1, ["own", "own"]), (3, 2, "x", 1, ["own"]), (3, 3, "a", 1, ["new"])]
    r = _series(spark, d, 4, rows, "who string, revision long, names array<string>")
    c = X.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("who"))
    ident = F.concat(F.lit("pair:"), "k", F.lit(":"), "who")
    concepts = c.select(ident.alias("id"), F.lit(1).cast("long").alias("revision"))
    aliases = c.select(ident.alias("concept_id"), F.concat(ident, F.lit(":own")).alias("alias_key"), F.lit(True).alias("is_preferred"))
    changed = (F.split("concept_id", ":")[1].cast("long") % 4 == 2) & F.col("concept_id").endswith("a")
    before = GM.Snapshot(concepts=concepts, aliases=aliases.withColumn("is_preferred", ~changed))
    keys = F.transform("names", lambda n: F.when(n == "new", F.concat(F.lit("new:"), F.col("k"))).otherwise(F.concat(ident, F.lit(":own"))))
    return GM.replace_aliases(concepts, aliases, r.select("ordinal", ident.alias("id"), "revision", keys.alias("keys"), F.lit(1).alias("n_preferred")), before)


@query(
    "graph_ordered_concepts",
    """WITH c AS (SELECT c_custkey AS k, max(c_custkey) OVER () AS top FROM customer) SELECT k AS ordinal, CASE WHEN k % 7 % 2 = 0 THEN 'created' ELSE 'alias_set_mismatch' END AS outcome FROM c
 UNION ALL SELECT k + 1000000000, CASE WHEN k % 7 % 2 = 0 THEN 'existing' WHEN k = top THEN 'alias_set_mismatch' ELSE 'alias_owned' END FROM c""",
)
def graph_ordered_concepts(spark, d):
    """Chains of seven requests, each of which shares a key with the next: one that fails leaves
    its keys to the next one.  Then all once more."""
    k = F.col("c_custkey")
    keys = F.array(F.struct(F.concat(F.lit("chain:"), F.floor(k / 7), F.lit(":"), k % 7).alias("key"), F.lit(True).alias("preferred")), F.struct(F.concat(F.lit("chain:"), F.floor(k / 7), F.lit(":"), k % 7 + 1).alias("key"), F.lit(False).alias("preferred")))
    r = X.read(spark, d, "customer").select(F.array(k, k + 1_000_000_000).alias("ordinals"), keys.alias("keys"))
    r = r.select(F.explode("ordinals").alias("ordinal"), "keys").select("ordinal", F.explode("keys").alias("x")).select("ordinal", "x.*")
    aliases = X.graph(spark, d)[0].select(F.col("id").alias("concept_id"), F.col("id").alias("alias_key"), F.lit(True).alias("is_preferred"))
    return GM.create_concepts(aliases, r)


@query("graph_ordered_assertions", _outcomes(4, [(0, 1, "missing_source"), (0, 2, "created"), (0, 3, "existing"), (1, 1, "created"), (1, 2, "evidence_limit"), (1, 3, "existing"), (1, 4, "evidence_limit"), (2, 1, "evidence_limit"), (2, 2, "existing"), (3, 1, "missing_concept"), (3, 2, "invalid_input"), (3, 3, "created")]))
def graph_ordered_assertions(spark, d):
    """Failed requests leave nothing (0, 3); evidence fills up (1) from what is stored (2)."""
    rows = [(0, 1, 5, -9, -9), (0, 2, 5, 1, 3), (0, 3, 5, 1, 3), (1, 1, 5, 1, 20), (1, 2, 5, 21, 40), (1, 3, 5, 15, 32), (1, 4, 5, 33, 33), (2, 1, 0, 33, 33), (2, 2, 0, 2, 9), (3, 1, 9, 1, 1), (3, 2, 5, 1, 0), (3, 3, 5, 1, 32)]
    r = _series(spark, d, 4, rows, "kind int, lo long, hi long")
    concepts, a = X.graph(spark, d)
    a = a.filter("id like 'c%'")
    sources = X.read(spark, d, "part").select(F.col("p_partkey").alias("source_ref_id"))
    full = X.read(spark, d, "customer").filter("c_custkey % 4 = 2").select(F.concat(F.lit("c"), "c_custkey").alias("assertion_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(32).cast("long"))).alias("source_ref_id"))
    nation = F.concat(F.lit("nation:"), "nation")
    ids = F.when(F.col("hi") < F.col("lo"), F.array().cast("array<long>")).otherwise(F.sequence("lo", F.greatest("lo", "hi")))
    req = r.select("ordinal", _key("customer:").alias("subject"), F.when(F.col("kind") == 0, "part_of").otherwise("uses").alias("relation"), F.when(F.col("kind") == 9, "nobody").otherwise(nation).alias("object"), ids.alias("source_ids"))
    return GM.create_assertions(concepts, a, full, sources, req)


@query(
    "graph_source_drift",
    """SELECT o_orderkey AS ordinal, CASE o_orderkey % 6 WHEN 0 THEN 'deleted' WHEN 4 THEN 'missing' WHEN 5 THEN 'referenced' ELSE 'snapshot_drift' END AS on_delete,
 CASE o_orderkey % 6 WHEN 0 THEN 'created' WHEN 4 THEN 'missing_source' WHEN 5 THEN 'existing' ELSE 'snapshot_drift' END AS on_mention,
 CASE o_orderkey % 6 WHEN 0 THEN 'created' WHEN 3 THEN 'missing_source' WHEN 4 THEN 'missing_source' WHEN 5 THEN 'created' ELSE 'snapshot_drift' END AS on_evidence FROM orders""",
)
def graph_source_drift(spark, d):
    """Sources by identity: unchanged (0), new since (1), under another number then (2), since then
    under another identity (3), gone (4), mentioned (5)."""
    k = F.col("o_orderkey")
    o = X.read(spark, d, "orders")
    row = lambda ref, e: (ref.alias("source_ref_id"), F.lit("memory_version").alias("source_kind"), e.cast("string").alias("external_id"), F.when(k % 2 == 0, 1).cast("long").alias("external_version"))
    now = o.filter(k % 6 != 4).select(*row(k, F.when(k % 6 == 3, F.concat(F.lit("moved "), k)).otherwise(k.cast("string"))))
    then = o.filter(k % 6 != 1).select(*row(F.when(k % 6 == 2, -k).otherwise(k), k))
    before = GM.Snapshot(sources=then)
    r = o.select(k.alias("ordinal"), *row(k, k)[1:], F.concat(F.lit("customer:"), "o_custkey").alias("concept_id"), F.concat(F.lit("c"), "o_custkey").alias("assertion_id"))
    concepts, a = X.graph(spark, d)
    mentions = o.filter(k % 6 == 5).select(F.concat(F.lit("customer:"), "o_custkey").alias("concept_id"), k.alias("source_ref_id"))
    none = o.select(F.concat(F.lit("c"), "o_custkey").alias("assertion_id"), k.alias("source_ref_id")).filter("false")
    found = GM.resolve_sources(r, now, before)
    deleted = GM.delete_sources(now, mentions, none, found).select("ordinal", F.col("outcome").alias("on_delete"))
    mentioned = G.mention_outcomes(concepts, now, mentions, found.withColumn("op", F.lit("create"))).select("ordinal", F.col("outcome").alias("on_mention"))
    # a source each, so that no assertion fills up
    own = r.select(F.concat(F.lit("own"), "ordinal").alias("id"))
    supported = G.evidence_outcomes(own, now, none, GM.resolve_sources(r, now, before, moved_is_drift=False).withColumns({"op": F.lit("add"), "assertion_id": F.concat(F.lit("own"), "ordinal")})).select("ordinal", F.col("outcome").alias("on_evidence"))
    return deleted.join(mentioned, "ordinal").join(supported, "ordinal")
