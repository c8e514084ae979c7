"""The driver's tables as domain tables, in Spark and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-16 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark, d):
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("id"), (F.col("turn") + 1).alias("version"), F.col("role").alias("type"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), F.array("role").alias("concepts"))


MEMORIES = "memories AS (SELECT CAST(conv_id AS VARCHAR) AS id, turn + 1 AS version, role AS type, substr(text, 1, 40) AS title, text AS content FROM conversations)"


def corpus(spark, d):
    c = read(spark, d, "documents")
    return c.select(F.col("doc_id").cast("string").alias("id"), F.lit(1).cast("long").alias("version"), F.col("source").alias("type"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), F.array("lang").alias("concepts"))


CORPUS = "corpus AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS version, source AS type, substr(text, 1, 40) AS title, text AS content, lang FROM documents)"


def embeddings(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit(1).cast("long").alias("version"), "embedding")


EMBEDDINGS = "emb AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS version, embedding FROM embeddings)"


def query_vector(spark, d) -> list[float]:
    row = read(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


def ledger(spark, d):
    """(lifecycle, observations) of sessions user:day."""
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "error", "session_end").otherwise("observation")
    ts = F.col("ts").cast("timestamp")
    e = e.select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format(ts, "yyyy-MM-dd")).alias("session_id"), kind.alias("event_type"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("receipt_id"), ts.alias("source_timestamp_utc"), ts.alias("ingested_at"), F.col("props").alias("data"))
    return e.filter("event_type != 'observation'"), e.filter("event_type = 'observation'")


LEDGER = """led AS (SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS session_id,
 CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'session_end' ELSE 'observation' END AS event_type,
 lpad(CAST(event_id AS VARCHAR), 12, '0') AS receipt_id, ts, props AS data FROM events)"""


def now():
    return F.lit(NOW).cast("timestamp")


def graph(spark, d, uses: bool = False):
    """(concepts, assertions): nation part_of region, customer and supplier part_of nation,
    suppliers of a nation related_to the next one, and with ``uses`` supplier uses part."""
    r, n, c, s = (read(spark, d, x) for x in ("region", "nation", "customer", "supplier"))
    key = lambda k, col: F.concat(F.lit(f"{k}:"), F.col(col).cast("string"))
    concepts = r.select(key("region", "r_regionkey").alias("id")).unionByName(n.select(key("nation", "n_nationkey").alias("id"))).unionByName(c.select(key("customer", "c_custkey").alias("id"))).unionByName(s.select(key("supplier", "s_suppkey").alias("id")))
    a = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), key("nation", "n_nationkey").alias("subject"), F.lit("part_of").alias("relation"), key("region", "n_regionkey").alias("object"))
    a = a.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), key("customer", "c_custkey").alias("subject"), F.lit("part_of").alias("relation"), key("nation", "c_nationkey").alias("object")))
    a = a.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), key("supplier", "s_suppkey").alias("subject"), F.lit("part_of").alias("relation"), key("nation", "s_nationkey").alias("object")))
    if uses:
        p = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
        a = a.unionByName(p.select(F.concat(F.lit("u"), "l_suppkey", F.lit("-"), "l_partkey").alias("id"), key("supplier", "l_suppkey").alias("subject"), F.lit("uses").alias("relation"), key("part", "l_partkey").alias("object")))
        t = s.select("s_suppkey", "s_nationkey")
        u = t.select(F.col("s_suppkey").alias("k2"), F.col("s_nationkey").alias("n2"))
        pairs = t.join(u, (F.col("s_nationkey") == F.col("n2")) & (F.col("s_suppkey") < F.col("k2")))
        x, y = key("supplier", "s_suppkey"), key("supplier", "k2")
        a = a.unionByName(pairs.select(F.concat(F.lit("r"), "s_suppkey", F.lit("-"), "k2").alias("id"), F.least(x, y).alias("subject"), F.lit("related_to").alias("relation"), F.greatest(x, y).alias("object")))
    return concepts.withColumn("revision", F.lit(1).cast("long")), a.withColumn("revision", F.lit(1).cast("long"))


ASSERTIONS = """asr AS (SELECT 'n' || n_nationkey AS id, 'nation:' || n_nationkey AS subject, 'part_of' AS relation, 'region:' || n_regionkey AS object FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'customer:' || c_custkey, 'part_of', 'nation:' || c_nationkey FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'supplier:' || s_suppkey, 'part_of', 'nation:' || s_nationkey FROM supplier)"""
ASSERTIONS_USES = ASSERTIONS[:-1] + """
 UNION ALL SELECT DISTINCT 'u' || l_suppkey || '-' || l_partkey, 'supplier:' || l_suppkey, 'uses', 'part:' || l_partkey FROM lineitem
 UNION ALL SELECT 'r' || a.s_suppkey || '-' || b.s_suppkey, least('supplier:' || a.s_suppkey, 'supplier:' || b.s_suppkey), 'related_to', greatest('supplier:' || a.s_suppkey, 'supplier:' || b.s_suppkey) FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)"""
CONCEPTS = "con AS (SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier)"


def provenance(spark, d):
    """(sources, evidence, mentions): an order is a source, evidence for its customer's place
    in a nation; urgent orders mention their customer."""
    o = read(spark, d, "orders")
    sources = o.select(F.col("o_orderkey").alias("source_ref_id"), F.lit("memory_version").alias("source_kind"), F.col("o_orderkey").cast("string").alias("external_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 5 + 1).alias("external_version"))
    evidence = o.select(F.concat(F.lit("c"), "o_custkey").alias("assertion_id"), F.col("o_orderkey").alias("source_ref_id"))
    mentions = o.filter(F.col("o_orderpriority").startswith("1")).select(F.concat(F.lit("customer:"), "o_custkey").alias("concept_id"), F.col("o_orderkey").alias("source_ref_id"))
    return sources, evidence, mentions


PROVENANCE = """src AS (SELECT o_orderkey AS source_ref_id, 'memory_version' AS source_kind, CAST(o_orderkey AS VARCHAR) AS external_id, CASE WHEN o_orderkey % 7 != 0 THEN o_orderkey % 5 + 1 END AS external_version FROM orders),
 evi AS (SELECT 'c' || o_custkey AS assertion_id, o_orderkey AS source_ref_id FROM orders),
 men AS (SELECT 'customer:' || o_custkey AS concept_id, o_orderkey AS source_ref_id FROM orders WHERE starts_with(o_orderpriority, '1'))"""
