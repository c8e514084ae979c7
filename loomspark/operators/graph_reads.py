"""Reads of the knowledge graph by key, their payload bound, and alias sets.

A read is a plan over a table of requests, so that one request or millions are the same
equi-join.  Every request has a row: ``outcome`` is complete (``result`` is null if nothing is
found) or result_too_large (without the result)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import limits
from ..functions.text import alias_key_column, first_failure

#: A source as one object: the fields of the other kind are left out of its JSON.
SOURCE = "struct<kind:string,memory_id:string,version:bigint,session_record_id:string>"


def tagged_source(kind="source_kind", external_id="external_id", version="external_version"):
    """One object of one of two shapes: a memory version or a session record."""
    memory = F.col(kind) == "memory_version"
    return F.struct(
        F.col(kind).alias("kind"),
        F.when(memory, F.col(external_id)).alias("memory_id"),
        F.when(memory, F.col(version)).cast("long").alias("version"),
        F.when(F.col(kind) == "session_record", F.col(external_id)).alias("session_record_id"),
    ).cast(SOURCE)


def guarded(reads: DataFrame, most_bytes: int = limits.RESPONSE_BYTES) -> DataFrame:
    """(ordinal, result) -> ordinal, outcome, result: a result whose compact JSON payload is
    longer than ``most_bytes`` bytes is left out."""
    payload = F.to_json(F.struct(F.lit("complete").alias("outcome"), "result"), {"ignoreNullFields": "true"})
    # a payload without result says so with a null
    size = F.octet_length(payload) + F.when(F.col("result").isNull(), len(',"result":null')).otherwise(0)
    too_large = size > most_bytes
    return reads.select("ordinal", F.when(too_large, "result_too_large").otherwise("complete").alias("outcome"), F.when(~too_large, F.col("result")).alias("result"))


def _concepts(concepts: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, result of the concepts in ``wanted`` (id), aliases preferred first, then by key."""
    own = aliases.join(wanted, aliases["concept_id"] == wanted["id"], "left_semi")
    each = F.struct((~F.col("is_preferred")).alias("later"), F.col("alias_key").alias("key"), "display_text", F.col("is_preferred").alias("preferred"))
    per = own.groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_list(each)).alias("aliases"))
    listed = F.transform(F.coalesce("aliases", F.array().cast("array<struct<later:boolean,key:string,display_text:string,preferred:boolean>>")), lambda a: F.struct(a["display_text"].alias("display_text"), a["preferred"].alias("preferred")))
    held = concepts.join(wanted, "id", "left_semi").join(per, "id", "left")
    return held.select("id", F.struct("id", "revision", listed.alias("aliases")).alias("result"))


def get_concepts(concepts: DataFrame, aliases: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, id) -> ordinal, outcome, result (id, revision, aliases)."""
    found = _concepts(concepts, aliases, requests.select("id").distinct())
    return guarded(requests.join(found, "id", "left").select("ordinal", "result"))


def resolve_aliases(concepts: DataFrame, aliases: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, text) -> as :func:`get_concepts`, of the least concept whose alias key
    is the normalised text; a text without a key finds nothing."""
    r = requests.select("ordinal", alias_key_column(F.col("text")).alias("asked"))
    owner = aliases.groupBy(F.col("alias_key").alias("asked")).agg(F.min("concept_id").alias("id"))
    r = r.join(owner, "asked", "left")
    found = _concepts(concepts, aliases, r.filter("id is not null").select("id").distinct())
    return guarded(r.join(found, "id", "left").select("ordinal", "result"))


def get_assertions(assertions: DataFrame, evidence: DataFrame, sources: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, id) -> ordinal, outcome, result with the evidence ordered by kind,
    external id and version, a missing version first."""
    wanted = requests.select("id").distinct()
    own = evidence.join(wanted, evidence["assertion_id"] == wanted["id"], "left_semi").join(sources, "source_ref_id")
    # structs are ordered with nulls first
    each = F.struct("source_kind", "external_id", "external_version", tagged_source().alias("source"))
    per = own.groupBy(F.col("assertion_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(each)), lambda e: e["source"]).alias("evidence"))
    held = assertions.join(wanted, "id", "left_semi").join(per, "id", "left")
    result = F.struct("id", "revision", F.col("subject").alias("subject_concept_id"), F.col("relation").alias("relation_type"), F.col("object").alias("object_concept_id"), F.coalesce("evidence", F.array().cast(f"array<{SOURCE}>")).alias("evidence"))
    return guarded(requests.join(held.select("id", result.alias("result")), "id", "left").select("ordinal", "result"))


def get_sources(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, source_kind, external_id, external_version) -> ordinal, outcome,
    result; a null version finds a source without version only."""
    held = sources.select(F.col("source_kind").alias("k"), F.col("external_id").alias("e"), F.col("external_version").alias("v"), tagged_source().alias("result"))
    on = (F.col("source_kind") == F.col("k")) & (F.col("external_id") == F.col("e")) & F.col("external_version").eqNullSafe(F.col("v"))
    return guarded(requests.join(held, on, "left").select("ordinal", "result"))


def alias_set_faults(sets: DataFrame) -> DataFrame:
    """sets (ordinal, aliases array of (display_text, preferred)) -> ordinal, fault, keys,
    preferred_key: 1 to 64 aliases, each with a key, all keys different, one preferred."""
    each = sets.select("ordinal", F.posexplode_outer("aliases").alias("pos", "a")).select("ordinal", "pos", F.col("a.display_text").alias("text"), F.col("a.preferred").alias("preferred"))
    each = each.withColumn("key", alias_key_column(F.col("text")))
    wrong = F.col("pos").isNotNull() & (F.col("key").isNull() | (F.octet_length("text") > limits.ALIAS_DISPLAY_BYTES) | (F.octet_length("key") > limits.ALIAS_KEY_BYTES))
    per = each.groupBy("ordinal").agg(F.count("pos").alias("n"), F.coalesce(F.bool_or(wrong), F.lit(False)).alias("wrong"), F.countDistinct("key").alias("different"), F.count_if("preferred").alias("n_preferred"), F.array_sort(F.collect_set("key")).alias("keys"), F.max(F.when(F.col("preferred"), F.col("key"))).alias("preferred_key"))
    fault = first_failure(
        (F.col("n") == 0, "alias_set:empty"),
        (F.col("n") > limits.ALIASES_PER_CONCEPT, "alias_set:too_long"),
        (F.col("wrong"), "alias:invalid"),
        (F.col("different") != F.col("n"), "alias_set:invalid_shape"),
        (F.col("n_preferred") != 1, "preferred_alias:invalid_shape"),
    )
    ok = fault.isNull()
    return per.select("ordinal", fault.alias("fault"), F.when(ok, F.col("keys")).alias("keys"), F.when(ok, F.col("preferred_key")).alias("preferred_key"))


def neighbor_records(neighbors: DataFrame, concepts: DataFrame, aliases: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of a neighbour read with their concept (id, revision, preferred name) and the
    number of pieces of evidence; ``neighbors`` holds a few hundred rows at most."""
    n = F.broadcast(neighbors)
    name = aliases.filter("is_preferred").groupBy(F.col("concept_id").alias("neighbor")).agg(F.min("display_text").alias("name"))
    held = concepts.select(F.col("id").alias("neighbor"), "revision")
    count = evidence.join(n.select("assertion_id"), "assertion_id", "left_semi").join(sources.select("source_ref_id"), "source_ref_id", "left_semi").groupBy("assertion_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    few = held.join(n.select("neighbor").distinct(), "neighbor", "left_semi")
    named = name.join(n.select("neighbor").distinct(), "neighbor", "left_semi")
    return neighbors.join(few, "neighbor", "left").join(named, "neighbor", "left").join(count, "assertion_id", "left").select("rank", "relation", "orientation", "neighbor", "revision", "name", "assertion_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def order_faults(rows: DataFrame, order: list) -> DataFrame:
    """rank of rows that break the promised order: ranks run from 1 and the keys never fall."""
    from pyspark.sql import Window

    keys = F.struct(*order)
    # results of reads are bounded by their limits, so that one task may see them all
    before = F.lag(keys).over(Window.orderBy("rank"))
    place = F.row_number().over(Window.orderBy("rank"))
    return rows.select("rank", (F.col("rank") != place).alias("gap"), (before > keys).alias("falls")).filter("gap or falls").select("rank", F.when(F.col("gap"), "rank").otherwise("order").alias("fault"))
