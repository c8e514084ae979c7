"""Batches of changes to the graph, served in order, and the drift of what they were made on.

Requests of a batch carry an ordinal; each one meets what those before it have left, whatever
they depend on.  Where only an item itself decides (deletions), that is a window.  Where requests
depend on each other through keys (aliases, triples), requests and stored rows that share keys
form components, and each component is a sorted stream: its stored rows first, then its requests.
A stream holds the component's own keys; independent requests are served in parallel.

A request is made on a snapshot.  ``before`` holds the tables as they were then; a request whose
rows (and sets of aliases or evidence) are no longer the same is answered ``snapshot_drift``,
after ``missing`` and before ``stale``.  Without ``before`` nothing has drifted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import limits
from ..sources.shared import gone, written
from .components import hashed, key_labels
from .graph import canonical_ends, flagged

LIMIT = limits.EVIDENCE_PER_ASSERTION


@dataclass(frozen=True)
class Snapshot:
    """Tables as a request found them; None where it doesn't look."""

    concepts: DataFrame | None = None
    aliases: DataFrame | None = None
    assertions: DataFrame | None = None
    evidence: DataFrame | None = None
    sources: DataFrame | None = None


# --- drift ----------------------------------------------------------------------------------


def _alias_sets(aliases: DataFrame) -> DataFrame:
    """id, alias_set of every concept that has aliases; all columns of an alias count."""
    rest = sorted(c for c in aliases.columns if c != "concept_id")
    return aliases.groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct(*rest))).alias("alias_set"))


def _changed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """key, drift: rows of ``now`` that are not in ``before`` as they are, null-safely."""
    rest = [c for c in now.columns if c != key]
    old = before.select(F.col(key).alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in rest])
    same = F.col("b_key").isNotNull()
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return now.join(old, F.col(key) == F.col("b_key"), "left").filter(~same).select(key, F.lit(True).alias("drift"))


def concept_drift(concepts: DataFrame, aliases: DataFrame, before: Snapshot | None) -> DataFrame:
    """id, drift of the concepts whose revision or set of aliases is another one than ``before``."""
    whole = lambda c, a: c.select("id", "revision").join(_alias_sets(a), "id", "left")
    now = whole(concepts, aliases)
    return _changed(now, now if before is None else whole(before.concepts, before.aliases), "id")


def assertion_drift(assertions: DataFrame, evidence: DataFrame | None, before: Snapshot | None) -> DataFrame:
    """id, drift of the assertions whose row, or with ``evidence`` whose set of sources, is another one than ``before``."""

    def whole(a: DataFrame, e: DataFrame | None) -> DataFrame:
        rows = a.select("id", "revision", "subject", "relation", "object")
        if e is None:
            return rows
        held = e.groupBy(F.col("assertion_id").alias("id")).agg(F.array_sort(F.collect_set("source_ref_id")).alias("held"))
        return rows.join(held, "id", "left")

    now = whole(assertions, evidence)
    return _changed(now, now if before is None else whole(before.assertions, None if evidence is None else before.evidence), "id")


_IDENTITY = ("source_kind", "external_id", "external_version")


def resolve_sources(requests: DataFrame, sources: DataFrame, before: Snapshot | None = None, moved_is_drift: bool = True) -> DataFrame:
    """requests with a source's identity (kind, external id, version or null) -> + source_ref_id
    and source_fault: missing_source, snapshot_drift or null.

    An identity that is gone while its source lives on under another one has drifted if
    ``moved_is_drift``, and is missing otherwise."""

    def place(table: DataFrame, tag: str) -> DataFrame:
        return table.select(*[F.col(c).alias(f"{tag}_{c}") for c in _IDENTITY], F.col("source_ref_id").alias(f"{tag}_ref"))

    def on(tag: str):
        k, e, v = ((F.col(c), F.col(f"{tag}_{c}")) for c in _IDENTITY)
        return (k[0] == k[1]) & (e[0] == e[1]) & v[0].eqNullSafe(v[1])

    out = requests.join(place(sources, "n"), on("n"), "left")
    if before is None:
        drift = F.lit(False)
    else:
        out = out.join(place(before.sources, "b"), on("b"), "left").join(sources.select(F.col("source_ref_id").alias("l_ref")).distinct(), F.col("b_ref") == F.col("l_ref"), "left")
        drift = F.when(F.col("n_ref").isNotNull(), ~F.col("n_ref").eqNullSafe(F.col("b_ref"))).otherwise(F.col("l_ref").isNotNull() & F.lit(moved_is_drift))
    fault = F.when(drift, "snapshot_drift").when(F.col("n_ref").isNull(), "missing_source")
    return out.select(*requests.columns, F.col("n_ref").alias("source_ref_id"), fault.alias("source_fault"))


# --- deletions ------------------------------------------------------------------------------


def _gone_after_first(judged: DataFrame, key: str) -> DataFrame:
    """ordinal, outcome: what a first successful deletion leaves of later ones is ``missing``."""
    first = F.min(F.when(F.col("outcome") == "deleted", F.col("ordinal"))).over(Window.partitionBy(key))
    return judged.withColumn("first", first).select("ordinal", F.when(F.col("first") < F.col("ordinal"), "missing").otherwise(F.col("outcome")).alias("outcome"))


def delete_concepts(concepts: DataFrame, mentions: DataFrame, assertions: DataFrame, requests: DataFrame, aliases: DataFrame | None = None, before: Snapshot | None = None) -> DataFrame:
    """requests (ordinal, id, revision) -> missing / snapshot_drift / stale / referenced / deleted."""
    used = mentions.select(F.col("concept_id").alias("id")).unionByName(assertions.select(F.col("subject").alias("id"))).unionByName(assertions.select(F.col("object").alias("id"))).distinct().withColumn("used", F.lit(True))
    j = requests.join(concepts.select("id", F.col("revision").alias("stored")), "id", "left").join(used, "id", "left")
    j = j.join(concept_drift(concepts, aliases, before), "id", "left") if before is not None else j.withColumn("drift", F.lit(None).cast("boolean"))
    out = F.when(F.col("stored").isNull(), "missing").when(F.col("drift"), "snapshot_drift").when(~F.col("stored").eqNullSafe(F.col("revision")), "stale").when(F.col("used"), "referenced").otherwise("deleted")
    return _gone_after_first(j.select("ordinal", "id", out.alias("outcome")), "id")


def delete_assertions(assertions: DataFrame, requests: DataFrame, evidence: DataFrame | None = None, before: Snapshot | None = None) -> DataFrame:
    """requests (ordinal, id, revision) -> invalid_input (revision below 1) / missing /
    snapshot_drift (row, or set of sources) / stale / deleted."""
    j = requests.join(assertions.select("id", F.col("revision").alias("stored")), "id", "left")
    j = j.join(assertion_drift(assertions, evidence, before), "id", "left") if before is not None else j.withColumn("drift", F.lit(None).cast("boolean"))
    bad = F.col("id").isNull() | F.col("revision").isNull() | (F.col("revision") < 1)
    out = F.when(bad, "invalid_input").when(F.col("stored").isNull(), "missing").when(F.col("drift"), "snapshot_drift").when(F.col("stored") != F.col("revision"), "stale").otherwise("deleted")
    return _gone_after_first(j.select("ordinal", "id", out.alias("outcome")), "id")


def delete_sources(sources: DataFrame, mentions: DataFrame, evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, source_ref_id, as from ``resolve_sources`` with source_fault, or without) ->
    missing / snapshot_drift / referenced / deleted."""
    used = mentions.select("source_ref_id").unionByName(evidence.select("source_ref_id")).distinct().withColumn("used", F.lit(True))
    j = requests.join(sources.select("source_ref_id").distinct().withColumn("known", F.lit(True)), "source_ref_id", "left").join(used, "source_ref_id", "left")
    drift = F.col("source_fault") == "snapshot_drift" if "source_fault" in requests.columns else F.lit(False)
    out = F.when(drift, "snapshot_drift").when(F.col("known").isNull(), "missing").when(F.col("used"), "referenced").otherwise("deleted")
    return _gone_after_first(j.select("ordinal", "source_ref_id", out.alias("outcome")), "source_ref_id")


# --- components in order --------------------------------------------------------------------


def _served(stored: DataFrame, requests: DataFrame, make: Callable) -> DataFrame:
    """ordinal, outcome of ``requests`` on the ``stored`` rows that share keys with them.

    Both have ``keys``; ``make()`` gives the state of a component, with ``hold(row)`` and
    ``serve(row) -> outcome``; rows are tuples of the columns of ``requests`` and ``stored``.  Keys are
    hashed to find components only: keys that share a hash are served in one stream, by themselves."""
    stored = written(stored.withColumn("hashes", hashed(F.col("keys"))).drop("keys").withColumns({"held": F.lit(True), "ordinal": F.lit(-1).cast("long")}), "stored")
    item = F.concat(F.lit("request:"), F.lpad(F.col("ordinal").cast("string"), 19, "0"))
    requests = written(requests.withColumn("hashes", hashed(F.col("keys"))).drop("keys").withColumns({"held": F.lit(False), "item": item, "ordinal": F.col("ordinal").cast("long")}), "requests")
    asked = requests.select(F.explode("hashes").alias("key")).distinct()
    touched = stored.select(F.xxhash64("item").alias("t_item"), F.explode("hashes").alias("key")).join(asked, "key", "left_semi").select("t_item").distinct()
    stored = stored.join(touched, F.xxhash64("item") == F.col("t_item"), "left_semi")
    rows = written(stored.unionByName(requests, allowMissingColumns=True).withColumn("first", F.when(F.size("hashes") > 0, F.col("hashes")[0]).otherwise(F.xxhash64("item"))), "rows")
    gone(requests)
    labels = key_labels(rows.select(F.col("hashes").alias("keys")))
    rows = rows.join(labels, F.col("first") == F.col("key"), "left").withColumn("component", F.coalesce("label", "first")).drop("key", "label", "first", "hashes")
    rows = rows.repartition("component").sortWithinPartitions("component", ~F.col("held"), "ordinal", "item").drop("item")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.component != now:
                    now, state = row.component, make()
                if row.held:
                    state.hold(row)
                else:
                    out.append((row.ordinal, state.serve(row)))
            yield pd.DataFrame(out, columns=["ordinal", "outcome"]).astype({"ordinal": "int64"})

    return rows.mapInPandas(run, "ordinal long, outcome string")


class _NewConcepts:
    """Alias sets by concept, for creations."""

    def __init__(self) -> None:
        self.sets: dict[str, frozenset] = {}
        self.owner: dict[str, str] = {}

    def put(self, concept: str, aliases: frozenset) -> None:
        self.sets[concept] = aliases
        self.owner.update((key, concept) for key, _ in aliases)

    def hold(self, row) -> None:
        self.put(row.concept, frozenset(zip(row.aliases, row.flags, strict=True)))

    def serve(self, row) -> str:
        asked = frozenset(zip(row.aliases, row.flags, strict=True))
        owners = {self.owner[k] for k in row.aliases if k in self.owner}
        if any(self.sets[o] == asked for o in owners):
            return "existing"
        if owners:
            return "alias_set_mismatch" if len(owners) == 1 else "alias_owned"
        self.put(f"new:{row.ordinal}", asked)
        return "created"


def create_concepts(aliases: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, key, preferred: a row per alias) -> ordinal, outcome.

    existing: a concept has exactly these keys and flags; alias_set_mismatch: one concept owns
    some key; alias_owned: several do; else created, and owner of its keys from then on."""
    lists = lambda df, by: df.groupBy(by).agg(F.array_sort(F.collect_set(F.struct("key", "preferred"))).alias("a")).select(by, F.col("a.key").alias("aliases"), F.col("a.preferred").alias("flags"), F.transform("a.key", lambda k: F.concat(F.lit("k:"), k)).alias("keys"))
    stored = lists(aliases.select("concept_id", F.col("alias_key").alias("key"), F.col("is_preferred").alias("preferred")), "concept_id").withColumnRenamed("concept_id", "concept")
    return _served(stored.withColumn("item", F.concat(F.lit("concept:"), "concept")), lists(requests, "ordinal"), _NewConcepts)


class _Revised:
    """Concepts' revisions and keys, for replacements of alias sets."""

    def __init__(self) -> None:
        self.revision: dict[str, int] = {}
        self.keys: dict[str, list] = {}
        self.owner: dict[str, str] = {}

    def hold(self, row) -> None:
        self.revision[row.id] = row.revision
        self.keys[row.id] = list(row.aliases)
        self.owner.update((k, row.id) for k in row.aliases)

    def serve(self, row) -> str:
        if row.id not in self.revision:
            return "missing"
        if row.drift:
            return "snapshot_drift"
        if self.revision[row.id] != row.revision:
            return "stale"
        if row.invalid:
            return "invalid_set"
        if any(self.owner.get(k, row.id) != row.id for k in row.aliases):
            return "alias_owned"
        for k in self.keys[row.id]:
            del self.owner[k]
        self.keys[row.id] = list(row.aliases)
        self.owner.update((k, row.id) for k in row.aliases)
        self.revision[row.id] += 1
        return "updated"


def replace_aliases(concepts: DataFrame, aliases: DataFrame, requests: DataFrame, before: Snapshot | None = None) -> DataFrame:
    """requests (ordinal, id, revision, keys array, n_preferred) -> missing / snapshot_drift / stale /
    invalid_set / alias_owned / updated (the revision rises, keys left out are free)."""
    named = lambda c: F.transform(c, lambda k: F.concat(F.lit("k:"), k))
    held = aliases.groupBy(F.col("concept_id").alias("id")).agg(F.collect_list("alias_key").alias("aliases"))
    stored = concepts.select("id", F.col("revision").cast("long").alias("revision")).join(held, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    itself = F.array(F.concat(F.lit("c:"), "id"))
    stored = stored.withColumns({"item": F.concat(F.lit("concept:"), "id"), "keys": F.concat(itself, named("aliases"))})
    invalid = (F.size("keys") < 1) | (F.size("keys") > limits.ALIASES_PER_CONCEPT) | (F.size(F.array_distinct("keys")) != F.size("keys")) | (F.col("n_preferred") != 1) | F.exists("keys", lambda k: k.isNull() | (k == ""))
    r = requests.select("ordinal", "id", F.coalesce(F.col("revision").cast("long"), F.lit(-1)).alias("revision"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "n_preferred")
    r = r.select("ordinal", "id", "revision", F.coalesce(invalid, F.lit(True)).alias("invalid"), F.filter("keys", lambda k: k.isNotNull()).alias("aliases"))
    if before is not None:
        r = r.join(concept_drift(concepts, aliases, before), "id", "left")
    r = r.withColumn("drift", F.coalesce("drift", F.lit(False)) if before is not None else F.lit(False)).withColumn("keys", F.concat(itself, named("aliases")))
    return _served(stored, r, _Revised)


class _Triples:
    """Assertions' revisions and triples, for updates."""

    def __init__(self) -> None:
        self.revision: dict[str, int] = {}
        self.triple: dict[str, str] = {}
        self.owner: dict[str, str] = {}

    def hold(self, row) -> None:
        self.revision[row.id], self.triple[row.id] = row.revision, row.triple
        self.owner[row.triple] = row.id

    def serve(self, row) -> str:
        if row.id not in self.revision:
            return "missing"
        if row.drift:
            return "snapshot_drift"
        if self.revision[row.id] != row.revision:
            return "stale"
        if row.no_concept:
            return row.no_concept
        if self.owner.get(row.triple, row.id) != row.id:
            return "duplicate"
        del self.owner[self.triple[row.id]]
        self.owner[row.triple], self.triple[row.id] = row.id, row.triple
        self.revision[row.id] += 1
        return "updated"


def _triple():
    """subject, relation and object as one key; lengths keep it unambiguous."""
    return F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in ("subject", "relation", "object")])


def update_assertions(concepts: DataFrame, assertions: DataFrame, requests: DataFrame, before: Snapshot | None = None) -> DataFrame:
    """requests (ordinal, id, revision, subject, relation, object) -> invalid_input / missing /
    snapshot_drift / stale / missing_subject / missing_object / duplicate / updated (the revision
    rises, the triple it had is free)."""
    r = canonical_ends(requests)
    r = flagged(flagged(r, "subject", concepts.select("id"), "s_ok"), "object", concepts.select("id"), "o_ok")
    bad = F.coalesce(F.col("is_symmetric").isNull() | (F.col("subject") == F.col("object")) | F.col("id").isNull() | (F.col("revision") < 1), F.lit(True))
    invalid = r.filter(bad).select(F.col("ordinal").cast("long").alias("ordinal"), F.lit("invalid_input").alias("outcome"))
    r = r.filter(~bad).select("ordinal", "id", F.col("revision").cast("long").alias("revision"), _triple().alias("triple"), F.when(F.col("s_ok").isNull(), "missing_subject").when(F.col("o_ok").isNull(), "missing_object").alias("no_concept"))
    if before is not None:
        r = r.join(assertion_drift(assertions, None, before), "id", "left")
    keys = F.array(F.concat(F.lit("a:"), "id"), F.concat(F.lit("t:"), "triple"))
    r = r.withColumn("drift", F.coalesce("drift", F.lit(False)) if before is not None else F.lit(False)).withColumn("keys", keys)
    stored = assertions.select("id", F.col("revision").cast("long").alias("revision"), _triple().alias("triple")).withColumns({"item": F.concat(F.lit("assertion:"), "id"), "keys": keys})
    return _served(stored, r, _Triples).unionByName(invalid)


def _serve_creations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by triple: what its assertion holds first, then its requests by ordinal; the state is
    at most ``LIMIT`` sources."""
    now, there, held = None, False, set()
    for pdf in batches:
        out = []
        for triple, ordinal, fault, sources in zip(pdf["triple"].tolist(), pdf["ordinal"].tolist(), pdf["fault"].tolist(), pdf["sources"].tolist(), strict=True):
            if triple != now:
                now, there, held = triple, False, set()
            if ordinal < 0:
                there, held = True, set(sources)
            elif fault:
                out.append((ordinal, fault))
            elif len(held | set(sources)) > LIMIT:
                out.append((ordinal, "evidence_limit"))
            else:
                out.append((ordinal, "existing" if there else "created"))
                there, held = True, held | set(sources)
        yield pd.DataFrame(out, columns=["ordinal", "outcome"]).astype({"ordinal": "int64"})


def create_assertions(concepts: DataFrame, assertions: DataFrame, evidence: DataFrame, sources: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, subject, relation, object, source_ids array) -> ordinal, outcome:
    invalid_input, missing_concept, missing_source, evidence_limit, existing (its sources are
    merged), created.  Requests for one triple are served in order; failed ones leave nothing."""
    r = canonical_ends(requests)
    asked = requests.select("ordinal", F.explode(F.array_distinct("source_ids")).alias("sid"))
    found = flagged(asked, "sid", sources.select("source_ref_id"), "known").filter("known").groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_found"))
    r = flagged(flagged(r, "subject", concepts.select("id"), "s_ok"), "object", concepts.select("id"), "o_ok").join(found, "ordinal", "left")
    bad = F.col("is_symmetric").isNull() | (F.col("subject") == F.col("object")) | (F.size("source_ids") < 1) | (F.size("source_ids") > LIMIT) | F.exists("source_ids", lambda s: s.isNull())
    fault = F.when(F.coalesce(bad, F.lit(True)), "invalid_input").when(F.col("s_ok").isNull() | F.col("o_ok").isNull(), "missing_concept").when(F.coalesce("n_found", F.lit(0)) < F.size(F.array_distinct("source_ids")), "missing_source")
    r = r.select(F.coalesce(_triple(), F.lit("")).alias("triple"), F.col("ordinal").cast("long").alias("ordinal"), fault.alias("fault"), F.coalesce(F.col("source_ids").cast("array<long>"), F.array().cast("array<long>")).alias("sources"))
    # sources of the requested triples only
    asked = r.select("triple").distinct()
    held = assertions.select(F.col("id").alias("assertion_id"), _triple().alias("triple")).join(asked, "triple", "left_semi").join(evidence.select("assertion_id", F.col("source_ref_id").cast("long").alias("source_ref_id")), "assertion_id", "left")
    held = held.groupBy("triple").agg(F.collect_set("source_ref_id").alias("sources")).select("triple", F.lit(-1).cast("long").alias("ordinal"), F.lit(None).cast("string").alias("fault"), "sources")
    return held.unionByName(r).repartition("triple").sortWithinPartitions("triple", "ordinal").mapInPandas(_serve_creations, "ordinal long, outcome string")
