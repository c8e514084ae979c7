"""The knowledge graph: reads, bounded simple paths, audits, mutation outcomes.

Edges are made directed once, by a union of both directions, so every expansion is an
equi-join (a disjunctive join would be a nested loop)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import limits
from ..sources.shared import written

#: Relation types and whether they are symmetric.
RELATIONS = (("related_to", True), ("contradicts", True), ("is_a", False), ("part_of", False), ("depends_on", False), ("uses", False), ("implements", False), ("causes", False), ("resolves", False))


def relation_types(spark) -> DataFrame:
    return spark.createDataFrame(list(RELATIONS), "code string, is_symmetric boolean")


def directed(assertions: DataFrame, direction: str = "either") -> DataFrame:
    """src, dst, id, relation, orientation for a traversal in ``direction`` (outgoing, incoming,
    either); symmetric edges are passable in every direction."""
    spark = assertions.sparkSession
    a = assertions.join(F.broadcast(relation_types(spark)), F.col("relation") == F.col("code")).drop("code")
    out = a.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "id", "relation", F.when(F.col("is_symmetric"), "symmetric").otherwise("outgoing").alias("orientation"))
    inc = a.select(F.col("object").alias("src"), F.col("subject").alias("dst"), "id", "relation", F.when(F.col("is_symmetric"), "symmetric").otherwise("incoming").alias("orientation"))
    keep = {"outgoing": ("outgoing", "symmetric"), "incoming": ("incoming", "symmetric"), "either": ("outgoing", "incoming", "symmetric")}[direction]
    return out.unionByName(inc).filter(F.col("orientation").isin(*keep))


def neighbors(assertions: DataFrame, concept: str, direction: str = "either", relations: tuple[str, ...] = (), limit: int = limits.NEIGHBORS) -> DataFrame:
    limits.bounded("limit", limit, 1, limits.NEIGHBORS)
    # the concept is pushed below the union into both scans
    e = directed(assertions.filter((F.col("subject") == concept) | (F.col("object") == concept)), direction).filter(F.col("src") == concept)
    if relations:
        e = e.filter(F.col("relation").isin(*sorted(set(relations))))
    order = ["relation", "orientation", "dst", "id"]
    return e.orderBy(*order).limit(limit).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "relation", "orientation", F.col("dst").alias("neighbor"), F.col("id").alias("assertion_id"))


def related_sources(assertions: DataFrame, evidence: DataFrame, mentions: DataFrame, sources: DataFrame, concept: str, limit: int = limits.RELATED_SOURCES) -> DataFrame:
    limits.bounded("limit", limit, 1, limits.RELATED_SOURCES)
    m = mentions.filter(F.col("concept_id") == concept).select("source_ref_id", F.lit(0).alias("role"))
    own = assertions.filter((F.col("subject") == concept) | (F.col("object") == concept)).select(F.col("id").alias("assertion_id"))
    e = evidence.join(own, "assertion_id", "left_semi").select("source_ref_id", F.lit(1).alias("role"))
    links = m.unionByName(e).distinct().join(sources, "source_ref_id")
    order = [F.col("role"), F.col("source_kind"), F.col("external_id"), F.col("external_version").asc_nulls_first()]
    return links.orderBy(*order).limit(limit).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.when(F.col("role") == 0, "mention").otherwise("evidence").alias("role"), "source_kind", "external_id", "external_version")


def find_paths(assertions: DataFrame, start: str, end: str, direction: str = "either", max_depth: int = 4, max_work: int = limits.PATH_WORK, limit: int = limits.PATHS) -> DataFrame:
    """rank, hops, concept_ids, assertion_ids, orientations, work, outcome.

    Every generated state counts, the start included; beyond ``max_work`` the only row says
    work_exhausted.  A level is one job: its open states, at most ``max_work`` rows of at most
    nine ids, are broadcast to the edges, which are scanned and never shuffled; the search stops
    at the first empty level, or at the first state too many."""
    if start == end:
        raise ValueError("the ends of a path must differ")
    limits.bounded("max_depth", max_depth, 1, limits.PATH_DEPTH)
    limits.bounded("max_work", max_work, 1, limits.PATH_WORK)
    limits.bounded("limit", limit, 1, limits.PATHS)
    spark = assertions.sparkSession
    edges = directed(assertions, direction).select("src", "dst", "id", "orientation")
    schema = "at string, c array<string>, a array<string>, o array<string>"
    open_, found, work = [(start, [start], [], [])], [], 1
    for _ in range(max_depth):
        if not open_ or work > max_work:
            break
        level = F.broadcast(spark.createDataFrame(open_, schema))
        level = edges.join(level, F.col("at") == F.col("src")).filter(~F.array_contains("c", F.col("dst")) & ~F.array_contains("a", F.col("id")))
        level = level.select(F.col("dst").alias("at"), F.array_append("c", F.col("dst")).alias("c"), F.array_append("a", F.col("id")).alias("a"), F.array_append("o", F.col("orientation")).alias("o"))
        rows = [tuple(r) for r in level.limit(max_work + 1 - work).collect()]  # bounded by max_work
        work += len(rows)
        found += [r for r in rows if r[0] == end]
        open_ = [r for r in rows if r[0] != end]
    out = "rank int, hops int, concept_ids string, assertion_ids string, orientations string, work long, outcome string"
    if work > max_work:
        return spark.createDataFrame([(0, 0, "", "", "", max_work + 1, "work_exhausted")], out)
    found.sort(key=lambda r: (len(r[2]), *[[x.encode() for x in ids] for ids in (r[2], r[1])]))
    best = [(k, len(r[2]), ">".join(r[1]), ">".join(r[2]), ">".join(r[3]), work, "found") for k, r in enumerate(found[:limit], 1)]
    return spark.createDataFrame(best, out)


def audit(concepts: DataFrame, aliases: DataFrame, assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """violation, item: assertions without evidence, concepts without exactly one preferred
    alias, symmetric assertions whose ends are not in order."""
    spark = assertions.sparkSession
    bare = assertions.join(evidence.select(F.col("assertion_id").alias("id")), "id", "left_anti").select(F.lit("no_evidence").alias("violation"), F.col("id").alias("item"))
    p = aliases.groupBy(F.col("concept_id").alias("id")).agg(F.count_if("is_preferred").alias("n"))
    pref = concepts.join(p, "id", "left").filter(F.coalesce("n", F.lit(0)) != 1).select(F.lit("preferred_alias").alias("violation"), F.col("id").alias("item"))
    sym = assertions.join(F.broadcast(relation_types(spark).filter("is_symmetric")), F.col("relation") == F.col("code"), "left_semi").filter("subject >= object").select(F.lit("symmetric_order").alias("violation"), F.col("id").alias("item"))
    return bare.unionByName(pref).unionByName(sym)


def canonical_ends(df: DataFrame) -> DataFrame:
    """subject and object of symmetric relations in order."""
    spark = df.sparkSession
    t = df.join(F.broadcast(relation_types(spark)), F.col("relation") == F.col("code"), "left")
    flip = F.coalesce("is_symmetric", F.lit(False)) & (F.col("subject") > F.col("object"))
    return t.withColumns({"subject": F.when(flip, F.col("object")).otherwise(F.col("subject")), "object": F.when(flip, F.col("subject")).otherwise(F.col("object"))}).drop("code")


#: Rows that share a key from which on the key is looked up apart.
MANY = 10_000


def flagged(rows: DataFrame, key: str, ids: DataFrame, flag: str, many: int = MANY) -> DataFrame:
    """``rows`` (with ordinal) + ``flag``: true where ``key`` is one of ``ids`` (one column), else null.

    A key of ``many`` rows and more, null included, is looked up once and its answer is broadcast (at most
    a key for ``many`` rows); its rows are spread over the join's tasks instead of meeting in one."""
    known = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    often = rows.groupBy(F.col(key).alias("__often")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= many)
    often = written(often.join(known, F.col("__often") == F.col("__id"), "left").select("__often", F.col("__id").isNotNull().alias("__there")), "often")
    spread = F.when(F.col("__there").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("ordinal"), F.lit(1000)))
    # always 0, but not a constant, which would not be a part of the join's key
    known = known.withColumn("__place", F.pmod(F.xxhash64("__id"), F.lit(1)))
    out = rows.join(F.broadcast(often), F.col(key).eqNullSafe(F.col("__often")), "left").withColumn("__spread", spread)
    out = out.join(known, (F.col(key) == F.col("__id")) & (F.col("__spread") == F.col("__place")), "left")
    return out.select(*rows.columns, F.when(F.col("__there") | F.col("__id").isNotNull(), True).alias(flag))


def register_sources(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, source_kind, external_id, external_version) -> existing / created;
    a null version equals a null version."""
    s = sources.select(F.col("source_kind").alias("k"), F.col("external_id").alias("e"), F.col("external_version").alias("v"), F.lit(True).alias("known")).distinct()
    j = requests.join(s, (F.col("source_kind") == F.col("k")) & (F.col("external_id") == F.col("e")) & F.col("external_version").eqNullSafe(F.col("v")), "left")
    first = F.row_number().over(Window.partitionBy("source_kind", "external_id", "external_version").orderBy("ordinal")) == 1
    return j.select("ordinal", F.when(F.col("known") | ~first, "existing").otherwise("created").alias("outcome"))


def _source_fault(requests: DataFrame):
    return F.col("source_fault") if "source_fault" in requests.columns else F.lit(None).cast("string")


def mention_outcomes(concepts: DataFrame, sources: DataFrame, mentions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, op create/delete, concept_id, source_ref_id; with source_fault as from
    ``graph_mutations.resolve_sources``) -> missing_concept, snapshot_drift / missing_source, then
    existing / created or missing_mention / deleted.

    Requests are served by ordinal: the last one for the same pair says whether it is there."""
    j = flagged(flagged(requests, "concept_id", concepts.select("id"), "c"), "source_ref_id", sources.select("source_ref_id"), "s").join(mentions.select("concept_id", "source_ref_id", F.lit(True).alias("m")).distinct(), ["concept_id", "source_ref_id"], "left")
    last = F.lag("op").over(Window.partitionBy("concept_id", "source_ref_id").orderBy("ordinal"))
    there = F.when(last.isNotNull(), last == "create").otherwise(F.coalesce("m", F.lit(False)))
    outcome = F.when(F.col("op") == "create", F.when(F.col("there"), "existing").otherwise("created")).otherwise(F.when(F.col("there"), "deleted").otherwise("missing_mention"))
    return j.withColumn("there", there).select("ordinal", F.when(F.col("c").isNull(), "missing_concept").when(_source_fault(requests).isNotNull(), _source_fault(requests)).when(F.col("s").isNull(), "missing_source").otherwise(outcome).alias("outcome"))


def _serve_evidence(batches):
    """Rows by assertion: what it holds first, then its requests by ordinal; the state is the set
    of at most ``EVIDENCE_PER_ASSERTION`` sources of the assertion at hand."""
    import pandas as pd

    now, held = None, set()
    for pdf in batches:
        out = []
        for assertion, ordinal, op, source in zip(pdf["assertion_id"].tolist(), pdf["ordinal"].tolist(), pdf["op"].tolist(), pdf["source_ref_id"].tolist(), strict=True):
            if assertion != now:
                now, held = assertion, set()
            if op == "held":
                held.add(source)
            elif op == "add":
                if source in held:
                    out.append((ordinal, "existing"))
                elif len(held) >= limits.EVIDENCE_PER_ASSERTION:
                    out.append((ordinal, "evidence_limit"))
                else:
                    held.add(source)
                    out.append((ordinal, "created"))
            elif source not in held:
                out.append((ordinal, "missing_evidence"))
            elif len(held) == 1:
                out.append((ordinal, "would_orphan_evidence"))
            else:
                held.remove(source)
                out.append((ordinal, "deleted"))
        yield pd.DataFrame(out, columns=["ordinal", "outcome"])


def evidence_outcomes(assertions: DataFrame, sources: DataFrame, evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (ordinal, op add/remove, assertion_id, source_ref_id; with source_fault as from
    ``graph_mutations.resolve_sources``) -> missing_assertion, missing_source / snapshot_drift,
    then existing / evidence_limit / created or missing_evidence /
    would_orphan_evidence / deleted.

    The requests for an assertion are served one after the other by ordinal, each on what the
    one before has left: a sorted stream with a state of 32 sources at most."""
    j = flagged(flagged(requests, "assertion_id", assertions.select("id"), "a"), "source_ref_id", sources.select("source_ref_id"), "s")
    fault = F.when(F.col("a").isNull(), "missing_assertion").when(_source_fault(requests).isNotNull(), _source_fault(requests)).when(F.col("s").isNull(), "missing_source")
    j = j.select("assertion_id", "ordinal", "op", "source_ref_id", fault.alias("fault"))
    asked = j.filter("fault is null").select("assertion_id", F.col("ordinal").cast("long").alias("ordinal"), "op", F.col("source_ref_id").cast("long").alias("source_ref_id"))
    held = evidence.join(asked.select("assertion_id").distinct(), "assertion_id", "left_semi").select("assertion_id", F.lit(-1).cast("long").alias("ordinal"), F.lit("held").alias("op"), F.col("source_ref_id").cast("long").alias("source_ref_id")).distinct()
    rows = held.unionByName(asked).repartition("assertion_id").sortWithinPartitions("assertion_id", F.col("op") != "held", "ordinal")
    served = rows.mapInPandas(_serve_evidence, "ordinal long, outcome string")
    return served.unionByName(j.filter("fault is not null").select(F.col("ordinal").cast("long").alias("ordinal"), F.col("fault").alias("outcome")))


def find_paths_many(assertions: DataFrame, requests: DataFrame, direction: str = "either", max_depth: int = 4, max_work: int = limits.PATH_WORK, limit: int = limits.PATHS) -> DataFrame:
    """requests (request_id, start, end) -> request_id and the columns of ``find_paths``, for any
    number of requests at once; equal ends are ``invalid_input``, no path is no row.

    A level is a join of all open states with the edges, written to the shared folder.  What a
    state leads to is counted first and not made: the edges at its end, less those that lead back
    into its path.  A request that has used up its work generates no more, whatever the degree of
    the concept it stands at: at most ``max_work`` states a request are ever joined or written."""
    limits.bounded("max_depth", max_depth, 1, limits.PATH_DEPTH)
    limits.bounded("max_work", max_work, 1, limits.PATH_WORK)
    limits.bounded("limit", limit, 1, limits.PATHS)
    none = F.array().cast("array<string>")
    edges = written(directed(assertions, direction).select("src", "dst", "id", "orientation").dropna(subset=["src", "dst", "id"]), "edges")
    degree = written(edges.groupBy(F.col("src").alias("d_src")).agg(F.count(F.lit(1)).alias("degree")), "degrees")
    good = requests.filter("start != end")
    state = good.select("request_id", "end", F.col("start").alias("at"), F.array("start").alias("c"), none.alias("a"), none.alias("o"))
    work = good.select("request_id", F.lit(1).cast("long").alias("work"))
    found = None
    for _ in range(max_depth):
        leads = state.join(degree, F.col("at") == F.col("d_src")).select("request_id", "degree")
        # back into the path: by its concepts, or by an assertion that it has used
        back = state.select("request_id", "at", "c", F.explode("c").alias("seen")).join(edges, (F.col("at") == F.col("src")) & (F.col("seen") == F.col("dst"))).select("request_id", F.lit(-1).cast("long").alias("degree"))
        again = state.select("request_id", "at", "c", F.explode(F.array_distinct("a")).alias("used")).join(edges, (F.col("at") == F.col("src")) & (F.col("used") == F.col("id"))).filter(~F.array_contains("c", F.col("dst"))).select("request_id", F.lit(-1).cast("long").alias("degree"))
        made = leads.unionByName(back).unionByName(again).groupBy(F.col("request_id").alias("m_request")).agg(F.sum("degree").alias("made"))
        work = written(work.join(made, F.col("request_id") == F.col("m_request"), "left").select("request_id", (F.col("work") + F.coalesce("made", F.lit(0))).alias("work")), "work")
        within = state.join(work.filter(F.col("work") <= max_work).select("request_id"), "request_id", "left_semi")
        step = within.join(edges, F.col("at") == F.col("src")).filter(~F.array_contains("c", F.col("dst")) & ~F.array_contains("a", F.col("id")))
        level = written(step.select("request_id", "end", F.col("dst").alias("at"), F.array_append("c", F.col("dst")).alias("c"), F.array_append("a", F.col("id")).alias("a"), F.array_append("o", F.col("orientation")).alias("o")), "level")
        hits = level.filter(F.col("at") == F.col("end"))
        found = hits if found is None else found.unionByName(hits)
        state = level.filter(F.col("at") != F.col("end"))
        if state.isEmpty():
            break
    order = Window.partitionBy("request_id").orderBy(F.size("a"), "a", "c")
    best = found.join(work.filter(F.col("work") <= max_work), "request_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    joined = lambda c: F.array_join(c, ">").alias({"c": "concept_ids", "a": "assertion_ids", "o": "orientations"}[c])
    best = best.select("request_id", "rank", F.size("a").alias("hops"), joined("c"), joined("a"), joined("o"), "work", F.lit("found").alias("outcome"))
    empty = [F.lit(0).alias("rank"), F.lit(0).alias("hops"), *[F.lit("").alias(c) for c in ("concept_ids", "assertion_ids", "orientations")]]
    over = work.filter(F.col("work") > max_work).select("request_id", *empty, F.lit(max_work + 1).cast("long").alias("work"), F.lit("work_exhausted").alias("outcome"))
    bad = requests.filter("start = end or start is null or end is null").select("request_id", *empty, F.lit(0).cast("long").alias("work"), F.lit("invalid_input").alias("outcome"))
    return best.unionByName(over).unionByName(bad)
