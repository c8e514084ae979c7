"""Operator 10: mix sources to target weights by Sainte-Lague apportionment.

The mix is built from blocks of ``block_words`` words.  The corpus' words make up
``total / block_words`` blocks; highest quotients target / (2k + 1) decide how many of them
each source gets, then how many of a source's blocks each of its shards gets.  Inside a
shard the documents stand in an order given by a seeded hash; the shard's quota is taken
from the front of that order, whole passes first, so a document is taken ``floor`` or
``ceil`` times and only the one on the border in part.

Neither step lists all quotients: Sainte-Lague's result is near round(votes / divisor),
so seats start there and only the difference, at most one seat per two parties, is settled
by comparing the next (or last) quotients themselves.

Scale: the text is read once for its word count.  Per-source and per-shard tables are
partial aggregates.  A shard holds at most about ``shard_words`` words and one document
more, whatever the source's size, so a hot source is spread over as many windows as it
needs.

Defined results: null text has size 0 and taken 0; a null source is a source of its own,
last; an empty table gives no rows; repeated rows are documents of their own; a very long text is
one document of its size, of which a mix may take a part; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small, table, word_count

BLOCK_WORDS = 32
SHARD_WORDS = 200_000
SEED = 20240117
CAP = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size) -> + weight, target.

    Weights repeat over the sources by code point, null last.  Targets share the total by
    weight; none exceeds ``cap`` times its source and the excess goes to the others by
    weight.  That is water filling: sources capped at the final level are a prefix in the
    order of cap / weight, found with two running sums instead of repeated passes.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("weight", w).withColumn("limit", (F.lit(cap) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "rest": F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "rest_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # the level if this source and all after it are uncapped; the first that holds is final
    df = df.withColumn("level", F.col("rest") / F.col("rest_weight"))
    df = df.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(every)["level"])
    return df.select("source", "source_size", "weight", F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("final") * F.col("weight"))).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds ``won``: seats of each party among the ``seats`` of its group, by highest quotients.

    Exact: starting from round(votes * seats / all votes), the sum misses the total by at
    most half a seat per party, so each party offers that many of its next quotients (or
    of its last ones, to give back) and the best of them settle the difference.  Ties go
    to the smaller party key.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.col(votes) * F.col(seats) / F.sum(votes).over(g)
    df = parties.withColumn("__base", F.when(F.col(votes) > 0, F.floor(share + 0.5)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("__off", F.when(F.sum(votes).over(g) > 0, F.col(seats) - F.sum("__base").over(g)).otherwise(F.lit(0)).cast("long"))
    step = F.explode(F.when((F.col("__off") == 0) | (F.col(votes) <= 0), F.array().cast("array<long>")).otherwise(
        F.when(F.col("__off") > 0, F.sequence(F.lit(0).cast("long"), F.col("__off") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.least(-F.col("__off"), F.col("__base")) - 1))))
    offers = df.filter(F.when(F.col("__off") < 0, F.col("__base") > 0).otherwise(F.col("__off") > 0)).select(*group, party, votes, "__base", "__off", step.alias("__k"))
    quotient = F.when(F.col("__off") > 0, -F.col(votes) / (2 * (F.col("__base") + F.col("__k")) + 1)).otherwise(F.col(votes) / (2 * (F.col("__base") - F.col("__k")) - 1))
    best = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(quotient, F.col(party).asc_nulls_last())
    moved = offers.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= F.abs("__off"))
    moved = moved.groupBy(*group, party).agg(F.sum(F.signum("__off")).cast("long").alias("__move"))
    on = None
    renamed = moved.select(*[F.col(c).alias(f"__m_{c}") for c in [*group, party]], "__move")
    for c in [*group, party]:
        same = F.col(c).eqNullSafe(F.col(f"__m_{c}"))
        on = same if on is None else on & same
    out = df.join(renamed, on, "left")
    return out.withColumn("won", F.col("__base") + F.coalesce("__move", F.lit(0))).drop("__base", "__off", "__move", *[f"__m_{c}" for c in [*group, party]])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``."""
    sized = materialise(docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size")), "mix-size")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sources, weights)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("__all", F.round(F.sum("target").over(every) / block_words).cast("long"))
    sources = sainte_lague(sources, [], "source", "target", "__all").withColumnRenamed("won", "blocks")
    sources = sources.withColumn("shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / F.lit(shard_words)).cast("long"))
    sources = materialise(sources.select(F.col("source").alias("s_source"), "source_size", "target", "blocks", "shards"), "mix-source")
    mark = F.xxhash64(F.col("doc_id"), F.lit(seed))
    placed = sized.join(small(sources, 100_000), F.col("source").eqNullSafe(F.col("s_source")))
    placed = placed.withColumn("shard", F.pmod(mark, F.col("shards")))
    shards = placed.groupBy("s_source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    shards = sainte_lague(shards, ["s_source"], "shard", "shard_size", "blocks")
    shards = shards.select(F.col("s_source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size", F.least(F.col("won") * block_words, F.col("shard_size") * CAP).alias("quota"))
    shards = materialise(shards, "mix-shard")
    placed = placed.join(small(shards, 100_000), F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    stream = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.col("doc_id"), F.col("size")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(stream), F.lit(0))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("quota") - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    taken = (passes * F.col("size") + part).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as the mix takes it.

    A document counts as often as its taken words fill it, to the nearest whole number
    (the one on a shard's border is the only one not taken a whole number of times).
    Rows that are told apart by nothing but their position keep their number of copies.
    """
    taken = mix(docs, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    # rows that agree in doc_id, source and size are interchangeable: number them on both sides
    per = taken.groupBy("doc_id", "source", "size").agg(F.sum(times).alias("__m_times"), F.count(F.lit(1)).alias("__m_rows"))
    per = per.filter(F.col("__m_times") > 0).select(F.col("doc_id").alias("__m_doc"), F.col("source").alias("__m_source"), F.col("size").alias("__m_size"), "__m_times", "__m_rows")
    names = docs.columns
    left = docs.withColumn("__size", word_count(F.col("text")))
    joined = left.join(per, F.col("doc_id").eqNullSafe(F.col("__m_doc")) & F.col("source").eqNullSafe(F.col("__m_source")) & (F.col("__size") == F.col("__m_size")))
    # with repeated rows the copies are shared out evenly, rounded up
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__m_times") / F.col("__m_rows")).cast("int")))).select(*names)


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
