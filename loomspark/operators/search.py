"""Retrieval over heads: BM25, exact cosine, and their score-free merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import limits

def words(c):
    """Lower-case runs of a-z and 0-9."""
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


def search_document(title, content, concepts):
    return F.concat_ws(" ", title, content, F.array_join(concepts, " "))


def bm25(memories: DataFrame, query: str, limit: int, k1: float = 1.2, b: float = 0.75, english: bool = False) -> DataFrame:
    """rank, id, version, score of the best heads.

    Corpus numbers (count, average length, document frequencies) cover current heads only.
    Per version only its length and the query terms' frequencies leave the scan: the shuffle
    holds a few integers a version, and neither text nor vocabulary.  With ``english`` words are
    compared by their stems (see :func:`text_index.bm25_english`)."""
    limits.bounded("limit", limit, 1, limits.SEARCH_LIMIT)
    if english:
        from .text_index import bm25_english

        return bm25_english(memories, query, limit, k1, b)
    spark = memories.sparkSession
    terms = sorted(set(spark.range(1).select(words(F.lit(query)).alias("w")).first()["w"]))
    w = F.col("w")
    rows = memories.select("id", "version", words(search_document(F.col("title"), F.col("content"), F.col("concepts"))).alias("w"))
    rows = rows.select("id", "version", F.size(w).alias("dl"), *[(F.size(w) - F.size(F.array_remove(w, t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    if not terms:
        return rows.select(F.lit(0).alias("rank"), "id", "version", F.lit(0.0).alias("score")).limit(0)
    # the greatest version's numbers: buffers of fixed size, so that the text stays in the scan
    numbers = ["dl", *[f"tf{i}" for i in range(len(terms))]]
    docs = rows.groupBy("id").agg(F.max("version").alias("version"), *[F.max_by(c, "version").alias(c) for c in numbers])
    # every column is asked for, so that both uses share one exchange
    corpus = docs.agg(F.count("version").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    some = F.lit(False)
    for i in range(len(terms)):
        some = some | (F.col(f"tf{i}") > 0)
    # one row of corpus numbers
    out = docs.crossJoin(F.broadcast(corpus)).select("id", "version", F.when(some, score).alias("score")).filter("score > 0")
    return ranked(out, limit)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id"), F.col("version")]
    return scored.orderBy(*order).limit(limit).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "id", "version", "score")


def cosine(v, query: list[float]):
    """Cosine similarity of a vector column with a constant; null or nan for a norm of zero."""
    import math

    d = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    q = F.array(*[F.lit(float(x)) for x in query])
    return d(v, q) / (F.sqrt(d(v, v)) * F.lit(math.sqrt(sum(float(x) * float(x) for x in query))))


def vector(memories: DataFrame, embeddings: DataFrame, query: list[float], limit: int) -> DataFrame:
    """rank, id, version, score by exact cosine; heads without an embedding of their own, of
    another dimension or of norm zero are invisible, whatever older versions have.

    Vectors are scored in their scan; only (id, version, score) meets the heads."""
    limits.bounded("limit", limit, 1, limits.SEARCH_LIMIT)
    limits.bounded("dimensions", len(query), 1, limits.VECTOR_COMPONENTS)
    top = memories.groupBy("id").agg(F.max("version").alias("version"))
    e = embeddings.filter((F.size("embedding") == len(query)) & F.exists("embedding", lambda x: x != 0))
    scored = e.select("id", "version", cosine(F.col("embedding"), query).alias("score"))
    return ranked(scored.join(top, ["id", "version"]).filter("score is not null and not isnan(score)"), limit)


def merge(lexical: DataFrame, semantic: DataFrame | None, limit: int) -> DataFrame:
    """rank, id, version: union; the greatest version of an id wins, lexical on equal versions;
    ordered by id, then cut; no scores.  ``semantic`` None: no embedder, or it failed."""
    limits.bounded("limit", limit, 1, limits.SEARCH_LIMIT)
    both = lexical.select("id", "version", F.lit(0).alias("src"))
    if semantic is not None:
        both = both.unionByName(semantic.select("id", "version", F.lit(1).alias("src")))
    best = both.groupBy("id").agg(F.min(F.struct((-F.col("version")).alias("v"), "src")).alias("m"))
    out = best.select("id", (-F.col("m.v")).alias("version"), F.when(F.col("m.src") == 0, "lexical").otherwise("semantic").alias("origin")).orderBy("id").limit(limit)
    return out.select(F.row_number().over(Window.orderBy("id")).alias("rank"), "id", "version", "origin")


def search(memories: DataFrame, embeddings: DataFrame, query: str, limit: int, embedder=None, english: bool = True) -> DataFrame:
    """Hybrid search; an embedder that is unavailable leaves the lexical result.

    A query's vector has to be one vector of finite numbers, not all zero, in the dimension of
    the stored ones; anything else counts as unavailable."""
    import math

    semantic = None
    if embedder is not None:
        try:
            (q,) = embedder([query])
            q = [float(x) for x in q]
        except (ConnectionError, TimeoutError, TypeError, ValueError):
            q = []
        if q and all(map(math.isfinite, q)) and any(q):
            semantic = vector(memories, embeddings, q, limit)
    return merge(bm25(memories, query, limit, english=english), semantic, limit)
