"""A kept inverted index of heads, and BM25 over it.

The index is a log of signed postings (term, id, version, tf, dl, sign), partitioned by a hash of
the term and sorted by term, beside a log of corpus numbers, one row a batch.  A batch of new
versions moves heads: the postings of the heads it replaces leave (sign -1), those of the new
heads enter.  A query reads the partitions of its terms and the corpus numbers, no text.

A batch counts once its corpus row is written, which is last; what a failed one has left in the
postings is not read.  Versions may come in any order: a head never moves back.  Equal (id,
version) rows are one.  ``compact`` writes the sum of all batches as the first batch of a new index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import limits
from ..functions.stemmer import STOP_WORDS, with_stems
from ..sources.shared import gone, written
from . import search

#: Partitions of the postings; part of an index, as its terms' places depend on it.
BUCKETS = 64
#: Terms of a query table up to which they are pushed down as values.
TERMS_PUSHED = 100
_POSTINGS = "term string, id string, version long, tf long, dl long, sign int, batch long, bucket int"
_CORPUS = "batch long, n long, length long"


def words(c):
    """Lower-case runs of letters and digits, stop words left out."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.isin(STOP_WORDS))


def word_counts(memories: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, version, ``keep``, dl, word, tf of every row (``word`` null for rows without words)."""
    w = words(search.search_document(F.col("title"), F.col("content"), F.col("concepts")))
    rows = memories.select("id", "version", *keep, w.alias("w")).select("id", "version", *keep, F.size("w").cast("long").alias("dl"), F.explode_outer("w").alias("word"))
    return rows.groupBy("id", "version", *keep, "dl", "word").agg(F.count(F.lit(1)).alias("tf"))


def stemmed(counted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, version, ``keep``, term, tf, dl of counted words (made already: they are read twice).

    Words are counted by row before they are stemmed, and stemmed once each."""
    vocabulary = with_stems(counted.select("word").filter("word is not null").distinct()).withColumnRenamed("word", "v_word")
    out = counted.join(vocabulary, F.col("word") == F.col("v_word"), "left")
    return out.groupBy("id", "version", *keep, "dl", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def moved_heads(before: DataFrame, new: DataFrame) -> DataFrame:
    """The rows whose being a head changes by the batch ``new``: sign 1 enters, -1 leaves."""
    key = Window.partitionBy("id", "version").orderBy("id")
    top = new.groupBy(F.col("id").alias("n_id")).agg(F.max("version").alias("n_version"))
    old = before.join(top, F.col("id") == F.col("n_id"), "left_semi")
    held = old.groupBy(F.col("id").alias("o_id")).agg(F.max("version").alias("o_version"))
    moves = top.join(held, F.col("n_id") == F.col("o_id"), "left").filter("o_version is null or n_version > o_version").select("n_id", "n_version", "o_version")
    columns = ["id", "version", "title", "content", "concepts"]
    enter = new.join(moves, (F.col("id") == F.col("n_id")) & (F.col("version") == F.col("n_version"))).select(*columns, F.lit(1).alias("sign"))
    leave = old.join(moves, (F.col("id") == F.col("n_id")) & (F.col("version") == F.col("o_version"))).select(*columns, F.lit(-1).alias("sign"))
    return enter.unionByName(leave).withColumn("n", F.row_number().over(Window.partitionBy("id", "version", "sign").orderBy("title", "content"))).filter("n = 1").drop("n")


@dataclass(frozen=True)
class TextIndex:
    path: str
    buckets: int = BUCKETS

    def corpus(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_CORPUS).parquet(f"{self.path}/corpus")

    def postings(self, spark: SparkSession) -> DataFrame:
        """Signed postings of the batches that count."""
        rows = spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")
        done = self.corpus(spark).select(F.col("batch").alias("done"))
        return rows.join(done, F.col("batch") == F.col("done"), "left_semi")

    def _write(self, entries: DataFrame, heads: DataFrame, batch: int) -> None:
        """``heads`` has rows of every head with its sign and dl: any of them stands for it."""
        spark = entries.sparkSession
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        rows = entries.select("term", "id", "version", "tf", "dl", F.col("sign").cast("int").alias("sign"), F.lit(batch).cast("long").alias("batch"), bucket.alias("bucket"))
        rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term", "id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        heads = heads.groupBy("id", "version", "sign").agg(F.max("dl").alias("dl"))
        numbers = heads.agg(F.coalesce(F.sum(F.col("sign").cast("long")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("length"))
        numbers.select(F.lit(batch).cast("long").alias("batch"), F.col("n").cast("long").alias("n"), F.col("length").cast("long").alias("length")).coalesce(1).write.mode("append").parquet(f"{self.path}/corpus")

    def add(self, before: DataFrame, new: DataFrame, batch: int) -> None:
        """Add the versions ``new`` to an index of the versions ``before``.  ``batch`` is a number
        not used before; a batch that is repeated after a failure takes a new one."""
        # the words of moved heads, counted once; a row without words has a null one
        counted = written(word_counts(moved_heads(before, new), ("sign",)), "counted")
        self._write(stemmed(counted, ("sign",)), counted, batch)
        gone(counted)

    def compact(self, spark: SparkSession, path: str) -> TextIndex:
        """The same index as one batch below ``path``."""
        out = TextIndex(path, self.buckets)
        key = ["term", "id", "version", "dl"]
        kept = self.postings(spark).groupBy(*key).agg(F.sum(F.col("tf") * F.col("sign")).alias("tf"), F.sum(F.col("sign").cast("long")).alias("sign")).filter("sign > 0")
        out._write(kept, kept, 0)
        return out

    def bm25(self, queries: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, rank, id, version, score: the best heads of each row of ``queries`` (query_id,
        query), equal scores by id."""
        limits.bounded("limit", limit, 1, limits.SEARCH_LIMIT)
        spark = queries.sparkSession
        asked = with_stems(queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("word"))).select("query_id", F.col("stem").alias("q_term")).distinct()
        asked = written(asked.withColumn("q_bucket", F.pmod(F.xxhash64("q_term"), F.lit(self.buckets)).cast("int")), "asked")
        # the partitions to read: at most ``buckets`` numbers; few terms also reach the scan themselves
        places = [r[0] for r in asked.select("q_bucket").distinct().collect()]
        few = [r[0] for r in asked.select("q_term").distinct().limit(TERMS_PUSHED + 1).collect()]
        rows = self.postings(spark).filter(F.col("bucket").isin(places))
        if len(few) <= TERMS_PUSHED:
            rows = rows.filter(F.col("term").isin(few))
        rows = rows.join(asked.select("q_term").distinct(), F.col("term") == F.col("q_term"), "left_semi")
        live = rows.groupBy("term", "id", "version", "dl").agg(F.sum(F.col("tf") * F.col("sign")).alias("tf")).filter("tf > 0")
        frequency = live.groupBy(F.col("term").alias("f_term")).agg(F.count(F.lit(1)).alias("df"))
        corpus = self.corpus(spark).agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl"))
        # one row of corpus numbers
        idf = frequency.crossJoin(F.broadcast(corpus)).select("f_term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        scored = live.join(idf, F.col("term") == F.col("f_term")).join(asked, F.col("term") == F.col("q_term"))
        scored = scored.groupBy("query_id", "id", "version").agg(_total(part).alias("score")).filter("score > 0")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id", "version")
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select("query_id", "rank", "id", "version", "score")


def _total(part):
    """The sum of a row's parts, whatever the order they come in: equal rows have equal scores."""
    return F.sum(part.cast("decimal(28,18)")).cast("double")


def bm25_english(memories: DataFrame, query: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """rank, id, version, score of the best heads by English terms, without an index.

    Two scans of the texts: one finds the corpus' words that share a stem with the query, the
    other keeps those words and each version's length; no text is shuffled."""
    limits.bounded("limit", limit, 1, limits.SEARCH_LIMIT)
    spark = memories.sparkSession
    said = memories.select("id", "version", words(search.search_document(F.col("title"), F.col("content"), F.col("concepts"))).alias("w"))
    asked = with_stems(spark.range(1).select(F.explode(words(F.lit(query))).alias("word"))).select(F.col("stem").alias("q_stem")).distinct()
    wanted = written(with_stems(said.select(F.explode("w").alias("word")).distinct()).join(asked, F.col("stem") == F.col("q_stem")).select(F.col("word").alias("k_word"), F.col("stem").alias("term")), "wanted")
    # one row: the corpus' words of the query's stems
    sought = wanted.agg(F.collect_set("k_word").alias("sought"))
    told = said.crossJoin(F.broadcast(sought)).select("id", "version", F.struct(F.size("w").alias("dl"), F.filter("w", lambda x: F.array_contains("sought", x)).alias("own")).alias("x"))
    lengths = written(told.groupBy("id").agg(F.max("version").alias("version"), F.max_by("x", "version").alias("x")).select("id", "version", "x.dl", "x.own"), "lengths")
    hits = lengths.select("id", "version", "dl", F.explode("own").alias("word")).join(wanted, F.col("word") == F.col("k_word"))
    live = hits.groupBy("id", "version", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = live.groupBy(F.col("term").alias("f_term")).agg(F.count(F.lit(1)).alias("df"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    idf = frequency.crossJoin(F.broadcast(corpus)).select("f_term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row of corpus numbers
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = live.join(idf, F.col("term") == F.col("f_term")).groupBy("id", "version").agg(_total(part).alias("score")).filter("score > 0")
    return search.ranked(scored, limit)
