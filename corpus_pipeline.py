"""The corpus pipeline: five operators, one after the other, over ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  ``run`` writes a stage's result as
Parquet to the shared folder and rereads it as the next one's ``docs``; all stages but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, linededup, mixing, neardup, toxicity
from loomspark.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.

    Null and empty texts stay, of whatever length texts are scored whole, a score of exactly 0.5
    rejects, rows that repeat are judged alike, an empty table stays empty, other columns pass."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which nothing but white space stays goes
    too, if it lost lines.  ``n_chars`` follows the text."""
    out = linededup.dedup_lines(docs)
    out = out.filter((F.col("n_cut") == 0) | F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.when(F.col("n_cut") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.80 and more) stays: the one with
    the smallest doc_id.  Rows are told apart by doc_id and text; equal rows are copies too,
    and a row without doc_id belongs to no group."""
    gone = neardup.near_duplicates(docs, percent=80, bands=32, rows=4).filter("not kept").select(F.col("doc_id").alias("__gone_id"), F.col("mark").alias("__gone_mark")).distinct()
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    rest = marked.join(gone, (F.col("doc_id") == F.col("__gone_id")) & (F.col("__mark") == F.col("__gone_mark")), "left_anti")
    named = rest.filter("doc_id is not null").dropDuplicates(["doc_id", "__mark"])
    return named.unionByName(rest.filter("doc_id is null")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words, null ones included, are not taken; a null source is the last one; repeated
    rows are documents of their own; a very long text counts whole; empty tables stay empty."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every document of the mix.

    Null and empty texts have no ids; rows are kept as they are, repeated ones and those of very
    long texts included; other columns go; an empty table gives no rows."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_tokens),
]

#: Segment scans, MinHash and BPE cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
