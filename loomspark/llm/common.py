"""Shared helpers of the training-data operators.

Everything here is about *where* intermediate results live and how a text becomes
words.  No operator keeps state on a machine's own disk: what has to be computed once
and read twice is written as Parquet below ``spark.checkpoint.dir``, which the driver
and all executors share, so that a lost executor costs a reread and nothing else.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

_written: dict[str, SparkSession] = {}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in single-process local mode, where no such setting is needed, a temporary
    folder stands in for it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="loom-")
    return _own["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def _delete_written() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the folder's owner cleans up
            return


atexit.register(_delete_written)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it reread: cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables of which everything made from them is written by now.

    A table that a returned result still reads must stay; it goes when the interpreter ends.
    """
    for t in tables:
        path = t.__dict__.pop("_loom_path", None)
        if path and (spark := _written.pop(path, None)):
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it was counted and has at most ``most_rows`` rows.

    ``df`` must be cheap to count (materialised).  A larger one comes back as it is, so
    that the join shuffles.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def word_count(text):
    """Number of ASCII-white-space separated words, 0 for null and empty texts."""
    # one separator, the last white space before it, per word: linear in any text
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    return (F.size(F.split(padded, r"[\x20\x09-\x0D](?=[^\x20\x09-\x0D])")) - 1).cast("long")

