"""The folder that driver and executors share, for tables that outlive a plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder stands in for it in single-process local mode only."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="loom-core-"))
    return _own[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_written: dict[str, SparkSession] = {}


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and reread: it is made once, and its lineage is cut.

    The table goes with ``gone``, or when the interpreter ends."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the row's number from 1 in ``order`` (nulls last), as a window over all rows gives it.

    Rows are cut into ranges of the order and numbered within theirs; the ranges' sizes, one row a
    range, say where each begins.  No task sees more than a range."""
    by = [F.col(c).asc_nulls_last() for c in order]
    ranges = written(df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    # one row a range, a few hundred at most
    begins = sizes.select(F.col("__range").alias("__at"), (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__begin"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    return ranges.withColumn("__within", within).join(F.broadcast(begins), F.col("__range") == F.col("__at")).select(*df.columns, (F.col("__begin") + F.col("__within")).alias(name))


def gone(*tables: DataFrame) -> None:
    """Delete written tables of which nothing is read any more."""
    for t in tables:
        if (path := t.__dict__.pop("_shared_path", None)) and (spark := _written.pop(path, None)):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_written() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the folder's owner cleans up
            return
