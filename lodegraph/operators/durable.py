"""Intermediates that are read twice, kept as Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Of local sessions, by their application: the temporary folder of each.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, or else setCheckpointDir. Neither set, as in tests, one temporary folder for a local session; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="lodegraph-")
        leaving(spark, _own[context.applicationId])
    return _own[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which goes when the driver ends."""
    return leaving(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def leaving(spark: SparkSession, path: str) -> str:
    """path, which is removed when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df, written and read again: computed once, whoever reads it, and not lost with an executor. `discard` removes it; what is left goes when the driver ends."""
    path = new_folder(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodegraph_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Remove what `kept` wrote for dfs, which nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_lodegraph_path", None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def cached(df: DataFrame, folder: str, name: str, build) -> DataFrame:
    """build(df), computed once for df's contents: kept below folder under name and a digest of the rows, in any order, and of the columns."""
    digest = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("x"), F.sum(F.xxhash64(F.lit(5), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("s")).first()
    spark = df.sparkSession
    path = f"{folder}/{name}-{sha256('|'.join([*df.columns, *map(str, digest)]).encode()).hexdigest()[:32]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with number, from 0 by order. By ranges of the order: each range's own rank and the sizes of those before it. Rows of equal order are numbered in any way."""
    ranged = kept(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for each partition
    return ranged.join(F.broadcast(before), "_p").withColumn("number", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("_b")).drop("_p", "_b")
