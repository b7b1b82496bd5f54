"""Tables written once to the folder that driver and executors share, and numbering of all rows of a table."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset on one machine, a temporary one is set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewheel-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return os.path.join(shared_dir(spark), f"tidewheel-{name}-{uuid.uuid4().hex}")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """What stands at ``path`` goes when the session's file system closes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once however many parts of a plan read it, and no lineage to recompute. The table goes when the session's file system closes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Events of a log, before any filter, that a part of what is dealt out or placed by user gets on average at most.
PART_EVENTS = 200_000


def enough_parts(spark: SparkSession, rows: int, each: int = PART_EVENTS) -> int:
    """As many parts as the session shuffles into, and more where a part would get over ``each`` of ``rows``: what a task holds mustn't grow with the table, or it spills."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def placed(df: DataFrame, name: str, key: str, parts: int | None = None) -> DataFrame:
    """As :func:`stored`, in ``parts`` buckets by ``key``, the parts of :func:`dealt`: what follows by ``key`` reads rows where they are and moves nothing. ``df`` is best dealt out so."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = os.path.basename(path).replace("-", "_")
    df.write.format("parquet").bucketBy(parts or enough_parts(spark, 0), key).option("path", path).saveAsTable(table)
    delete_on_exit(spark, path)
    return spark.table(table)


def nine(score: str) -> Column:
    """A score to nine digits, as a whole number: what orders compare. (``round`` of doubles goes by way of decimals and costs more than the sort.)"""
    return F.floor(F.col(score) * 1e9 + 0.5)


def signed_round(x: Column, digits: int) -> Column:
    """``round`` that keeps the sign of what becomes zero (-0.0), as other engines do; in an array the two zeros aren't alike."""
    return F.round(F.abs(x), digits) * F.signum(x)


def lot(seed: int, *cols: Column | str) -> Column:
    """A whole number from 0 below 2**60: the first digits of the md5 of the seed and the columns' texts with colons between, which every engine has alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 15), 16, 10).cast("bigint")


def dealt(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """``df`` hashed by ``keys`` into ``parts``, of themselves as many as the session shuffles into (see :func:`enough_parts`). For rows that are laid out to many more where they land: adaptive execution would judge the parts by what is sent and merge them."""
    return df.repartition(parts or enough_parts(df.sparkSession, 0), *keys)


#: Rows that are numbered in one task at most.
ONE_TASK = 1_000_000


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``, its rows' numbers from 1 in ``order``, which must be total.

    The rows are stored and counted; up to ``ONE_TASK`` are numbered in one window. More are ranged over partitions by the order and stored with their part's number; each part is numbered by itself and
    begins after the rows of the parts before, whose counts (one row a part) are broadcast. No task sees more than its range.
    """
    df = stored(df, "rows")
    if df.count() <= ONE_TASK:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.withColumn("_before", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).drop("_rows")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (at + F.col("_before")).cast("int")).drop("_part", "_before")
