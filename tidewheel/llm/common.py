"""Shared plumbing: tables cut from their lineage, row keys, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` names it.

    Where it is unset (tests on one machine), a temporary folder is set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewheel-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with a single run of the plan (``checkpoint()`` runs a map-only plan twice),
    stays column-prunable, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"tidewheel-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: int, per_block: int) -> int:
    """Number of blocks of about ``per_block`` rows."""
    return max(1, -(-int(rows) // per_block))


def fed(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if its scan has fewer than half as many parts as the cluster has cores (a small file in one piece)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that the optimizer computes once a row.

    A projection may be merged into the expressions that read it, and a lambda would then compute it for
    each element; it is not merged across a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def salted(n_blocks: int | Column, *cols: Column | str) -> Column:
    """A block number from 0, the same on every run for the same values."""
    n = n_blocks if isinstance(n_blocks, Column) else F.lit(n_blocks)
    return F.pmod(F.xxhash64(*cols), n).cast("int")


#: A key with more than this share of all rows is joined by broadcast; there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 2000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (``how``: inner or left), which has each key once and its number of rows as ``count``, of ``total``.

    Hot keys, with more than ``HOT_SHARE`` of the rows, are at most 1 / HOT_SHARE rows of ``keyed`` whatever the data, so they are broadcast
    and their rows stay where they are; the other keys are shuffled and none of them fills a task.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = keyed.where(F.col(count) > limit)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(count) <= limit), on, how)
    return near.unionByName(far)


def word_count(text: Column) -> Column:
    """Words of ``WORD``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a, b)``: rows ``node, component``.

    Alternates large-star and small-star steps, each a join and a distinct over the edge table, until
    the edge table repeats.  Rounds grow with the logarithm of a component's size; each round is
    written to the shared folder.  Nulls and loops are ignored; nodes without an edge are absent.
    """
    pairs = lambda d: d.where("a <> b").distinct()

    def star(now: DataFrame, large: bool) -> DataFrame:
        if large:
            near = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = near.join(least, "a")
        if large:
            return pairs(moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        return pairs(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))

    def mark(d: DataFrame) -> tuple:
        r = d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]

    now = materialize(pairs(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))), "edges")
    seen = mark(now)
    while seen[0]:
        now = materialize(star(star(now, large=True), large=False), "edges")
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))
