"""Aggregations over interactions: popularity, user and item features, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import DAY_MS
from .shared import numbered


def popularity(train: DataFrame) -> DataFrame:
    """Items by number of events, ties to smaller ids: ``item_id, cnt, hot_rank``.

    The table has one row an item and is ranked range by range.
    """
    cnt = train.groupBy("item_id").agg(F.count("*").alias("cnt"))
    return numbered(cnt, "hot_rank", F.col("cnt").desc(), F.col("item_id"))


def top_items(train: DataFrame, k: int) -> DataFrame:
    """The ``k`` most popular items, without a sort of all."""
    return train.groupBy("item_id").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), "item_id").limit(k)


def item_stats(train: DataFrame) -> DataFrame:
    """Events, first time and mean rating (of 5) of every item of the training rows."""
    return train.groupBy("item_id").agg(F.count("*").alias("train_cnt"), F.min("ts").alias("train_first_ts"), F.round(F.avg("rating") / 5, 6).alias("train_mean_rating"))


def user_stats(df: DataFrame) -> DataFrame:
    """Events, items, span in days, mean rating and both its deviations of every user."""
    return df.groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_distinct("item_id").alias("items"), ((F.max("ts") - F.min("ts")) / DAY_MS).alias("span_days"),
        F.round(F.avg("rating"), 6).alias("mean_rating"), F.round(F.coalesce(F.stddev_samp("rating"), F.lit(0.0)), 6).alias("std_sample"), F.round(F.stddev_pop("rating"), 6).alias("std_population"),
    )


def ordered_items(df: DataFrame) -> DataFrame:
    """Items of every user in order."""
    return df.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "item_id"))), lambda x: x["item_id"]).alias("items"))


def item_sets(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def last_item(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.max_by("item_id", F.struct("ts", "item_id")).alias("item_id"))


def category_shares(df: DataFrame, top: int | None = None) -> DataFrame:
    """Share of every category in a user's events, ranked; the first ``top``."""
    cnt = df.groupBy("user_id", "category").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("user_id")
    out = cnt.withColumn("share", F.col("cnt") / F.sum("cnt").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("cnt").desc(), "category")))
    return out.where(F.col("rank") <= top) if top else out


def category_entropy(df: DataFrame) -> DataFrame:
    """Entropy of a user's categories, over the logarithm of their number."""
    s = category_shares(df)
    e = s.groupBy("user_id").agg(F.count("*").alias("n"), (-F.sum(F.col("share") * F.ln(F.col("share") + 1e-8))).alias("h"))
    return e.select("user_id", F.round(F.col("h") / (F.when(F.col("n") > 1, F.ln("n")).otherwise(1.0) + 1e-8), 6).alias("entropy"))


def activity_bucket(df: DataFrame) -> DataFrame:
    """0 below half the median number of events, 1 up to one and a half of it, 2 above."""
    cnt = df.groupBy("user_id").agg(F.count("*").alias("events"))
    mid = cnt.agg(F.percentile("events", F.lit(0.5)).alias("median"))
    return cnt.crossJoin(F.broadcast(mid)).select("user_id", "events", F.when(F.col("events") < F.col("median") * 0.5, 0).when(F.col("events") <= F.col("median") * 1.5, 1).otherwise(2).alias("bucket"))


def quantiles(df: DataFrame, col: str, at: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)) -> DataFrame:
    """Interpolated quantiles of a column: ``q, value``."""
    return df.agg(F.percentile(col, F.array(*[F.lit(x) for x in at])).alias("v")).select(F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in at]).alias("q"), F.col("v").alias("value"))).alias("z")).select("z.q", F.round("z.value", 6).alias("value"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Values of a column with their counts and percentages."""
    cnt = df.groupBy(col).agg(F.count("*").alias("cnt"))
    return cnt.withColumn("pct", F.round(100 * F.col("cnt") / F.sum("cnt").over(Window.partitionBy(F.lit(1))), 6))


def summary(df: DataFrame) -> DataFrame:
    """One row on the data set."""
    return df.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("rating"), 6).alias("mean_rating"))


def min_max(df: DataFrame, col: str) -> DataFrame:
    """``col`` scaled to 0..1 over the table."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(f"{col}_scaled", (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)).drop("_lo", "_hi")


def log_scaled(df: DataFrame, col: str) -> DataFrame:
    """ln(1 + x) over its maximum in the table."""
    top = df.agg(F.max(col).alias("_hi"))
    return df.crossJoin(F.broadcast(top)).withColumn(f"{col}_log", F.log1p(col) / F.log1p("_hi")).drop("_hi")


def every_id(dim: DataFrame, features: DataFrame, key: str, fill: float = 0) -> DataFrame:
    """A row for every id of ``dim``; features it lacks are ``fill``."""
    return dim.join(features, key, "left").na.fill(fill)


def mean_vector(links: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean of the vectors linked to every key: ``key, vec_id`` and ``vec_id, embedding``."""
    each = links.join(vectors, "vec_id").select("key", F.posexplode("embedding").alias("dim", "x"))
    mean = each.groupBy("key", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: F.round(s["x"], 6)).alias("embedding"))


def exposure(samples: DataFrame, steps: int, order: Sequence[Column | str]) -> DataFrame:
    """How often every user is seen within the first ``steps`` samples of an order."""
    return samples.orderBy(*order).limit(steps).groupBy("user_id").agg(F.count("*").alias("seen"))


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, both ways: empty if statistics were kept as recomputed."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
