"""Projection, filtering, deduplication and id encoding of interaction logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lot, numbered, stored


def positives(df: DataFrame, least: float = 4) -> DataFrame:
    """Ratings of ``least`` and more."""
    return df.where(F.col("rating") >= least)


def label_weight(df: DataFrame) -> DataFrame:
    """Labels by exact rating: 5 is (1, 1.0), 4 is (1, 0.5), 1 and 2 are (0, 0.8); other ratings go."""
    r = F.col("rating")
    label = F.when(r.isin(4, 5), 1).when(r.isin(1, 2), 0)
    weight = F.when(r == 5, 1.0).when(r == 4, 0.5).when(r.isin(1, 2), 0.8)
    return df.withColumns({"label": label.cast("int"), "weight": weight}).where("label is not null")


def label_by_bin(df: DataFrame) -> DataFrame:
    """Labels by the whole-number bin a rating falls in (4.5 is in bin 4); bin 3 goes."""
    b = F.greatest(F.lit(1), F.least(F.lit(5), F.floor("rating"))).cast("int")
    return df.withColumn("rating_bin", b).where("rating_bin <> 3").withColumns({"label": (F.col("rating_bin") >= 4).cast("int"), "weight": F.element_at(F.array(*[F.lit(x) for x in (0.8, 0.8, 0.0, 0.5, 1.0)]), F.col("rating_bin"))})


def as_clicks(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"item_id": "click_article_id", "ts": "click_timestamp"})


def first_interactions(df: DataFrame) -> DataFrame:
    """First row of every (user, item) in the order of ts, then rating."""
    rest = [c for c in df.columns if c not in ("user_id", "item_id")]
    first = df.groupBy("user_id", "item_id").agg(F.min(F.struct("ts", "rating", *[c for c in rest if c not in ("ts", "rating")])).alias("x"))
    return first.select("user_id", "item_id", *[F.col(f"x.{c}").alias(c) for c in rest])


def exact_rows(df: DataFrame, keys: Sequence[str] = ("user_id", "item_id", "ts")) -> DataFrame:
    """One row of every key: the least in the order of the remaining columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, "x.*")


def first_by_rank(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """First ``value`` of every key in ``order`` (the first category that lists an item wins)."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def min_degree(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys with ``least`` rows or more."""
    return df.join(df.groupBy(key).count().where(F.col("count") >= least).select(key), key, "left_semi")


def k_core(df: DataFrame, least_user: int = 5, least_item: int = 5, rounds: int | None = None) -> DataFrame:
    """Alternate minimum degrees of users and items until nothing goes (or for ``rounds``).

    Each round is stored in the shared folder, so the lineage stays short and executors may be lost.
    """
    n, done = df.count(), 0
    while rounds is None or done < rounds:
        df = min_degree(min_degree(df, "user_id", least_user), "item_id", least_item)
        if rounds is None:
            df = stored(df, "core")
            m = df.count()
            if m == n:
                return df
            n = m
        done += 1
    return df


def complete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows without a null (in ``cols``)."""
    return df.na.drop(subset=cols)


def dense_ids(df: DataFrame, col: str, first: int = 2) -> DataFrame:
    """Dense ids of the distinct values in order, from ``first`` (0 pads, 1 is unknown): ``raw, idx``.

    The sort runs over the distinct values only: they are ranged over partitions and numbered with each partition's offset.
    """
    values = df.select(F.col(col).cast("string").alias("raw")).where("raw is not null").distinct()
    if values.where("raw in ('[PAD]', '[UNK]')").limit(1).count():
        raise ValueError("reserved ids occur in the data")
    return numbered(values, "idx", F.col("raw")).withColumn("idx", F.col("idx") + F.lit(first - 1))


def encode(df: DataFrame, ids: DataFrame, col: str, unknown: int = 1) -> DataFrame:
    """``col`` looked up in ``ids(raw, idx)``; what isn't there is ``unknown``."""
    return df.join(ids.withColumnsRenamed({"raw": col}).withColumn(col, F.col(col).cast(df.schema[col].dataType)), col, "left").withColumn("idx", F.coalesce("idx", F.lit(unknown)))


def still_covers(ids: DataFrame, df: DataFrame, col: str, slack: float = 2.0) -> bool:
    """Whether a kept encoder knows all values of ``col`` and isn't more than ``slack`` times too large."""
    now = df.select(F.col(col).cast("string").alias("raw")).distinct()
    return now.join(ids, "raw", "left_anti").isEmpty() and ids.count() <= slack * now.count()


def kept_ids(old: DataFrame | None, df: DataFrame, col: str, slack: float = 2.0, first: int = 2) -> tuple[DataFrame, str]:
    """The encoder for ``df``, from the one of an earlier load (``raw, idx``; None at the first), and what was done: rebuilt, kept or grown.

    An encoder of more than ``slack`` times the values of now is built anew. Else every old id stays, and values that it lacks are numbered behind the largest one, in their own order;
    only they are sorted. Nulls have no id.
    """
    now = df.select(F.col(col).cast("string").alias("raw")).where("raw is not null").distinct()
    sizes = None if old is None else (old.count(), now.count())
    if old is None or sizes[0] > slack * sizes[1]:
        return dense_ids(df, col, first), "rebuilt"
    new = now.join(old, "raw", "left_anti")
    if new.isEmpty():
        return old, "kept"
    last = old.agg(F.coalesce(F.max("idx"), F.lit(first - 1))).first()[0]
    return old.select("raw", "idx").unionByName(dense_ids(new, "raw", last + 1).select("raw", "idx")), "grown"


def sample_users(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Rows of ``n`` users, picked by hash."""
    some = df.select("user_id").distinct().orderBy(lot(seed, "user_id"), "user_id").limit(n)
    return df.join(some, "user_id", "left_semi")


def in_range(ids: Column, size: int) -> Column:
    """Ids of an array that a model of ``size`` rows knows."""
    return F.filter(ids, lambda x: (x >= 0) & (x < size))


def must_be_empty(df: DataFrame, what: str) -> DataFrame:
    """Raise if any row is left."""
    if not df.isEmpty():
        raise ValueError(what)
    return df
