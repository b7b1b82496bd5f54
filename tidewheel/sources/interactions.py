"""Scans: interaction logs from CSV, JSON lines and the driver's star schema; sinks for predictions."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quarantine import checked_lines, usable

RATINGS = "user_id STRING, item_id STRING, rating DOUBLE, ts BIGINT"
REVIEWS = {"user_id": "STRING", "parent_asin": "STRING", "asin": "STRING", "rating": "FLOAT", "timestamp": "BIGINT", "helpful_vote": "INT", "verified_purchase": "BOOLEAN"}
META = {"parent_asin": "STRING", "store": "STRING", "details": "MAP<STRING,STRING>", "main_category": "STRING", "average_rating": "DOUBLE", "rating_number": "INT", "price": "STRING"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(col: str):
    """Milliseconds since 1970 of a timestamp without time zone, microseconds rounded half away from 1970 as the SQL's ``epoch_ms`` does."""
    micros = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})"
    return F.expr(f"cast(sign({micros}) as bigint) * ((abs({micros}) div 500 + 1) div 2)")


def star_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of the star schema: customers rate parts, ``user_id, item_id, rating, ts, category, brand``."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), F.least(F.lit(5), 1 + F.floor(F.col("l_quantity") / 10)).cast("int").alias("rating"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), epoch_ms("cast(o_orderdate as timestamp_ntz)").alias("ts"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    return lines.join(orders, "l_orderkey").join(parts, "item_id").select("user_id", "item_id", "rating", "ts", "category", "brand")


def read_ratings_csv(spark: SparkSession, files: dict[str, str], per_file: int | None = None, header: bool = True) -> DataFrame:
    """One CSV per category, the category added as a column; ``per_file`` limits each (an offline sample)."""
    parts = []
    for category, path in files.items():
        part = spark.read.schema(RATINGS).option("header", header).csv(path)
        parts.append((part.limit(per_file) if per_file else part).withColumn("category", F.lit(category)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checked_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Raw reviews line by line, with what is wrong with each (see ``quarantine``)."""
    return checked_lines(spark, path, REVIEWS, ["user_id", "parent_asin", "rating", "timestamp"])


def read_reviews_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw reviews; malformed lines and lines without the required keys are skipped."""
    rows = usable(checked_reviews(spark, path))
    return rows.withColumns({"asin": F.coalesce("asin", "parent_asin"), "helpful_vote": F.coalesce("helpful_vote", F.lit(0)), "verified_purchase": F.coalesce("verified_purchase", F.lit(False)).cast("tinyint")})


def checked_meta(spark: SparkSession, path: str) -> DataFrame:
    """Item metadata line by line, with what is wrong with each."""
    return checked_lines(spark, path, META, ["parent_asin"])


def read_meta_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Item metadata with brand (the store's name, else the details'), price, skin type and item form taken out of the nested details; lines that can't be used are skipped."""
    rows = usable(checked_meta(spark, path))
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return rows.select(
        F.col("parent_asin").alias("item_id"),
        F.coalesce(some(F.col("store")), some(F.col("details")["Brand"]), F.lit("Unknown")).alias("brand"),
        F.coalesce(F.expr("try_cast(regexp_replace(price, '[$,]', '') as double)"), F.lit(-1.0)).alias("price"),
        F.coalesce(some(F.col("details")["Skin Type"]), F.lit("Unknown")).alias("skin_type"),
        F.coalesce(some(F.col("details")["Item Form"]), F.lit("Unknown")).alias("item_form"),
        "main_category", "average_rating", "rating_number",
    )


def first_brand(meta: DataFrame, wanted: DataFrame, order: Sequence[str]) -> DataFrame:
    """First non-empty brand, in ``order``, of every wanted item."""
    kept = meta.where("trim(brand) <> ''").join(wanted.select("item_id").distinct(), "item_id", "left_semi")
    return kept.groupBy("item_id").agg(F.min_by("brand", F.struct(*order)).alias("brand"))


def ratings_as_reviews(ratings: DataFrame) -> DataFrame:
    """Rating-only rows in the review schema, the rest at its defaults."""
    return ratings.select("user_id", F.col("item_id").alias("parent_asin"), F.col("item_id").alias("asin"), F.col("rating").cast("float").alias("rating"), F.col("ts").alias("timestamp"), F.lit(0).alias("helpful_vote"), F.lit(0).cast("tinyint").alias("verified_purchase"))


def first_existing(paths: Iterable[str]) -> str:
    """The first path of a list that exists on the driver."""
    for p in paths:
        if os.path.exists(p):
            return p
    raise FileNotFoundError(", ".join(paths))


def sanity(df: DataFrame) -> DataFrame:
    """Row count and share of ratings of 4 and more."""
    return df.agg(F.count("*").alias("rows"), F.round(F.avg((F.col("rating") >= 4).cast("int")), 9).alias("positive_share"))


def all_user_ids(*frames: DataFrame) -> DataFrame:
    """Set union of the ids of several sources."""
    out = frames[0].select(F.col("user_id").cast("string"))
    for f in frames[1:]:
        out = out.union(f.select(F.col("user_id").cast("string")))
    return out.distinct()


def wide_predictions(ranked: DataFrame, k: int, prefix: str = "item") -> DataFrame:
    """One row a user with columns ``prefix_1`` to ``prefix_k`` from rows ``user_id, rank, item_id``."""
    lists = ranked.where(F.col("rank") <= k).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "item_id"))).alias("m"))
    return lists.select("user_id", *[F.col("m")[i].alias(f"{prefix}_{i}") for i in range(1, k + 1)])


def write_predictions(ranked: DataFrame, path: str, k: int = 5, fmt: str = "csv") -> None:
    """Predictions as CSV (wide, with a header) or JSON (one array a user)."""
    if fmt == "csv":
        wide_predictions(ranked, k).write.mode("overwrite").option("header", True).csv(path)
    else:
        ranked.where(F.col("rank") <= k).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("items")).write.mode("overwrite").json(path)


def latest_by_position(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last row of every key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
