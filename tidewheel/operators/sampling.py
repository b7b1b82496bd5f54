"""Negative sampling by hash order, and reranking by pluggable scores.

Nothing is drawn: a row's place in an order of hashes of (seed, keys) is its random number (:func:`tidewheel.operators.shared.lot`), so reruns, any partitioning and other engines agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .channels import by_ranks
from .shared import lot, nine, numbered


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) by hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)


def random_negatives(records: DataFrame, catalogue: DataFrame, known: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` distinct active items a user that are not known: ``user_id, item_id, place``.

    Each user starts at a hashed place of a hashed order of the catalogue and walks on, k + known steps at most.
    """
    order = numbered(catalogue.select("item_id"), "at", lot(seed, "item_id"), F.col("item_id"))
    size = order.agg(F.count("*").alias("size"))
    n = known.groupBy("user_id").agg(F.count_distinct("item_id").alias("known_n"))
    u = records.select("user_id").distinct().join(n, "user_id", "left").na.fill(0).crossJoin(F.broadcast(size))
    steps = u.withColumn("step", F.explode(F.sequence(F.lit(0), (F.least(F.col("size"), F.col("known_n") + k) - 1).cast("int"))))
    steps = steps.withColumn("at", (lot(seed + 1, "user_id") % F.col("size") + F.col("step")) % F.col("size") + 1)
    cand = steps.join(order, "at").join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("step")
    return cand.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("user_id", "item_id", "place")


def mixed_negatives(pool: DataFrame, fallback: DataFrame, known: DataFrame, k: int = 4, seed: int = 0, quota: int = 2) -> DataFrame:
    """``quota`` of pool ranks 11 to 25, ``quota`` of 26 to 50; what the bands lack of that comes from the rest of the pool, all else from ``fallback``; never known or twice."""
    band = F.when(F.col("rank").between(11, 25), 0).when(F.col("rank").between(26, 50), 1).otherwise(2)
    p = pool.join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").withColumn("band", band)
    by = lambda *c: Window.partitionBy("user_id", *c).orderBy(lot(seed, "user_id", "item_id"), "item_id")
    p = p.withColumn("n", F.row_number().over(by("band"))).withColumn("tier", F.when((F.col("band") < 2) & (F.col("n") <= quota), F.col("band")).otherwise(2))
    got = F.sum((F.col("tier") < 2).cast("int")).over(Window.partitionBy("user_id"))
    p = p.withColumn("got", got).withColumn("n", F.row_number().over(by("tier"))).where((F.col("tier") < 2) | (F.col("n") <= 2 * quota - F.col("got")))
    f = fallback.select("user_id", "item_id", F.lit(3).alias("tier"), F.col("place").alias("n"))
    all_ = p.select("user_id", "item_id", "tier", "n").unionByName(f).groupBy("user_id", "item_id").agg(F.min(F.struct("tier", "n")).alias("at"))
    all_ = all_.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "item_id"))).where(F.col("place") <= k)
    return all_.select("user_id", "item_id", F.col("at.tier").alias("tier"), "place")


#: Stretches into which the counted events are cut, so that draws find their items.
STRETCHES = 100_000


def weighted_negatives(records: DataFrame, hot: DataFrame, known: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` distinct items a user that are not known, drawn one after the other by popularity from all of ``hot``: ``user_id, item_id, place``.

    A draw is a hashed place among all counted events, 4 k + 16 of them a user; an item owns as many places as it has events. The places are cut into ``STRETCHES`` at most; an item stands
    once in every stretch that it reaches into, and in the order of places a draw's item is the last one before it, so nothing is laid out by its count and no draw is paired with many items.
    Repeated and known items are drawn again. A user who lacks items after all draws gets the most popular ones that are neither known nor drawn, from as far down as that takes.
    Only a user with fewer than ``k`` unknown items of positive count has fewer.
    """
    items = hot.where("cnt > 0").select("item_id", "cnt", "hot_rank", F.floor(F.col("hot_rank") / 4096).alias("block"))
    sums = items.groupBy("block").agg(F.sum("cnt").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.orderBy("block")) - F.col("s")).select("block", "before")
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("total"), F.greatest(F.ceil(F.sum("s") / STRETCHES), F.lit(1)).alias("width"))
    end = F.col("before") + F.sum("cnt").over(Window.partitionBy("block").orderBy("hot_rank"))
    owned = items.join(F.broadcast(before), "block").withColumn("end", end).withColumn("first", F.col("end") - F.col("cnt")).crossJoin(F.broadcast(total))
    reach = F.sequence(F.floor(F.col("first") / F.col("width")), F.floor((F.col("end") - 1) / F.col("width")))
    begins = owned.select("item_id", "first", "width", F.explode(reach).alias("stretch")).select("stretch", F.greatest("first", F.col("stretch") * F.col("width")).alias("at"), F.lit(None).cast(dict(records.dtypes)["user_id"]).alias("user_id"), F.lit(0).alias("draw"), "item_id")
    users = records.select("user_id").distinct()
    known = known.select("user_id", "item_id").distinct()
    draws = users.crossJoin(F.broadcast(total)).where("total > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(4 * k + 16)))).withColumn("at", lot(seed, "user_id", "draw") % F.col("total"))
    asks = draws.select(F.floor(F.col("at") / F.col("width")).alias("stretch"), "at", "user_id", "draw", F.lit(None).cast(dict(hot.dtypes)["item_id"]).alias("item_id"))
    upto = Window.partitionBy("stretch").orderBy("at", "draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = begins.unionByName(asks).withColumn("item_id", F.last("item_id", ignorenulls=True).over(upto)).where("draw > 0")
    first = told.groupBy("user_id", "item_id").agg(F.min("draw").alias("draw")).join(known, ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("draw")
    drawn = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("user_id", "item_id", "place")
    short = users.join(drawn.groupBy("user_id").agg(F.count("*").alias("got")), "user_id", "left").na.fill(0).where(F.col("got") < k)
    short = short.join(known.groupBy("user_id").agg(F.count("*").alias("known_n")), "user_id", "left").na.fill(0, ["known_n"])
    rest = by_ranks(short, F.col("known_n") + k, items.select("item_id", "hot_rank"), "hot_rank").join(known.unionByName(drawn.select("user_id", "item_id")), ["user_id", "item_id"], "left_anti")
    rest = rest.withColumn("place", F.col("got").cast("int") + F.row_number().over(Window.partitionBy("user_id").orderBy("hot_rank"))).where(F.col("place") <= k)
    return drawn.unionByName(rest.select("user_id", "item_id", "place"))


def cf_negatives(hist: DataFrame, sim: DataFrame, known: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` of the first 30 neighbours of the last 10 events, by hash, that a user doesn't know."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("item_id").desc())
    last = hist.withColumn("b", F.row_number().over(w)).where("b <= 10")
    cand = last.join(sim.where("rank <= 30").select("item_id", "neighbor"), "item_id").select("user_id", F.col("neighbor").alias("item_id")).distinct()
    cand = cand.join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    o = Window.partitionBy("user_id").orderBy(lot(seed, "user_id", "item_id"), "item_id")
    return cand.withColumn("place", F.row_number().over(o)).where(F.col("place") <= k)


def explicit_negatives(df: DataFrame) -> DataFrame:
    """Items that a user rated 1 or 2."""
    return df.where("rating <= 2").groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def bpr_pairs(pos: DataFrame, hard: DataFrame, rand: DataFrame, ratio: int) -> DataFrame:
    """Each positive with ``ratio`` negatives of its user, hard ones first."""
    neg = hard.select("user_id", F.col("item_id").alias("neg"), F.lit(0).alias("tier"), "place").unionByName(rand.select("user_id", F.col("item_id").alias("neg"), F.lit(1).alias("tier"), "place"))
    w = Window.partitionBy("user_id").orderBy("tier", "place")
    neg = neg.groupBy("user_id", "neg").agg(F.min(F.struct("tier", "place")).alias("x")).select("user_id", "neg", "x.*").withColumn("n", F.row_number().over(w)).where(F.col("n") <= ratio)
    return pos.select("user_id", "item_id").join(neg.select("user_id", "neg"), "user_id")


def negative_audit(neg: DataFrame, known: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Counts of negatives that repeat, are known or aren't in the catalogue."""
    n = neg.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    j = n.join(known.select("user_id", "item_id").distinct().withColumn("k", F.lit(1)), ["user_id", "item_id"], "left").join(catalogue.select("item_id").distinct().withColumn("c", F.lit(1)), "item_id", "left")
    return j.agg(F.sum((F.col("n") > 1).cast("int")).alias("repeated"), F.sum(F.coalesce("k", F.lit(0))).alias("known"), F.sum(F.col("c").isNull().cast("int")).alias("outside"))


def cohorts(users: DataFrame, screen: int, seed: int) -> DataFrame:
    """Users in hash order: the first ``screen`` are the screening cohort, the others confirm."""
    at = numbered(users.select("user_id").distinct(), "_at", lot(seed, "user_id"), F.col("user_id"))
    return at.select("user_id", F.when(F.col("_at") <= screen, "screen").otherwise("confirm").alias("cohort"))


def split_cohorts(users: DataFrame, screen: int, seed: int, historical: DataFrame) -> DataFrame:
    """:func:`cohorts` with ``historical``: whether the user is in the (large) table of users known from before."""
    past = historical.select("user_id").distinct().withColumn("_past", F.lit(True))
    return cohorts(users, screen, seed).join(past, "user_id", "left").select("user_id", "cohort", F.col("_past").isNotNull().alias("historical"))


def blend(logit: Column, channel: Column) -> Column:
    """0.7 of the model's probability and 0.3 of a squashed channel score."""
    return 0.7 / (1 + F.exp(-logit)) + 0.3 * channel / (F.abs(channel) + 1)


def bpr_loss(pos: Column, neg: Column) -> Column:
    """softplus(neg - pos), for the mean."""
    d = neg - pos
    return F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def rerank(pool: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], features: list[str], k: int) -> DataFrame:
    """The ``k`` items of highest model score: ``scorer`` gets a batch of the pool's ``features`` and returns its scores."""
    kind = dict(pool.dtypes)
    cols = ["user_id", "item_id", *features]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[["user_id", "item_id"]].assign(score=scorer(pdf[features]).astype(float))

    s = pool.select(*cols).mapInPandas(run, f"user_id {kind['user_id']}, item_id {kind['item_id']}, score double")
    w = Window.partitionBy("user_id").orderBy(nine("score").desc(), "item_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
