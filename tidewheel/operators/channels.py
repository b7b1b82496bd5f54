"""Retrieval channels: rows ``user_id, item_id, score, rank`` a channel, from histories and training statistics.

``hist`` is what a user has done before the cut, ``seen`` the pairs to leave out (the full history), ``hot`` the
popularity table with ``hot_rank``. Popular lists are joined by rank, up to what can be needed: a channel that wants the first k
unseen items looks at k + (seen items of the user) ranks, never at all items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import DAY_MS, last_events
from .shared import dealt, nine


def by_score(*tie: str) -> Window:
    return Window.partitionBy("user_id").orderBy(nine("score").desc(), *(tie or ("item_id",)))


def best(scored: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` items of every user by (-score, item_id)."""
    return scored.withColumn("rank", F.row_number().over(by_score())).where(F.col("rank") <= budget)


def unseen(cand: DataFrame, seen: DataFrame) -> DataFrame:
    return cand.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def recent(hist: DataFrame, half_life_days: float = 0.0, n: int = 50) -> DataFrame:
    """The last ``n`` events with ``decay``: 2 ** (-age / half life), the age counted from the user's last event (1 without a half life)."""
    last = F.max("ts").over(Window.partitionBy("user_id"))
    decay: Column = F.pow(F.lit(2.0), -((last - F.col("ts")) / DAY_MS) / half_life_days) if half_life_days else F.lit(1.0)
    return last_events(hist, n).withColumn("decay", decay)


def neighbour_sums(events: DataFrame, sim: DataFrame, seen: DataFrame, budget: int, parts: int | None = None) -> DataFrame:
    """Of every user the ``budget`` unseen neighbours with the highest sums of decay * sim over the user's ``events(user_id, item_id, decay)``.

    An item's neighbours and their similarities are two arrays, so an event crosses the network once and is laid out where its user is; what was seen comes along as
    an array without similarities. All that follows is by user and moves nothing again.
    """
    near = sim.groupBy("item_id").agg(F.collect_list(F.struct("neighbor", "sim")).alias("near")).select("item_id", F.transform("near", lambda x: x["neighbor"]).alias("ids"), F.transform("near", lambda x: x["sim"]).alias("sims"))
    each = events.select("user_id", "item_id", F.col("decay").cast("double").alias("decay")).join(near, "item_id").select("user_id", "decay", "ids", "sims")
    past = seen.groupBy("user_id").agg(F.collect_list("item_id").alias("ids")).select("user_id", F.lit(0.0).alias("decay"), "ids", F.lit(None).cast("array<double>").alias("sims"))
    one = dealt(each.unionByName(past), "user_id", parts=parts).select("user_id", "decay", "sims", F.posexplode("ids").alias("_p", "item_id")).select("user_id", "item_id", (F.col("decay") * F.get("sims", F.col("_p"))).alias("part"))
    sums = one.groupBy("user_id", "item_id").agg(F.sum("part").alias("score"), F.max(F.col("part").isNull()).alias("seen"))
    return best(sums.where("not seen").select("user_id", "item_id", "score"), budget)


def reached(events: DataFrame, targets: DataFrame, sim: DataFrame) -> DataFrame:
    """Targets ``user_id, item_id`` that are neighbours of some of the user's ``events``.

    An event takes its user's targets along to its item's neighbours, so neither neighbours nor pairs are sent; a target comes back once for each event that reaches it.
    """
    near = sim.groupBy("item_id").agg(F.collect_list("neighbor").alias("ids"))
    want = targets.groupBy("user_id").agg(F.collect_set("item_id").alias("want"))
    each = events.select("user_id", "item_id").join(want, "user_id").join(near, "item_id")
    return each.select("user_id", F.explode(F.array_intersect("want", "ids")).alias("item_id"))


def item_cf(hist: DataFrame, sim: DataFrame, seen: DataFrame, budget: int, half_life_days: float = 90.0, n: int = 50) -> DataFrame:
    """Decayed sums of the similarities of neighbours of the history; :func:`refill` tops them up before fusion."""
    return neighbour_sums(recent(hist, half_life_days, n), sim, seen, budget)


def legacy_item_cf(hist: DataFrame, sim: DataFrame, seen: DataFrame, budget: int, days: float = 7.0, neighbors: int = 10, parts: int | None = None) -> DataFrame:
    """Each event lends its first ``neighbors`` neighbours exp(-age / ``days``) of their similarity; what was seen goes after that."""
    last = F.max("ts").over(Window.partitionBy("user_id"))
    ev = hist.withColumn("decay", F.exp(-((last - F.col("ts")) / DAY_MS) / days))
    return neighbour_sums(ev, sim.where(F.col("rank") <= neighbors), seen, budget, parts)


def hot_by(hot: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Popular items ranked within a category or brand: ``key, item_id, key_rank``."""
    w = Window.partitionBy(key).orderBy("hot_rank")
    return hot.join(dim.select("item_id", key), "item_id").withColumn("key_rank", F.row_number().over(w)).select(key, "item_id", "hot_rank", "key_rank")


def preferred(hist: DataFrame, key: str, top: int = 3, n: int = 50) -> DataFrame:
    """A user's first ``top`` categories or brands of the last ``n`` events: ``user_id, key, share, cnt, seen_n``; ``seen_n`` counts all events with the key."""
    w = Window.partitionBy("user_id")
    back = F.row_number().over(w.orderBy(F.col("ts").desc(), F.col("item_id").desc()))
    cnt = hist.withColumn("_late", (back <= n).cast("int")).groupBy("user_id", key).agg(F.sum("_late").alias("cnt"), F.count("*").alias("seen_n"))
    ranked = cnt.where("cnt > 0").withColumn("len", F.sum("cnt").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.col("cnt").desc(), key)))
    return ranked.where(F.col("place") <= top).select("user_id", key, (F.col("cnt") / F.col("len")).alias("share"), "cnt", "seen_n")


def by_ranks(users: DataFrame, upto: Column, ranked: DataFrame, rank: str, *on: str) -> DataFrame:
    """Rows of ``ranked`` with a rank of at most ``upto``, by an equi-join on the rank."""
    return dealt(users, "user_id").withColumn(rank, F.explode(F.sequence(F.lit(1), upto.cast("int")))).join(ranked, [*on, rank])


#: Rows of a popular list that are broadcast at most.
BROADCAST_ROWS = 500_000


def unseen_by_ranks(users: DataFrame, upto: Column, ranked: DataFrame, rank: str, seen: DataFrame, deepest: int, *on: str, parts: int | None = None) -> DataFrame:
    """As :func:`by_ranks` without what was seen, for ``ranked(*on, item_id, rank)``; no ``upto`` exceeds ``deepest``, so only so much of ``ranked`` is read.

    Where that is at most ``BROADCAST_ROWS`` rows, users and what they have seen are dealt out by user once; ranks are laid out, looked up and crossed out where they land, and what follows
    by user moves nothing again.
    """
    top = ranked.where(F.col(rank) <= deepest)
    if top.count() > BROADCAST_ROWS:
        return unseen(by_ranks(users, upto, top, rank, *on), seen)
    own = [c for c in users.columns if c != "user_id"]
    known = seen.select("user_id", F.col("item_id").alias("_seen"), F.lit(0).alias("_upto"))
    both = users.withColumn("_upto", upto.cast("int")).unionByName(known, allowMissingColumns=True)
    rows = dealt(both, "user_id", parts=parts).withColumn(rank, F.explode(F.sequence(F.least(F.lit(1), "_upto"), "_upto")))
    rows = rows.join(F.broadcast(top), [*on, rank], "left").withColumn("item_id", F.coalesce("_seen", "item_id")).where("item_id is not null")
    # an item that was seen has a row of its own; one that wasn't stands once in a list
    keep = [c for c in dict.fromkeys([*own, *top.columns]) if c != "item_id"]
    one = rows.groupBy("user_id", "item_id").agg(F.max(F.col("_seen").isNotNull()).alias("_known"), *[F.first(c, ignorenulls=True).alias(c) for c in keep])
    return one.where("not _known").drop("_known")


def longest(hist: DataFrame) -> int:
    """The most events that a user has."""
    return hist.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def category(hist: DataFrame, dim: DataFrame, hot: DataFrame, seen: DataFrame, top: int = 3, each: int = 20) -> DataFrame:
    """The first ``each`` unseen popular items of a user's first ``top`` categories, scored by the category's share."""
    pref = preferred(hist.drop("category").join(dim.select("item_id", "category"), "item_id"), "category", top)
    cand = unseen_by_ranks(pref, F.col("seen_n") + each, hot_by(hot, dim, "category"), "key_rank", seen, longest(hist) + each, "category")
    w = Window.partitionBy("user_id", "category").orderBy("key_rank")
    cand = cand.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each)
    return cand.select("user_id", "item_id", F.col("share").alias("score")).withColumn("rank", F.row_number().over(by_score()))


def legacy_category(hist: DataFrame, dim: DataFrame, hot: DataFrame, top: int = 3, each: int = 20) -> DataFrame:
    """Half the share for the first ``each`` popular items of the first ``top`` categories, seen or not."""
    pref = preferred(hist.drop("category").join(dim.select("item_id", "category"), "item_id"), "category", top, n=1 << 30)
    cand = pref.join(hot_by(hot, dim, "category").where(F.col("key_rank") <= each), "category")
    return cand.select("user_id", "item_id", (F.col("share") * 0.5).alias("score")).withColumn("rank", F.row_number().over(by_score()))


def brand(hist: DataFrame, dim: DataFrame, hot: DataFrame, seen: DataFrame, budget: int, top: int = 3, named: bool = False, parts: int | None = None) -> DataFrame:
    """Unseen items of a user's first ``top`` brands in the order of popularity: share / (place in the brand's unseen list), dealt out by user into ``parts``.

    The share is of all the last events, of known brand or not. With ``named`` events have their item's brand of ``dim`` already, so none is sent for it.
    """
    known = dim.where("brand is not null")
    pref = preferred(hist.where("brand is not null") if named else hist.drop("brand").join(known.select("item_id", "brand"), "item_id"), "brand", top)
    length = last_events(hist).groupBy("user_id").agg(F.count("*").alias("_len"))
    pref = pref.join(length, "user_id").select("user_id", "brand", "cnt", "_len", "seen_n")
    cand = unseen_by_ranks(pref, F.col("seen_n") + budget, hot_by(hot, known, "brand"), "key_rank", seen, longest(hist) + budget, "brand", parts=parts)
    w = Window.partitionBy("user_id", "brand").orderBy("key_rank")
    cand = cand.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget)
    return best(cand.select("user_id", "item_id", (F.col("cnt") / F.col("_len") / F.col("_n")).alias("score")), budget)


def hot_items(hist: DataFrame, hot: DataFrame, seen: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` unseen popular items: 1 / rank."""
    users = hist.groupBy("user_id").agg(F.count("*").alias("seen_n"))
    cand = unseen_by_ranks(users, F.col("seen_n") + k, hot, "hot_rank", seen, longest(hist) + k)
    cand = cand.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("hot_rank"))).where(F.col("rank") <= k)
    return cand.select("user_id", "item_id", (1 / F.col("rank")).alias("score"), "rank")


def legacy_hot(users: DataFrame, hot: DataFrame, k: int = 5, weight: float = 0.1) -> DataFrame:
    """The first ``k`` popular items for everyone, seen or not: weight * (1 - place / k), places from 0."""
    u = users.select("user_id").distinct().withColumn("hot_rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return u.join(F.broadcast(hot.where(F.col("hot_rank") <= k)), "hot_rank").select("user_id", "item_id", (weight * (1 - (F.col("hot_rank") - 1) / k)).alias("score"), F.col("hot_rank").alias("rank"))


def topped(pool: DataFrame, popular: DataFrame, budget: int, score: float = -1.0) -> DataFrame:
    """``pool``, ranked from 1 without gaps, and behind it what it lacks of ``popular(user_id, item_id, hot_rank)``, up to ``budget`` a user. Both are dealt out by user once."""
    mine = pool.where(F.col("rank") <= budget).select("user_id", "item_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("_at"))
    both = mine.unionByName(popular.select("user_id", "item_id", F.lit(None).cast("double").alias("score"), (F.col("hot_rank") + budget).cast("long").alias("_at")))
    one = dealt(both, "user_id").groupBy("user_id", "item_id").agg(F.max("score").alias("score"), F.min("_at").alias("_at"))
    out = one.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("_at"))).where(F.col("rank") <= budget)
    return out.select("user_id", "item_id", F.coalesce("score", F.lit(score)).alias("score"), "rank")


def refill(pool: DataFrame, hist: DataFrame, hot: DataFrame, seen: DataFrame, budget: int, score: float = -1.0) -> DataFrame:
    """``pool`` topped up with unseen popular items that it lacks, up to ``budget`` a user.

    Popular items are laid out only for users whose pool is short, and only as far down as ``budget`` and what they have seen. Pool and popular items are read more than once: a pool
    that is dear to compute is best stored, by user, as rows of users whose pool is full then stay where they are.
    """
    users = hist.groupBy("user_id").agg(F.count("*").alias("seen_n")).join(pool.groupBy("user_id").agg(F.count("*").alias("_n")), "user_id", "left")
    short = users.where(F.coalesce("_n", F.lit(0)) < budget).drop("_n")
    popular = unseen_by_ranks(short, F.col("seen_n") + budget, hot, "hot_rank", seen, longest(hist) + budget)
    own = pool.select("user_id", "item_id", F.col("score").cast("double").alias("score"), "rank").withColumn("_n", F.count("*").over(Window.partitionBy("user_id")))
    full = own.where((F.col("_n") >= budget) & (F.col("rank") <= budget)).drop("_n")
    return full.unionByName(topped(own.where(F.col("_n") < budget).drop("_n"), popular, budget, score))


def multi_interest(per_interest: DataFrame, budget: int) -> DataFrame:
    """Lists of several interests one after another, items once, cut at ``budget``: 1 / place."""
    first = per_interest.groupBy("user_id", "item_id").agg(F.min(F.struct("interest", "rank")).alias("at"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("at"))).where(F.col("rank") <= budget)
    return out.select("user_id", "item_id", (1 / F.col("rank")).alias("score"), "rank")
