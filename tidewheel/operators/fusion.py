"""Fusion of ranked channels: rows ``channel, user_id, item_id, score, rank`` to one pool a user."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .channels import best, unseen
from .shared import nine

DEFAULT_WEIGHTS = {"vector": 1.5, "cf": 1.0, "category": 0.7, "hot": 0.05}
#: Fusion mode, half life in days (0: none) and whether brands are a channel, of the named recipes, and their channels' weights.
RECIPES = {"quota": ("quota", 0.0, False), "rrf": ("rrf", 0.0, False), "cf30": ("quota", 30.0, False), "cf90": ("quota", 90.0, False), "brand": ("quota", 0.0, True)}
RECIPE_WEIGHTS = {"cf": 1.5, "vector": 1.0, "category": 0.7, "hot": 0.05, "brand": 0.2}


def check_weights(weights: Sequence[float] | None, names: Sequence[str] = tuple(DEFAULT_WEIGHTS)) -> dict[str, float]:
    """Weights by channel; null gives the default. They must be as many, finite, not negative and not all zero."""
    if weights is None:
        return dict(DEFAULT_WEIGHTS)
    if len(weights) != len(names) or not all(math.isfinite(w) and w >= 0 for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative, one for each channel and not all zero")
    return dict(zip(names, map(float, weights), strict=True))


def stack(channels: Mapping[str, DataFrame]) -> DataFrame:
    """One table of several channels."""
    out = None
    for name, c in channels.items():
        c = c.select(F.lit(name).alias("channel"), "user_id", "item_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
        out = c if out is None else out.unionByName(c)
    return out


def _weight(weights: Mapping[str, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("channel")), F.lit(0.0))


def rrf(stacked: DataFrame, weights: Mapping[str, float], budget: int, seen: DataFrame | None = None, k: int = 60, placed: bool = False) -> DataFrame:
    """Reciprocal rank fusion: sums of w / (k + rank), ranks taken before what was seen is left out. Rows are dealt out by user once, for the ranks, the sums and the order, or not at all if they are ``placed`` so."""
    w = Window.partitionBy("channel", "user_id").orderBy(nine("score").desc(), "item_id")
    own = stacked.withColumn("w", _weight(weights)).where("w > 0")
    own = (own if placed else own.repartition("user_id")).withColumn("rank", F.row_number().over(w))
    s = own.groupBy("user_id", "item_id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"))
    return best(unseen(s, seen) if seen is not None else s, budget)


def quota(stacked: DataFrame, weights: Mapping[str, float], budget: int, seen: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """Quota fusion: each channel brings its first max(1, int(budget * w / sum w)) unseen items; items score sum w * score over all channels.

    What is missing to the budget comes from the other items by (-score, id as text); so is the order of the pool, of which ``budget`` stay. Rows that are ``placed`` by user are not dealt out again.
    """
    total = sum(weights.values())
    own = stacked.withColumn("w", _weight(weights)).where("w > 0")
    own = unseen(own, seen) if seen is not None else own
    own = own if placed else own.repartition("user_id")
    w = Window.partitionBy("channel", "user_id").orderBy("rank")
    own = own.withColumn("place", F.row_number().over(w)).withColumn("q", F.greatest(F.lit(1), F.floor(F.lit(budget) * F.col("w") / total)))
    s = own.groupBy("user_id", "item_id").agg(F.sum(F.col("w") * F.col("score")).alias("score"), F.max((F.col("place") <= F.col("q")).cast("int")).alias("chosen"))
    order = [nine("score").desc(), F.col("item_id").cast("string")]
    s = s.withColumn("tier", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("chosen").desc(), *order))).where(F.col("tier") <= budget)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).select("user_id", "item_id", "score", "rank")


def fuse(lists: Mapping[str, DataFrame], mode: str, weights: Mapping[str, float], budget: int, seen: DataFrame | None = None) -> DataFrame:
    """The channels' lists in one pool by the named mode, quota or rrf, with the weights of the channels that are there."""
    if mode not in ("quota", "rrf"):
        raise ValueError(f"no fusion mode {mode}")
    own = {c: weights[c] for c in lists}
    return (quota if mode == "quota" else rrf)(stack(lists), own, budget, seen)


def legacy_weighted(stacked: DataFrame, weights: Mapping[str, float], n: int) -> DataFrame:
    """Only each channel's first max(3, int(n * w / sum w)) items count: sums of score * w, the first ``n``."""
    total = sum(weights.values())
    own = stacked.withColumn("w", _weight(weights)).where("w > 0").where(F.col("rank") <= F.greatest(F.lit(3), F.floor(F.lit(n) * F.col("w") / total)))
    return best(own.groupBy("user_id", "item_id").agg(F.sum(F.col("score") * F.col("w")).alias("score")), n)


def union_pool(stacked: DataFrame) -> DataFrame:
    """Every item of any channel with its best 1 / rank."""
    s = stacked.groupBy("user_id", "item_id").agg(F.max(1 / F.col("rank")).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(nine("score").desc(), "item_id")))


#: Users whose lists are compared in one group of :func:`weight_grid`.
GRID_USERS = 64


def gathered(users: DataFrame, *frames: DataFrame) -> DataFrame:
    """``users``, a row each, and ``rows``: an array of what :func:`stack` gives, of all ``frames``; a frame may come as ``user_id, rows`` itself.

    Everything is joined by the user alone, so frames that are stored by user in the same parts stay where they are, which a union of them doesn't.
    """
    for f in frames:
        own = f if "rows" in f.columns else f.groupBy("user_id").agg(F.collect_list(F.struct("channel", "item_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))).alias("rows"))
        own = own.select("user_id", F.col("rows").alias("_more"))
        none = F.array().cast(own.schema["_more"].dataType)
        users = users.join(own, "user_id", "left").withColumn("rows", F.concat(*(["rows"] if "rows" in users.columns else []), F.coalesce("_more", none))).drop("_more")
    return users


def _with_targets(stacked: DataFrame | Sequence[DataFrame], names: Sequence[str], targets: DataFrame) -> tuple[int, DataFrame]:
    """The number of users with targets, and a row ``user_id`` for each with a target in some of the channels ``names``: arrays ``channel`` (by its place there), ``item_id``, ``score``, ``rank`` and ``hit`` of what these bring."""
    want = targets.where("user_id is not null").groupBy("user_id").agg(F.collect_set("item_id").alias("_want"))
    place = lambda x: (F.array_position(F.array(*map(F.lit, names)), x["channel"]) - 1).cast("int")
    rows = gathered(want, *([stacked] if isinstance(stacked, DataFrame) else stacked)).withColumn("rows", F.filter("rows", lambda x: F.array_contains(F.array(*map(F.lit, names)), x["channel"])))
    rows = rows.withColumn("hit", F.transform("rows", lambda x: F.coalesce(F.array_contains("_want", x["item_id"]), F.lit(False)))).where(F.array_contains("hit", True))
    return want.count(), rows.select("user_id", F.transform("rows", place).alias("channel"), *[F.col("rows")[c].alias(c) for c in ("item_id", "score", "rank")], "hit")


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The named arrays of each user of :func:`_with_targets`."""
    ends = np.cumsum(batch.column("hit").value_lengths().to_numpy(zero_copy_only=False))
    flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in names]
    for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True):
        yield tuple(c[a:z] for c in flat)


def weight_grid(stacked: DataFrame | Sequence[DataFrame], grid: DataFrame, targets: DataFrame, budget: int, k: int = 60) -> DataFrame:
    """Hit rate of reciprocal rank fusion under many weight sets: ``grid(combo, channel, w)``, which are parameters and few.

    As in :func:`tune_weights` no list is built: rows are not laid out by set, an item's scores under all sets are a row of a product, and a target's rank is one more than the items that beat it.
    Only users with a target in some channel are looked at.
    """
    given = grid.select("combo", "channel", "w").collect()
    combos, names = list(dict.fromkeys(r["combo"] for r in given)), list(dict.fromkeys(r["channel"] for r in given))
    weights = np.zeros((len(names), len(combos)))
    for r in given:
        if r["w"] is not None and r["w"] > 0:
            weights[names.index(r["channel"]), combos.index(r["combo"])] += r["w"]
    users, rows = _with_targets(stacked, names, targets)

    def count(t: pa.Table) -> pa.Table:
        hits = np.zeros(len(combos), np.int64)
        for channel, item, rank, hit in (x for b in t.to_batches() for x in _lists(b, "channel", "item_id", "rank", "hit")):
            ids, at_item = np.unique(item, return_inverse=True)
            value = np.zeros((len(ids), len(combos)))
            np.add.at(value, at_item, weights[channel] / (k + rank)[:, None])
            value = np.where(value > 0, np.floor(value * 1e9 + 0.5), -np.inf)
            found = np.zeros(len(combos), bool)
            for j in np.unique(at_item[hit]):
                found |= (value[j] > -np.inf) & (1 + (value > value[j]).sum(axis=0) + (value[:j] == value[j]).sum(axis=0) <= budget)
            hits += found
        return pa.table({"at": pa.array(range(len(combos)), pa.int32()), "hits": hits})

    block = F.pmod(F.xxhash64("user_id"), F.lit(max(1, users // GRID_USERS))).alias("block")
    got = rows.select(block, "channel", "item_id", "rank", "hit").groupBy("block").applyInArrow(count, "at int, hits long").groupBy("at").agg(F.sum("hits").alias("hits"))
    sets = targets.sparkSession.createDataFrame(list(enumerate(combos)), f"at int, combo {dict(grid.dtypes)['combo']}")
    return sets.join(F.broadcast(got), "at", "left").select("combo", F.round(F.coalesce("hits", F.lit(0)) / F.lit(users or None).cast("double"), 6).alias("hr"))


def weight_sets(candidates: Mapping[str, Sequence[float]], fixed: Mapping[str, float] | None = None) -> list[dict[str, float]]:
    """All combinations of the candidates' weights, the last channel varying fastest, each behind the ``fixed`` ones."""
    return [{**(fixed or {}), **dict(zip(candidates, w, strict=True))} for w in product(*candidates.values())]


def tune_weights(stacked: DataFrame | Sequence[DataFrame], sets: Sequence[Mapping[str, float]], targets: DataFrame, n: int = 100, at: int = 20, least: int = 3) -> DataFrame:
    """Hit rate at ``n`` and DCG at ``at`` of the weighted quota fusion under every set of weights: ``combo`` (from 0), a column a channel, ``hr, ndcg``.

    A channel brings its first max(``least``, int(n * w / sum w)) items; an item scores the sum of w * score over the channels that bring it; lists are ordered by (-score, item_id). No list is
    built: an item's score under all sets is one row of a product of channels x sets, and a target's rank under a set is one more than the items that beat it there. Only users with a target
    in some channel are looked at, where their lists are (see :func:`gathered`; ``stacked`` may be several frames), and a part gives one row a set. All users of ``targets`` count. A channel without a weight brings nothing.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    weights = np.array([[float(s.get(c, 0.0)) for c in names] for s in sets])
    total = np.zeros(len(sets))
    for c in range(len(names)):
        total = total + np.maximum(weights[:, c], 0)
    quota = np.where(weights > 0, np.maximum(least, np.floor(n * weights / np.where(total > 0, total, 1)[:, None])), 0)
    users, rows = _with_targets(stacked, names, targets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, dcg = np.zeros(len(sets), np.int64), np.zeros(len(sets))
        for channel, item, score, rank, hit in (x for b in batches for x in _lists(b, "channel", "item_id", "score", "rank", "hit")):
            ids, at_item = np.unique(item, return_inverse=True)
            value, there = np.zeros((len(ids), len(sets))), np.zeros((len(ids), len(sets)), bool)
            for c in range(len(names)):
                own = channel == c
                row = at_item[own]
                inside = rank[own][:, None] <= quota[:, c]
                value[row] += score[own][:, None] * weights[:, c] * inside
                there[row] |= inside
            value = np.where(there, np.floor(value * 1e9 + 0.5), -np.inf)
            found = np.zeros(len(sets), bool)
            for j in np.unique(at_item[hit]):
                place = 1 + (value > value[j]).sum(axis=0) + (value[:j] == value[j]).sum(axis=0)
                found |= there[j] & (place <= n)
                dcg += np.where(there[j] & (place <= at), 1 / np.log2(place + 1), 0.0)
            hits += found
        yield pa.RecordBatch.from_pydict({"combo": pa.array(range(len(sets)), pa.int32()), "hits": hits, "dcg": dcg})

    spark = targets.sparkSession
    got = rows.mapInArrow(count, "combo int, hits long, dcg double").groupBy("combo").agg(F.sum("hits").alias("hits"), F.sum("dcg").alias("dcg"))
    grid = spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(weights.tolist())], f"combo int, {', '.join(f'`{c}` double' for c in names)}")
    rate = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / max(1, users), 6)
    return grid.join(F.broadcast(got), "combo", "left").select("combo", *names, rate("hits").alias("hr"), rate("dcg").alias("ndcg"))


def best_weights(tuned: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """The weights of the highest hit rate, the first of equals."""
    row = tuned.orderBy(F.desc("hr"), "combo").first()
    return {c: row[c] for c in names}
