"""Ranking metrics, AUC, coverage, attribution and paired comparison.

``ranked``: ``user_id, item_id, rank`` from 1; ``targets``: ``user_id, item_id``, whose users are the users of the evaluation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lot, numbered, stored


def user_metrics(ranked: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """``user_id, hit, recall, ndcg`` at ``k``; items that repeat count where they come first, a user without a list has zeros."""
    first = ranked.groupBy("user_id", "item_id").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("rank"))).where(F.col("rank") <= k)
    truth = targets.select("user_id", "item_id").distinct()
    found = first.join(truth, ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    size = truth.groupBy("user_id").agg(F.count("*").alias("targets"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("targets")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    m = size.join(found, "user_id", "left")
    return m.select("user_id", (F.coalesce("found", F.lit(0)) > 0).cast("int").alias("hit"), (F.coalesce("found", F.lit(0)) / F.greatest("targets", F.lit(1))).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def ranking_metrics(ranked: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Means over users of hit rate, recall and NDCG at ``k``."""
    return user_metrics(ranked, targets, k).agg(F.count("*").alias("users"), F.round(F.avg("hit"), 6).alias("hr"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def legacy_metrics(ranked: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Hit rate and a DCG that is not normalised."""
    hit = ranked.where(F.col("rank") <= k).join(targets.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")
    per = hit.groupBy("user_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    m = targets.select("user_id").distinct().join(per, "user_id", "left")
    return m.agg(F.round(F.avg(F.col("dcg").isNotNull().cast("int")), 6).alias("hr"), F.round(F.avg(F.coalesce("dcg", F.lit(0.0))), 6).alias("dcg"))


def hit_rates(stacked: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    """Hit rate of every channel at several cuts."""
    best = stacked.join(targets.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi").groupBy("channel", "user_id").agg(F.min("rank").alias("rank"))
    n = targets.agg(F.count_distinct("user_id").alias("users"))
    return best.groupBy("channel").agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in ks]).crossJoin(n).select("channel", *[F.round(F.col(f"h{k}") / F.col("users"), 6).alias(f"hr{k}") for k in ks])


def sampled_rank(scored: DataFrame, k: int) -> DataFrame:
    """``user_id, score, label``: one positive among negatives; its rank counts negatives of an equal score."""
    pos = scored.where("label = 1").select("user_id", F.col("score").alias("p"))
    r = scored.where("label = 0").join(pos, "user_id").groupBy("user_id").agg((1 + F.sum((F.col("score") >= F.col("p")).cast("int"))).alias("rank"))
    return r.agg(F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias("hr"), F.round(F.avg(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias("ndcg"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the curve by group from rank sums, ties half: ``keys, pos, neg, auc`` (null without both labels)."""
    by = scored.groupBy(*keys, "score").agg(F.sum(F.col("label")).alias("p"), F.sum(1 - F.col("label")).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    below = F.coalesce(F.sum("n").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = by.withColumn("won", F.col("p") * (below + F.col("n") * 0.5)).groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum("won").alias("won"))
    return s.select(*keys, "pos", "neg", F.expr("case when pos > 0 and neg > 0 then round(won / (pos * neg), 9) end").alias("auc"))


def gauc(scored: DataFrame) -> DataFrame:
    """Mean AUC of the users with both labels, and their share."""
    return auc(scored, ["user_id"]).agg(F.round(F.avg("auc"), 6).alias("gauc"), F.round(F.avg(F.col("auc").isNotNull().cast("int")), 6).alias("coverage"))


def pool_coverage(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """Share of users with a target in their pool, and mean share of targets in it."""
    truth = targets.select("user_id", "item_id").distinct()
    found = truth.join(pool.select("user_id", "item_id").distinct().withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left")
    per = found.groupBy("user_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return per.agg(F.round(F.avg((F.col("share") > 0).cast("int")), 6).alias("pool_hr"), F.round(F.avg("share"), 6).alias("coverage"))


def conditional_hr(hr: Column, pool_hr: Column) -> Column:
    """Hit rate given that the pool holds a target; 0 if none does."""
    return F.when(pool_hr == 0, 0.0).otherwise(hr / pool_hr)


def channel_hits(stacked: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """One row a user with a flag for each channel that holds a target."""
    hit = stacked.join(targets.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")
    flags = hit.groupBy("user_id").agg(*[F.max((F.col("channel") == n).cast("int")).alias(n) for n in names])
    return targets.select("user_id").distinct().join(flags, "user_id", "left").na.fill(0)


def union_gain(hits: DataFrame, names: list[str]) -> DataFrame:
    """For each channel: users hit, hit by it alone, and the rate of the union with and without it."""
    total = sum(F.col(n) for n in names)
    aggs = []
    for n in names:
        others = total - F.col(n)
        aggs.append(F.struct(F.lit(n).alias("channel"), F.sum(n).alias("hits"), F.sum(((F.col(n) == 1) & (others == 0)).cast("int")).alias("alone"), F.round(F.avg((total > 0).cast("int")), 6).alias("union_hr"), F.round(F.avg((others > 0).cast("int")), 6).alias("without_hr")))
    return hits.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def reachability(targets: DataFrame, hist: DataFrame, sim: DataFrame, near: int = 10) -> DataFrame:
    """Each (user, target): in_history, near (among a history item's first ``near`` neighbours), edge (a later one) or unreachable."""
    past = hist.select("user_id", "item_id").distinct()
    edge = past.join(sim.select("item_id", "neighbor", "rank"), "item_id").groupBy("user_id", F.col("neighbor").alias("item_id")).agg(F.min("rank").alias("r"))
    t = targets.select("user_id", "item_id").distinct().join(past.withColumn("past", F.lit(1)), ["user_id", "item_id"], "left").join(edge, ["user_id", "item_id"], "left")
    return t.select("user_id", "item_id", F.when(F.col("past") == 1, "in_history").when(F.col("r") <= near, "near").when(F.col("r").isNotNull(), "edge").otherwise("unreachable").alias("reach"))


def overlap(a: DataFrame, b: DataFrame, empty: float = 0.0) -> DataFrame:
    """Shared items and Jaccard of two pools by user; ``empty`` where both are empty."""
    la = a.groupBy("user_id").agg(F.collect_set("item_id").alias("x"))
    lb = b.groupBy("user_id").agg(F.collect_set("item_id").alias("y"))
    j = la.join(lb, "user_id", "full").select("user_id", F.coalesce("x", F.array().cast("array<bigint>")).alias("x"), F.coalesce("y", F.array().cast("array<bigint>")).alias("y"))
    u = F.size(F.array_union("x", "y"))
    return j.select("user_id", F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_except("y", "x")).alias("added"), F.size(F.array_except("x", "y")).alias("removed"), F.round(F.when(u > 0, F.size(F.array_intersect("x", "y")) / u).otherwise(empty), 6).alias("jaccard"))


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Users gained and lost, change of hit rate and NDCG; both must have the same users: ``user_id, hit, ndcg``."""
    j = old.select("user_id", F.col("hit").alias("h0"), F.col("ndcg").alias("n0")).join(new.select("user_id", F.col("hit").alias("h1"), F.col("ndcg").alias("n1")), "user_id", "full")
    j = j.withColumn("bad", (F.col("h0").isNull() | F.col("h1").isNull()).cast("int"))
    d = F.col("h1") - F.col("h0")
    out = j.agg(F.count("*").alias("users"), F.sum((d > 0).cast("int")).alias("gained"), F.sum((d < 0).cast("int")).alias("lost"), F.round(F.avg(d), 6).alias("delta_hr"), F.round(F.avg(F.col("n1") - F.col("n0")), 6).alias("delta_ndcg"), F.round(F.stddev_samp(F.col("n1") - F.col("n0")) * 1.96 / F.sqrt(F.count("*")), 6).alias("ndcg_half_width"), F.max("bad").alias("bad"))
    return out.select("users", "gained", "lost", "delta_hr", "delta_ndcg", "ndcg_half_width", F.when(F.col("bad") == 1, F.raise_error(F.lit("the two sides have different users"))).otherwise(F.lit(True)).alias("aligned"))


def bootstrap_interval(gained: int, lost: int, users: int, draws: int = 10_000, seed: int = 20) -> tuple[float, float]:
    """95 % interval of the change of hit rate: a multinomial of the three counts, whatever the number of users."""
    rng = np.random.default_rng(seed)
    x = rng.multinomial(users, np.array([gained, lost, users - gained - lost]) / users, size=draws)
    lo, hi = np.quantile((x[:, 0] - x[:, 1]) / users, [0.025, 0.975])
    return float(lo), float(hi)


#: Cumulative probabilities of a Poisson variable of mean 1, at 0, 1, and so on; a draw gives a row the number of those below its hash.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def scrambled(h: np.ndarray) -> np.ndarray:
    """The 32-bit finalizer of MurmurHash3."""
    h = h & np.uint64(0xFFFFFFFF)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & np.uint64(0xFFFFFFFF)
    return h ^ (h >> np.uint64(16))


def resampled(rows: DataFrame, columns: Sequence[str], draws: int, seed: int = 20, key: str = "user_id") -> DataFrame:
    """Bootstrap means: ``draw`` and the mean of each column in it.

    Row and draw are hashed to a Poisson weight of mean 1, which stands for how often the row would be drawn: any partitioning and any rerun give the same, no row is copied, and a task
    gives one row a draw. ``key`` is a whole number that tells rows apart (hash others first).
    """
    step = max(1, 2_000_000 // draws)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
        size, total = np.zeros(draws), np.zeros((draws, len(columns)))
        for batch in it:
            own = scrambled(batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(seed))
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            for lo in range(0, len(own), step):
                u = (scrambled(own[lo : lo + step, None] + number) + 0.5) / 2.0**32
                w = np.searchsorted(POISSON, u.ravel()).reshape(u.shape).astype(float)
                size += w.sum(axis=0)
                total += w.T @ x[lo : lo + step]
        yield pa.RecordBatch.from_arrays([pa.array(range(draws), pa.int32()), pa.array(size), *(pa.array(total[:, i]) for i in range(len(columns)))], names=["draw", "size", *columns])

    parts = rows.select(F.col(key).cast("long"), *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, f"draw int, size double, {', '.join(f'`{c}` double' for c in columns)}")
    sums = parts.groupBy("draw").agg(F.sum("size").alias("size"), *[F.sum(c).alias(c) for c in columns])
    return sums.where("size > 0").select("draw", *[(F.col(c) / F.col("size")).alias(c) for c in columns])


def bootstrap(rows: DataFrame, columns: Sequence[str], draws: int = 1000, alpha: float = 0.0125, seed: int = 20, key: str = "user_id") -> DataFrame:
    """``metric, users, mean, low, high`` of every column: its mean and the ``alpha`` and 1 - ``alpha`` quantiles of its bootstrap means. Without rows all are 0."""
    one = lambda c: F.percentile(c, F.array(F.lit(alpha), F.lit(1 - alpha))).alias(f"_{c}")
    ends = resampled(rows, columns, draws, seed, key).agg(*[one(c) for c in columns])
    means = rows.agg(F.count("*").alias("users"), *[F.avg(c).alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("metric"), "users", F.col(c).alias("mean"), F.col(f"_{c}")[0].alias("low"), F.col(f"_{c}")[1].alias("high")) for c in columns])
    return means.crossJoin(ends).select(F.explode(each).alias("x")).select("x.*").na.fill(0.0, ["mean", "low", "high"])


def acceptance(deltas: DataFrame, least: float = 0.0005, draws: int = 1000, alpha: float = 0.0125, seed: int = 20) -> DataFrame:
    """Whether a challenger is accepted over runs of several seeds: ``deltas(seed, cohort, user_id, hr, ndcg)``, differences of a user's metrics, cohort screen or confirm.

    Six conditions, a column each: the mean over seeds of the screening hit rates is above 0, of their NDCG not below; every seed's confirming hit rate is above 0, their mean at least ``least``, the
    lower end of the bootstrap interval of users' means over seeds above 0, and the mean confirming NDCG not below 0. A cohort without rows fails its conditions.
    """
    per = deltas.groupBy("cohort", "seed").agg(F.avg("hr").alias("hr"), F.avg("ndcg").alias("ndcg"))
    of = lambda f, cohort, c: f(F.when(F.col("cohort") == cohort, F.col(c)))
    means = per.agg(
        of(F.avg, "screen", "hr").alias("screen_hr"), of(F.avg, "screen", "ndcg").alias("screen_ndcg"), of(F.avg, "confirm", "hr").alias("confirm_hr"), of(F.avg, "confirm", "ndcg").alias("confirm_ndcg"),
        of(F.min, "confirm", "hr").alias("worst_hr"), of(F.stddev_samp, "confirm", "hr").alias("hr_spread"),
    )
    pooled = deltas.where("cohort = 'confirm'").groupBy("user_id").agg(F.avg("hr").alias("hr"), F.avg("ndcg").alias("ndcg"))
    ends = bootstrap(pooled, ["hr"], draws, alpha, seed).select("users", "low", "high")
    tests = {"screen_gains": F.col("screen_hr") > 0, "screen_holds": F.col("screen_ndcg") >= 0, "every_seed_gains": F.col("worst_hr") > 0, "gain_suffices": F.col("confirm_hr") >= least, "interval_gains": F.col("low") > 0, "confirm_holds": F.col("confirm_ndcg") >= 0}
    out = means.crossJoin(ends).withColumns({c: F.coalesce(x, F.lit(False)) for c, x in tests.items()})
    return out.withColumn("accepted", F.expr(" and ".join(tests)))


def pairwise_overlap(stacked: DataFrame, names: Sequence[str]) -> DataFrame:
    """Users' lists of every two channels: ``a, b, users, shared, mean_jaccard`` over the users with a list in either.

    A row an item with the channels that hold it, summed by user for all pairs at once: nothing is joined.
    """
    has = stacked.groupBy("user_id", "item_id").agg(*[F.max((F.col("channel") == n).cast("int")).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both, any_ = (lambda a, b: F.sum(F.col(a) * F.col(b)), lambda a, b: F.sum(F.greatest(a, b)))
    per = has.groupBy("user_id").agg(*[x for i, (a, b) in enumerate(pairs) for x in (both(a, b).alias(f"_s{i}"), any_(a, b).alias(f"_u{i}"))])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_s{i}").alias("s"), F.col(f"_u{i}").alias("u")) for i, (a, b) in enumerate(pairs)])
    x = per.select(F.explode(each).alias("x")).select("x.*").where("u > 0")
    return x.groupBy("a", "b").agg(F.count("*").alias("users"), F.sum("s").alias("shared"), F.round(F.avg(F.col("s") / F.col("u")), 6).alias("mean_jaccard"))


def by_category(users: DataFrame, dim: DataFrame) -> DataFrame:
    """Hit rate by the category of the user's target: ``users(user_id, hit, item_id)``, ``dim(item_id, category)``; unknown items are one group without a name."""
    return users.join(dim.select("item_id", "category"), "item_id", "left").groupBy("category").agg(F.count("*").alias("users"), F.round(F.avg("hit"), 6).alias("hr"))


def accepted(delta_hr: float, delta_ndcg: float) -> bool:
    """Hit rate strictly better and NDCG no worse."""
    return delta_hr > 0 and delta_ndcg >= 0


def by_groups(users: DataFrame) -> DataFrame:
    """Hit rate by history length and by popularity of the target: ``users(user_id, hit, history_length, popularity)``."""
    length = F.when(F.col("history_length") <= 5, "1-5").when(F.col("history_length") <= 20, "6-20").otherwise("21+")
    pop = F.when(F.col("popularity") == 0, "0").when(F.col("popularity") <= 5, "1-5").when(F.col("popularity") <= 50, "6-50").otherwise("51+")
    two = users.select("hit", F.explode(F.array(F.struct(F.lit("history_length").alias("kind"), length.alias("bin")), F.struct(F.lit("popularity").alias("kind"), pop.alias("bin")))).alias("g"))
    return two.groupBy("g.kind", "g.bin").agg(F.count("*").alias("users"), F.round(F.avg("hit"), 6).alias("hr"))


def verdict(hr: Column, ceiling: Column) -> Column:
    """Where to look next: at recall below a ceiling of 0.9, at ranking with a gap above 0.1."""
    return F.when(ceiling < 0.9, "recall").when(ceiling - hr > 0.1, "rank").otherwise("balanced")


def best_checkpoint(runs: DataFrame) -> DataFrame:
    """The run of highest (hr, ndcg), earliest step."""
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct("hr", "ndcg", -F.col("step"))).alias("x")).select("x.*")


def pool_audit(pool: DataFrame, seen: DataFrame, budget: int, catalogue: DataFrame) -> DataFrame:
    """Counts of users whose pool breaks a rule: size, duplicates, ids outside the catalogue, items already seen."""
    flag = lambda d, name: d.select(*[c for c in ("user_id", "item_id") if c in d.columns]).distinct().withColumn(name, F.lit(1))
    j = pool.join(flag(catalogue.select("item_id"), "_in"), "item_id", "left").join(flag(seen.select("user_id", "item_id"), "_seen"), ["user_id", "item_id"], "left")
    per = j.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("d"), F.max(F.col("_in").isNull().cast("int")).alias("out"), F.max(F.coalesce("_seen", F.lit(0))).alias("seen"))
    return per.agg(F.sum((F.col("n") != budget).cast("int")).alias("wrong_size"), F.sum((F.col("n") != F.col("d")).cast("int")).alias("repeated"), F.sum("out").alias("outside"), F.sum("seen").alias("seen"))


def embedding_health(vectors: DataFrame) -> DataFrame:
    """Norms of the vectors and the mean variance of their dimensions."""
    n = vectors.select(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"))
    norms = n.agg(F.round(F.avg("norm"), 6).alias("norm_mean"), F.round(F.stddev_pop("norm"), 6).alias("norm_std"), F.round(F.min("norm"), 6).alias("norm_min"), F.round(F.max("norm"), 6).alias("norm_max"))
    var = vectors.select(F.posexplode("embedding").alias("k", "x")).groupBy("k").agg(F.var_pop(F.col("x").cast("double")).alias("v")).agg(F.round(F.avg("v"), 6).alias("dim_variance"))
    return norms.crossJoin(var)


def reduced(df: DataFrame, stages: Mapping[str, DataFrame]) -> DataFrame:
    """Rows left after each stage."""
    out = df.agg(F.lit("all").alias("stage"), F.count("*").alias("rows"))
    for name, d in stages.items():
        out = out.unionByName(d.agg(F.lit(name).alias("stage"), F.count("*").alias("rows")))
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive hash of a table's content."""
    return df.agg(F.count("*").alias("rows"), F.bit_xor(lot(0, *df.columns)).alias("hash"))


def hash_tree(df: DataFrame, order: Sequence[str], leaf: int = 1024) -> DataFrame:
    """A hash tree over the rows in ``order``, which must be total: ``level, node, hash``.

    A leaf (level 0) holds ``leaf`` rows, each hashed with its place, so exchanged rows tell as changed ones do; a node above hashes its two children in order, up to one root. Two
    tables are equal in content and order if their roots are; :func:`first_difference` finds where they part. An empty table has no node.
    """
    rows = numbered(df, "_at", *order).withColumn("_at", F.col("_at") - 1)
    level = stored(rows.groupBy(F.floor(F.col("_at") / leaf).alias("node")).agg(F.bit_xor(lot(0, "_at", *df.columns)).alias("hash")), "leaves")
    out, n, height = level.select(F.lit(0).alias("level"), "node", "hash"), level.count(), 0
    while n > 1:
        pair = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"].cast("string"))).alias("both")
        level = level.groupBy(F.floor(F.col("node") / 2).alias("node")).agg(pair).select("node", lot(1, "both").alias("hash"))
        n, height = -(-n // 2), height + 1
        out = out.unionByName(level.select(F.lit(height).alias("level"), "node", "hash"))
    return out


def first_difference(a: DataFrame, b: DataFrame, leaf: int = 1024) -> tuple[int, int] | None:
    """Numbers (from 0, the end exclusive) of the first range of rows in which two hash trees differ, or None if they are equal."""
    leaves = a.where("level = 0").select("node", F.col("hash").alias("x")).join(b.where("level = 0").select("node", F.col("hash").alias("y")), "node", "full")
    node = leaves.where(~F.col("x").eqNullSafe(F.col("y"))).agg(F.min("node")).first()[0]
    return None if node is None else (node * leaf, (node + 1) * leaf)


def attribution(stacked: DataFrame, reach: DataFrame, targets: DataFrame, channels: list[str]) -> DataFrame:
    """What each channel, and their union (``all``), does for the targets: users and targets hit, targets it could reach without its cap, reachable
    ones beyond the cap, unreachable ones, and mean, least and greatest number of candidates of the users with targets.

    ``reach(channel, user_id, item_id)``: targets in the channel's uncapped set. A user's targets, candidates and reach meet by the user alone, so what is stored by user moves nothing.
    """
    # a bit for each channel, one more for what only the union counts
    bit = F.get(F.array(*[F.lit(1 << c) for c in (len(channels), *range(len(channels)))]), F.coalesce(F.array_position(F.array(*map(F.lit, channels)), F.col("channel")), F.lit(0)).cast("int"))
    want = targets.select("user_id", "item_id").where("user_id is not null").groupBy("user_id").agg(F.collect_set("item_id").alias("want"))
    have = stacked.withColumn("bit", bit).groupBy("user_id", "item_id").agg(F.bit_or("bit").alias("bits"))
    size = lambda c: F.sum(F.shiftright("bits", c).bitwiseAND(F.lit(1)))
    have = have.groupBy("user_id").agg(F.array(*[size(c) for c in range(len(channels))], F.count("*")).alias("sizes"), F.collect_list(F.struct("item_id", "bits")).alias("have"))
    can = reach.groupBy("user_id").agg(F.collect_set(F.struct("item_id", bit.alias("bits"))).alias("can"))
    users = want.join(have, "user_id", "left").join(can, "user_id", "left")

    def bits(rows: str, item: Column) -> Column:
        """In which channels ``rows`` have the item."""
        return F.aggregate(F.coalesce(F.filter(rows, lambda x: x["item_id"] == item), F.array()), F.lit(0), lambda s, x: s.bitwiseOR(x["bits"]))

    each = users.withColumn("each", F.transform("want", lambda i: F.struct(bits("have", i).alias("hit"), bits("can", i).alias("can"))))
    own = []
    for c, name in enumerate([*channels, "all"]):
        inside = (lambda b, c=c: F.shiftright(b, c).bitwiseAND(F.lit(1)) > 0) if c < len(channels) else (lambda b: b != 0)
        count = lambda f: F.size(F.filter("each", f)).cast("long")
        own.append(F.struct(
            F.lit(name).alias("channel"), count(lambda x: inside(x["hit"])).alias("hits"), count(lambda x: inside(x["can"])).alias("can"),
            count(lambda x: inside(x["can"]) & ~inside(x["hit"])).alias("outside"), F.size("want").cast("long").alias("targets"), F.coalesce(F.get("sizes", F.lit(c)), F.lit(0)).alias("n"),
        ))
    per = each.select(F.inline(F.array(*own)))
    return per.groupBy("channel").agg(
        F.count_if(F.col("hits") > 0).alias("users_hit"), F.sum("hits").alias("target_hits"), F.sum("can").alias("reachable"), F.sum("outside").alias("outside"), F.sum(F.col("targets") - F.col("can")).alias("unreachable"),
        F.round(F.avg("n"), 6).alias("mean_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"),
    )


def reach_by_length(classes: DataFrame, hist: DataFrame) -> DataFrame:
    """Users by history length, and how many of them have a target that a neighbour of the history reaches: ``hist_len, users, reached``."""
    length = hist.groupBy("user_id").agg(F.count("*").alias("hist_len"))
    per = classes.groupBy("user_id").agg(F.max(F.col("reach").isin("near", "edge").cast("int")).alias("any"))
    return per.join(length, "user_id").groupBy("hist_len").agg(F.count("*").alias("users"), F.sum("any").alias("reached"))


def grouped_delta(paired: DataFrame, group: Column, tolerance: float = 1e-12) -> DataFrame:
    """``paired(user_id, old, new)`` by group: users, share, means and mean difference; every user is in one group.

    The overall difference must be the groups' differences by their shares, else an error is raised in the rows.
    """
    g = paired.withColumn("grp", group)
    total = g.agg(F.count("*").alias("all_n"), F.avg(F.col("new") - F.col("old")).alias("overall"))
    out = g.groupBy("grp").agg(F.count("*").alias("users"), F.avg("old").alias("old_mean"), F.avg("new").alias("new_mean"), F.avg(F.col("new") - F.col("old")).alias("delta")).crossJoin(F.broadcast(total))
    share = F.col("users") / F.col("all_n")
    back = F.sum(F.col("delta") * share).over(Window.partitionBy(F.lit(0)))  # one row a group
    whole = F.when(F.col("grp").isNull() | (F.abs(back - F.col("overall")) > tolerance), F.raise_error(F.lit("groups do not give the overall difference"))).otherwise(share)
    return out.select("grp", "users", whole.cast("double").alias("share"), "old_mean", "new_mean", "delta")


def leave_last_out(positive: DataFrame, negative: DataFrame, k: int) -> DataFrame:
    """Share of (positive, negative) pairs of a user in the right order, ties half: ``positive(user_id, score)`` once a user, ``k`` rows of ``negative`` each.

    A user with another number of negatives raises an error in the row.
    """
    pair = positive.select("user_id", F.col("score").alias("p")).join(negative.select("user_id", F.col("score").alias("n")), "user_id", "left")
    won = F.when(F.col("p") > F.col("n"), 1.0).when(F.col("p") == F.col("n"), 0.5).otherwise(0.0)
    per = pair.groupBy("user_id").agg(F.first("p").alias("p"), F.count("n").alias("n"), F.avg(won).alias("auc"))
    whole = F.when(F.max((F.col("n") != k).cast("int")) == 1, F.raise_error(F.lit(f"a user has not {k} negatives")).cast("double")).otherwise(F.round(F.avg("auc"), 6))
    return per.agg(whole.alias("auc"), F.round(F.avg("p"), 6).alias("pos_mean"), F.count("*").alias("users"))


def pool_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """How pools of the same users differ: shared, added, removed, Jaccard (1 where both are empty), equal order, equal set, and changed members of ranks 11 to 25 and 26 to 50."""

    def lists(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias(name))

    none = F.array().cast("array<bigint>")
    j = lists(old, "x").join(lists(new, "y"), "user_id", "full").select(F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    band = lambda at, n: (~same(F.slice("x", at, n), F.slice("y", at, n))).cast("int")
    shared, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return j.agg(
        F.count("*").alias("users"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("same_order"), F.sum(same("x", "y").cast("int")).alias("same_set"),
        F.sum(shared).alias("shared"), F.sum(F.size(F.array_except("y", "x"))).alias("added"), F.sum(F.size(F.array_except("x", "y"))).alias("removed"),
        F.round(F.avg(F.when(union > 0, shared / union).otherwise(1.0)), 6).alias("jaccard"), F.sum(band(11, 15)).alias("changed_11_25"), F.sum(band(26, 25)).alias("changed_26_50"),
    )


def mean_cosine(vectors: DataFrame) -> DataFrame:
    """Mean cosine over all pairs of different vectors, from the sum of the unit vectors: (|sum|^2 - n) / (n (n - 1)); no pair is formed."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.withColumn("_n", norm).where("_n > 0").select("vec_id", F.posexplode("embedding").alias("k", "x"), "_n")
    per = unit.groupBy("k").agg(F.sum(F.col("x") / F.col("_n")).alias("s"), F.count("*").alias("n"))
    total = per.agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.max("n").cast("double").alias("n"))
    return total.select(F.col("n").cast("bigint").alias("vectors"), F.when(F.col("n") > 1, F.round((F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6)).alias("mean_cosine"))
