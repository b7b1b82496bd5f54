"""Samples of training: candidate pools and negatives of every training position, prefix streams, spectral factors.

A sample is an event with strictly earlier ones, as :func:`tidewheel.operators.sequence.prefix_windows` gives them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .channels import longest
from .grouped import LAID_OUT, channel_lists, fused, in_order, laid, places, with_lists
from .sampling import uniform
from .sequence import by_user, earlier, prefix_windows, whole
from .shared import lot, numbered, stored


#: Samples of a user that are in one group at most, counted by what came before them; events of a group, about.
SAMPLE_BLOCK, GROUP_EVENTS = 4096, 2048


def training_pools(train: DataFrame, sim: DataFrame, dim: DataFrame, hot: DataFrame, weights: Mapping[str, float], budget: int = 75, half_life: float = 180.0, n: int = 50, top: int = 3, each: int = 20, first: int = 5, k: int = 60, parts: int | None = None) -> DataFrame:
    """A fused pool for every training sample: ``user_id, target, item_id, score, rank``.

    Histories and exclusions are of the strict prefix; similarities and popularity are of all of ``train``, so the pools
    are not causal in those. The vector channel is empty. Popular lists are read to the depth that what the user met proves enough.

    An event goes to its user once, with its item's neighbours in two arrays; so do popular lists, as broadcast rows of ids, after that. All pools of about ``GROUP_EVENTS`` events are made where these
    land, one for each time of a user, and nothing of them is sent. The groups are dealt out into ``parts``. Samples of a very active user are dealt into blocks of ``SAMPLE_BLOCK``, which get the neighbours of their own windows and of what came before only ids.
    """
    block = lambda c: F.floor(F.col(c) / SAMPLE_BLOCK).cast("int")
    ev = train.select("user_id", "item_id", "ts").withColumn("e", F.row_number().over(by_user())).withColumn("before", F.count("*").over(earlier()))
    ev = ev.withColumn("_n", F.count("*").over(whole())).withColumn("_last", F.max("before").over(whole())).where("_last > 0")
    groups = max(1, train.count() // GROUP_EVENTS)
    ev = ev.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(block("before"), block("_last"))))
    inside = F.col("block").between(block("e"), F.floor((F.col("e") + n - 1) / SAMPLE_BLOCK))
    rows = with_lists(ev.withColumn("inside", inside), ("part", "block"), sim, dim, hot, budget, each, longest(train), parts)

    def pools(t: pa.Table) -> Iterator[pa.Table]:
        t, who, base = in_order(t)
        before, block = (t.column(c).to_numpy(zero_copy_only=False) for c in ("before", "block"))
        # one pool for each time of a user; its targets are that time's events
        target = np.flatnonzero((before > 0) & (before // SAMPLE_BLOCK == block))
        new = np.r_[True, (who[target][1:] != who[target][:-1]) | (before[target][1:] != before[target][:-1])][: len(target)]
        one, of_target = target[new], np.cumsum(new) - 1
        if not len(one):
            return
        users, items = t.column("user_id"), t.column("item_id")
        for asks, item, lists in channel_lists(t, who, base, who[one], before[one], budget, half_life, n, top, each, first):
            s, c, score = fused(lists, len(item), weights, budget, k)
            size = np.bincount(s, minlength=len(asks))
            start, place = np.cumsum(size) - size, places(s)
            mine = np.arange(*np.searchsorted(of_target, [asks[0], asks[-1] + 1]))
            for few in np.array_split(mine, max(1, len(mine) * budget // LAID_OUT)):
                x = of_target[few] - asks[0]
                of, at = laid(start[x], size[x])
                where = pa.array(target[few][of])
                yield pa.table({"user_id": users.take(where), "target": items.take(where), "item_id": pa.array(item[c[at]], t.schema.field("item_id").type), "score": score[at], "rank": pa.array(place[at], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in pools(pa.Table.from_batches(list(batches))):
            yield from out.combine_chunks().to_batches()

    kinds_of = dict(train.dtypes)
    return rows.groupBy("part", "block").applyInArrow(run, f"user_id {kinds_of['user_id']}, target {kinds_of['item_id']}, item_id {kinds_of['item_id']}, score double, rank int")


def recall_negatives(pool: DataFrame, active: DataFrame, known: DataFrame) -> DataFrame:
    """Of pools from an inner split, the active items that the user doesn't know in the outer one: ``user_id, item_id, rank``."""
    out = pool.join(active.select("item_id").distinct(), "item_id", "left_semi").join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return out.select("user_id", "item_id", "rank")


def candidate_negatives(eligible: DataFrame, rand: DataFrame, k: int = 4, hard: int = 1, seed: int = 0) -> DataFrame:
    """``hard`` of the eligible recall negatives by hash, then random ones, ``k`` distinct a user: ``user_id, item_id, hard, place``."""
    w = Window.partitionBy("user_id").orderBy(lot(seed, "user_id", "item_id"), "item_id")
    h = eligible.withColumn("n", F.row_number().over(w)).where(F.col("n") <= hard).select("user_id", "item_id", F.lit(0).alias("tier"), "n")
    both = h.unionByName(rand.select("user_id", "item_id", F.lit(1).alias("tier"), F.col("place").alias("n")))
    one = both.groupBy("user_id", "item_id").agg(F.min(F.struct("tier", "n")).alias("at"))
    one = one.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "item_id"))).where(F.col("place") <= k)
    return one.select("user_id", "item_id", (F.col("at.tier") == 0).alias("hard"), "place")


#: Ids of a catalogue's order that go to every task at most, in rows of ``IDS`` of them; known items of a user that are looked through for each draw.
LISTED, IDS, LOOKED_THROUGH = 8_000_000, 1 << 8, 4096


def known_lists(known: DataFrame) -> DataFrame:
    """``user_id, skip``: a user's known items in one array."""
    return known.groupBy("user_id").agg(F.collect_set("item_id").alias("skip"))


def fixed_pools(samples: DataFrame, catalogue: DataFrame, known: DataFrame, width: int = 16, seed: int = 0) -> DataFrame:
    """``items``: ``width`` distinct unknown items for each sample (``user_id, target``), the same on every run.

    Each sample draws hashed places of a hashed order; repeated and known items fall out. The few samples that lack items
    after that walk on from a hashed place until they have enough or have seen the whole catalogue.

    The first ``width`` draws nearly always suffice. Up to ``LISTED`` items they are made and looked up where the sample's user is, in the order as a broadcast list of ids, so no draw is sent
    anywhere; samples that lack items then, those of users with more than ``LOOKED_THROUGH`` known items, and all samples of a larger catalogue draw by joins (:func:`drawn_by_joins`).
    """
    order = stored(numbered(catalogue.select("item_id").distinct(), "at", lot(seed, "item_id"), F.col("item_id")), "order")
    size = order.count()
    s = samples.select("user_id", "target").distinct()
    if not 0 < size <= LISTED:
        return drawn_by_joins(s, order, known, width, seed)
    own = lambda c, n: (F.floor((F.col(c) - 1) / IDS)).cast("int").alias(n)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "item_id"))), lambda x: x["item_id"]).alias("ids")
    lists = F.broadcast(order.groupBy(own("at", "list")).agg(ids))
    # an array of places, laid out: each place is hashed once, however often what follows names it
    tries = F.sequence(F.lit(1), F.when(F.coalesce(F.size("skip"), F.lit(0)) <= LOOKED_THROUGH, width).otherwise(1))
    places = F.transform(tries, lambda d: lot(seed + 1, "user_id", "target", d) % F.lit(size) + 1)
    draws = s.join(known_lists(known), "user_id", "left").select("user_id", "target", "skip", F.posexplode(places).alias("draw", "at"))
    met = draws.withColumn("list", own("at", "list")).join(lists, "list").withColumn("item_id", F.get("ids", ((F.col("at") - 1) % IDS).cast("int")))
    fit = (F.col("item_id") != F.col("target")) & ~F.coalesce(F.array_contains("skip", F.col("item_id")), F.lit(False))
    got = met.groupBy("user_id", "target").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(fit, F.struct("draw", "item_id")))), lambda x: x["item_id"])).alias("items"))
    got = stored(got, "draws")
    short = got.where(F.size("items") < width).select("user_id", "target")
    return got.where(F.size("items") == width).unionByName(drawn_by_joins(short, order, known, width, seed))


def drawn_by_joins(s: DataFrame, order: DataFrame, known: DataFrame, width: int, seed: int) -> DataFrame:
    """The pools of :func:`fixed_pools` for the samples ``s`` by joins with the ``order(item_id, at)``, however large it is."""
    size = order.agg(F.count("*").alias("size"))
    s = s.crossJoin(F.broadcast(size))
    known = known.select("user_id", "item_id").distinct()
    draws = s.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(2 * width + 8))))
    draws = draws.withColumn("at", lot(seed + 1, "user_id", "target", "draw") % F.col("size") + 1)
    key = ["user_id", "target"]
    got = draws.join(order, "at").groupBy(*key, "item_id").agg(F.min("draw").alias("n")).where("item_id <> target").join(known, ["user_id", "item_id"], "left_anti")
    got = stored(got.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("n"))).where(F.col("place") <= width).select(*key, "item_id", "place"), "draws")
    short = s.join(got.groupBy(*key).agg(F.count("*").alias("got")), key, "left").na.fill(0, ["got"]).where(F.col("got") < width)
    short = short.join(known.groupBy("user_id").agg(F.count("*").alias("known_n")), "user_id", "left").na.fill(0, ["known_n"])
    steps = short.withColumn("step", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.col("known_n") + 2 * width + 1).cast("int") - 1)))
    steps = steps.withColumn("at", (lot(seed + 2, *key) % F.col("size") + F.col("step")) % F.col("size") + 1)
    rest = steps.join(order, "at").where("item_id <> target").join(known, ["user_id", "item_id"], "left_anti").join(got.select(*key, "item_id"), [*key, "item_id"], "left_anti")
    rest = rest.withColumn("place", F.col("got").cast("int") + F.row_number().over(Window.partitionBy(*key).orderBy("step"))).where(F.col("place") <= width)
    all_ = got.unionByName(rest.select(*key, "item_id", "place"))
    return all_.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id"))), lambda x: x["item_id"]).alias("items"))


def pool_prefix(pools: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The first ``k`` items of each fixed pool as ``items``; a pool that is short, repeats, or holds a known item or the target raises an error in its row."""
    cut = pools.select("user_id", "target", F.slice("items", 1, k).alias("items")).join(known_lists(known), "user_id", "left")
    wrong = F.coalesce(F.arrays_overlap("items", "skip"), F.lit(False)) | (F.size(F.array_distinct("items")) != k) | F.array_contains("items", F.col("target"))
    return cut.select("user_id", "target", F.when(wrong, F.raise_error(F.lit("fixed pool holds an invalid negative")).cast("array<bigint>")).otherwise(F.col("items")).alias("items"))


def prefix_stream(train: DataFrame, pools: DataFrame, n: int = 50, pad: int = 0) -> DataFrame:
    """One row a sample: ``user_id, target, ts, hist_len, items`` (the last ``n``, padded on the right), prefix rating mean and deviation, ``negatives``."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ts", "item_id"))), lambda x: x["item_id"])
    per = prefix_windows(train, n).groupBy("sample", "hist_len").agg(items.alias("items"), F.avg("rating").alias("rating_mean"), F.stddev_pop("rating").alias("rating_std"))
    rows = per.select("sample.user_id", "sample.target", F.col("sample.at").alias("ts"), "hist_len", F.concat("items", F.array_repeat(F.lit(pad).cast("bigint"), F.lit(n) - F.size("items"))).alias("items"), "rating_mean", "rating_std")
    return rows.join(pools.select("user_id", "target", F.col("items").alias("negatives")), ["user_id", "target"])


def svd_factors(train: DataFrame, dim: int = 16, rounds: int = 4, seed: int = 0, spare: int = 8) -> tuple[DataFrame, list[float]]:
    """Item factors of a truncated singular value decomposition of the binary user-item matrix, and its singular values.

    ``item_id, embedding`` (unit length; null for items outside the ``dim`` leading directions). Block power iteration: each half round is a join
    with the log and sums by item or user; only Gram matrices, ``dim + spare`` squared, reach the driver. Signs and rotations within equal values are arbitrary.
    """
    width = dim + spare
    cols = [f"x{i}" for i in range(width)]
    kind = dict(train.dtypes)["item_id"]
    log = stored(train.select("user_id", "item_id").distinct(), "log")

    def table(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(c).to_numpy() for c in cols])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sum((x.T @ x for x in map(table, batches)), np.zeros((width, width)))
        i, j = np.indices(g.shape, dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "v": g.ravel()})

    def gram(d: DataFrame) -> np.ndarray:
        g = np.zeros((width, width))
        for r in d.select(*cols).mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            g[r["i"], r["j"]] = r["v"]
        return g

    def turned(d: DataFrame, m: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = table(batch) @ m
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), *(pa.array(x[:, k]) for k in range(width))], ["item_id", *cols])

        return d.select("item_id", *cols).mapInArrow(run, ", ".join([f"item_id {kind}", *(f"{c} double" for c in cols)]))

    def white(d: DataFrame) -> DataFrame:
        value, vec = np.linalg.eigh(gram(d))
        scale = np.where(value > max(value.max(), 0.0) * 1e-12, 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
        return turned(d, vec * scale)

    sums = [F.sum(c).alias(c) for c in cols]
    q = log.select("item_id").distinct().select("item_id", *[(uniform(seed + i, "item_id") - 0.5).alias(c) for i, c in enumerate(cols)])
    for _ in range(rounds):
        u = log.join(white(q), "item_id").groupBy("user_id").agg(*sums)
        q = stored(log.join(u, "user_id").groupBy("item_id").agg(*sums), "factors")
    q = stored(white(q), "factors")
    value, vec = np.linalg.eigh(gram(log.join(q, "item_id").groupBy("user_id").agg(*sums)))
    out = turned(q, vec[:, ::-1])
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols[:dim]), F.lit(0.0)))
    unit = F.when(norm > 1e-12, F.array(*[F.col(c) / norm for c in cols[:dim]]))
    return out.select("item_id", unit.alias("embedding")), [float(x) for x in np.sqrt(np.maximum(value[::-1], 0.0))[:dim]]
