"""Ordered sequences: positions, strict-earlier histories, splits, gaps and prefix statistics.

A user's events are ordered by (ts, item_id), a total order after first-interaction dedupe. Events at the same time never see
each other: histories are RANGE frames on ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY_MS = 86_400_000.0


def by_user() -> WindowSpec:
    """A user's events in order."""
    return Window.partitionBy("user_id").orderBy("ts", "item_id")


def whole() -> WindowSpec:
    """All of a user's events."""
    return Window.partitionBy("user_id")


def earlier() -> WindowSpec:
    """A user's events at strictly earlier times."""
    return Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)


def positions(df: DataFrame) -> DataFrame:
    """``pos`` from 0 and the user's number of events ``n``."""
    return df.withColumn("pos", F.row_number().over(by_user()) - 1).withColumn("n", F.count("*").over(whole()))


def strict_history(df: DataFrame) -> DataFrame:
    """Size, items and last time of what came strictly earlier, for every event."""
    return df.withColumn("hist_len", F.count("*").over(earlier())).withColumn("hist_last_ts", F.max("ts").over(earlier()))


def ratio_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """``split``: train for the first ``share`` of a user's events (one at least), val for the rest."""
    seq = positions(df)
    return seq.withColumn("split", F.when(F.col("pos") < F.greatest(F.lit(1), F.floor(F.col("n") * share)), "train").otherwise("val"))


def leave_two_out(df: DataFrame) -> DataFrame:
    """``split`` train, val, test or rest.

    A user with 3 events whose last two come at later times than the first and one another is eligible: val and test
    are those two, train is what is earlier than val. Other users are train as a whole.
    """
    seq = positions(df)
    at = lambda back: F.max(F.when(F.col("pos") == F.col("n") - back, F.col("ts"))).over(whole())
    seq = seq.withColumns({"val_ts": at(2), "test_ts": at(1), "first_ts": F.min("ts").over(whole())})
    ok = (F.col("n") >= 3) & (F.col("val_ts") > F.col("first_ts")) & (F.col("test_ts") > F.col("val_ts"))
    part = F.when(~ok, "train").when(F.col("pos") == F.col("n") - 2, "val").when(F.col("pos") == F.col("n") - 1, "test").when(F.col("ts") < F.col("val_ts"), "train").otherwise("rest")
    return seq.withColumns({"eligible": ok, "split": part})


def future_window(df: DataFrame) -> DataFrame:
    """``split`` train or target: the last fifth of a user's events, from the first event at the time the cut falls on.

    Users with one event, or with nothing before the cut, are train as a whole.
    """
    seq = positions(df)
    cut = F.least(F.greatest(F.expr("n * 4 div 5"), F.lit(1)), F.col("n") - 1)
    seq = seq.withColumn("cut_ts", F.max(F.when(F.col("pos") == cut, F.col("ts"))).over(whole())).withColumn("first_ts", F.min("ts").over(whole()))
    ok = (F.col("n") >= 2) & (F.col("cut_ts") > F.col("first_ts"))
    return seq.withColumns({"eligible": ok, "split": F.when(ok & (F.col("ts") >= F.col("cut_ts")), "target").otherwise("train")})


def debug_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """As :func:`ratio_split`, without users whose tail is empty."""
    return ratio_split(df, share).where(F.col("n") > F.greatest(F.lit(1), F.floor(F.col("n") * share)))


def train_samples(train: DataFrame) -> DataFrame:
    """Events later than the user's first time: those with a history to learn from."""
    return train.withColumn("_first", F.min("ts").over(whole())).where("ts > _first").drop("_first")


def last_events(df: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` events of every user, ``back`` counting from 1 at the latest."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("item_id").desc())
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def padded(df: DataFrame, n: int = 50, pad: int = 0) -> DataFrame:
    """The last ``n`` items of every user in order, padded on the right, and ``hist_len``."""
    lists = last_events(df, n).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "item_id"))), lambda x: x["item_id"]).alias("items"))
    return lists.select("user_id", F.size("items").alias("hist_len"), F.concat("items", F.array_repeat(F.lit(pad).cast("bigint"), F.lit(n) - F.size("items"))).alias("items"))


def gaps(df: DataFrame, n: int = 50) -> DataFrame:
    """Days since the event before, 0 for the first, over a month and at most a year; among the last ``n``."""
    g = F.coalesce((F.col("ts") - F.lag("ts").over(by_user())) / DAY_MS, F.lit(0.0))
    return last_events(df, n).withColumn("gap", F.least(g / 30, F.lit(365 / 30)))


def legacy_gaps(df: DataFrame, n: int = 50) -> DataFrame:
    """Days since the event before, at most 365, over the user's largest (1 if that is 0)."""
    g = F.least(F.coalesce((F.col("ts") - F.lag("ts").over(by_user())) / DAY_MS, F.lit(0.0)), F.lit(365.0))
    top = F.max("_g").over(whole())
    return last_events(df, n).withColumn("_g", g).withColumn("gap", F.col("_g") / (F.when(top == 0, 1.0).otherwise(top) + 1e-8)).drop("_g")


def recency(df: DataFrame, rate: float) -> DataFrame:
    """Weight exp(-rate * gaps still to come) of every event, over its user's sum (1 at least)."""
    after = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("item_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    w = F.exp(-F.lit(rate) * F.coalesce(F.sum("gap").over(after), F.lit(0.0)))
    return df.withColumn("_w", w).withColumn("recency", F.col("_w") / F.greatest(F.lit(1.0), F.sum("_w").over(whole()))).drop("_w")


def prefix_windows(df: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` events strictly before each event that has any: ``sample, hist_len, item_id, ts, rating``.

    ``sample`` is a struct ``user_id, target, at, e`` of the event, ``hist_len`` all that came before. Events are numbered and
    each asks for ``n`` numbers, an equal join; so rows grow with events, not with the square of a user's.
    """
    ev = df.select("user_id", "item_id", "ts", "rating").withColumn("e", F.row_number().over(by_user())).withColumn("hist_len", F.count("*").over(earlier()))
    sample = F.struct("user_id", F.col("item_id").alias("target"), F.col("ts").alias("at"), "e").alias("sample")
    last = F.col("hist_len").cast("int")
    ask = ev.where("hist_len > 0").select("user_id", sample, "hist_len", F.explode(F.sequence(F.greatest(F.lit(1), last - n + 1), last)).alias("e"))
    return ask.join(ev.select("user_id", "e", "item_id", "ts", "rating"), ["user_id", "e"]).select("sample", "hist_len", "item_id", "ts", "rating")


def prefix_statistics(df: DataFrame, count_scale: float, span_scale: float, n: int = 50) -> DataFrame:
    """Log count of the strict prefix, and log span, mean and population deviation of rating over its last ``n`` events."""
    per = prefix_windows(df, n).groupBy("sample", "hist_len").agg((F.max("ts") - F.min("ts")).alias("span"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"))
    return per.select(
        "sample.user_id", F.col("sample.target").alias("item_id"), F.col("sample.at").alias("ts"), (F.log1p("hist_len") / count_scale).alias("count_feature"),
        (F.log1p(F.col("span") / DAY_MS) / span_scale).alias("span_feature"), (F.col("mean") / 5).alias("rating_mean"), (F.col("std") / 2).alias("rating_std"),
    )


def spaced(df: DataFrame, k: int) -> DataFrame:
    """``k`` rows at even spacing of a table numbered by ``pos`` from 0: the first, the last and between."""
    at = df.agg(F.max("pos").alias("last")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("last") / (k - 1)))).alias("pos")).distinct()
    return df.join(F.broadcast(at), "pos", "left_semi")


def intervals(events: DataFrame, bounds: DataFrame, key: str = "user_id", at: str = "pos") -> DataFrame:
    """``events`` with ``interval``: the number of ``bounds(key, bound)`` at or before ``at`` within the key, from 0.

    Events and bounds are merged in one order of each key and the bounds are counted as they pass, so no event is paired with a bound.
    """
    kind = dict(events.dtypes)[at]
    both = events.withColumn("_at", F.col(at)).withColumn("_tier", F.lit(1)).unionByName(bounds.select(key, F.col("bound").cast(kind).alias("_at"), F.lit(0).alias("_tier")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_tier").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("interval", F.sum(1 - F.col("_tier")).over(w).cast("int")).where("_tier = 1").drop("_at", "_tier")


def latest_history(df: DataFrame, n: int = 50) -> DataFrame:
    """Every user's number of events and last ``n`` items by (ts, item_id), newest first: ``user_id, events, items``. Nothing is cut off: the last event counts."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("item_id").desc()))
    kept = df.select("user_id", "item_id", "ts").withColumn("_back", back).withColumn("_n", F.count("*").over(whole())).where(F.col("_back") <= n)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_back", "item_id"))), lambda x: x["item_id"])
    return kept.groupBy("user_id").agg(F.first("_n").alias("events"), items.alias("items"))
