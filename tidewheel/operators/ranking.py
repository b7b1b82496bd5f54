"""Rerankers with a user side: target attention over a user's history, and losses of batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import last_events
from .shared import nine, numbered

#: Users of one group, and candidates that are scored together.
BLOCK_USERS, MICROBATCH = 64, 512


@dataclass(frozen=True)
class TargetAttention:
    """Parameters of a scorer over item vectors of ``d`` entries and ``f`` user features.

    How much a past item h counts for a candidate v: ``unit_out`` . relu(``past`` h + ``target`` v + ``both`` (h * v) + ``unit_bias``), a row a unit. The interest is the mean of the past
    items so weighted; the score is ``out`` . relu(``item`` v + ``interest`` i + ``cross`` (u * v) + ``user`` x + ``bias``) with the mean u of the past items and the features x.
    """

    past: np.ndarray
    target: np.ndarray
    both: np.ndarray
    unit_bias: np.ndarray
    unit_out: np.ndarray
    item: np.ndarray
    interest: np.ndarray
    cross: np.ndarray
    user: np.ndarray
    bias: np.ndarray
    out: np.ndarray

    @classmethod
    def by_rule(cls, d: int, f: int, units: int = 2, hidden: int = 2) -> TargetAttention:
        """Fixed parameters without training: sines of consecutive numbers over the root of their row's length."""
        start = 0

        def take(rows: int, columns: int) -> np.ndarray:
            nonlocal start
            x = np.sin(np.arange(start + 1, start + 1 + rows * columns, dtype=float)).reshape(rows, columns) / np.sqrt(columns)
            start += rows * columns
            return x

        past, target, both = (take(units, d) for _ in range(3))
        unit_bias, unit_out = take(units, 1)[:, 0], take(units, 1)[:, 0]
        item, interest, cross = (take(hidden, d) for _ in range(3))
        return cls(past, target, both, unit_bias, unit_out, item, interest, cross, take(hidden, f), take(hidden, 1)[:, 0], take(hidden, 1)[:, 0])

    def encode(self, history: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
        """What doesn't depend on the candidate, once a user: past items, their part of each unit, their weights on a candidate's entries, the mean, the features' part of each hidden unit."""
        mean = history.mean(axis=0) if len(history) else np.zeros(self.item.shape[1])
        return history, history @ self.past.T + self.unit_bias, (history[:, None, :] * self.both).reshape(-1, self.both.shape[1]), mean, self.user @ features + self.bias

    def score(self, user: tuple[np.ndarray, ...], items: np.ndarray) -> np.ndarray:
        """Scores of the candidates ``items`` of an encoded user."""
        history, base, weights, mean, given = user
        n, units = base.shape
        interest = np.zeros_like(items)
        if n:
            z = (items @ weights.T).reshape(len(items), n, units) + base + (items @ self.target.T)[:, None, :]
            interest = np.maximum(z, 0) @ self.unit_out @ history / n
        hidden = items @ self.item.T + interest @ self.interest.T + (items * mean) @ self.cross.T + given
        return np.maximum(hidden, 0) @ self.out


def attention_rank(pool: DataFrame, history: DataFrame, vectors: DataFrame, features: DataFrame, model: TargetAttention, k: int, n: int = 50, microbatch: int = MICROBATCH) -> DataFrame:
    """The ``k`` candidates of every user of ``pool`` with the highest scores, ties to smaller ids: ``user_id, item_id, score, rank``.

    ``vectors(item_id, v)``, ``features(user_id, x)``. A user's last ``n`` events with a vector are encoded once and all candidates are scored against that,
    ``microbatch`` at a time. A candidate without a vector counts as zeros, so does a user without features; a user without history has no interest.
    Users are dealt into groups by hash; a task holds one group.
    """
    d, f = model.item.shape[1], model.user.shape[1]
    own = vectors.select("item_id", F.col("v").cast("array<double>").alias("v"))
    late = last_events(history, n).select("user_id", "item_id").join(own, "item_id").select("user_id", F.lit(0).alias("kind"), "item_id", "v")
    cand = pool.select("user_id", "item_id").distinct().join(own, "item_id", "left").select("user_id", F.lit(1).alias("kind"), "item_id", "v")
    about = features.select("user_id", F.lit(2).alias("kind"), F.lit(None).cast(dict(pool.dtypes)["item_id"]).alias("item_id"), F.col("x").cast("array<double>").alias("v"))
    users = pool.agg(F.approx_count_distinct("user_id")).first()[0]  # only how many groups there are follows from it
    rows = late.unionByName(cand).unionByName(about).withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(max(1, users // BLOCK_USERS))))
    kinds = dict(pool.dtypes)

    def run(t: pa.Table) -> pa.Table:
        who = np.unique(t.column("user_id").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        kind = t.column("kind").to_numpy()
        v = t.column("v").combine_chunks()
        at, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
        item = t.column("item_id").to_numpy(zero_copy_only=False)
        table = lambda r, width: np.array([flat[at[i] : at[i + 1]] if at[i + 1] - at[i] == width else np.zeros(width) for i in r]).reshape(-1, width)
        rows, value = [np.zeros(0, np.int64)], [np.zeros(0)]
        order = np.argsort(who, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(who[order])) + 1):
            of = lambda x: mine[kind[mine] == x]  # noqa: B023, E731
            ask, given = of(1), table(of(2)[:1], f)
            if not len(ask):
                continue
            past = of(0)
            past = past[np.lexsort((item[past],))]
            user = model.encode(table(past, d), given[0] if len(given) else np.zeros(f))
            score = np.concatenate([model.score(user, table(ask[lo : lo + microbatch], d)) for lo in range(0, len(ask), microbatch)])
            best = np.lexsort((item[ask], -np.floor(score * 1e9 + 0.5)))[:k]
            rows.append(ask[best])
            value.append(score[best])
        got = pa.array(np.concatenate(rows).astype(np.int64))
        return pa.table({"user_id": t.column("user_id").take(got), "item_id": t.column("item_id").take(got), "score": np.concatenate(value)})

    found = rows.groupBy("block").applyInArrow(run, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(nine("score").desc(), "item_id")))


def sampled_softmax_loss(positive: Column, negatives: Column, temperature: float = 1.0) -> Column:
    """Cross entropy of a positive score among an array of sampled negatives: log of the sum of exponentials, taken at its greatest term, less the positive."""
    if not 0 < temperature < float("inf"):
        raise ValueError("the temperature must be finite and positive")
    pos, neg = positive / temperature, F.transform(negatives, lambda x: x / temperature)
    top = F.greatest(pos, F.coalesce(F.array_max(neg), pos))
    return top + F.ln(F.aggregate(neg, F.exp(pos - top), lambda s, x: s + F.exp(x - top))) - pos


def in_batch_loss(pairs: DataFrame, history: DataFrame, hard: DataFrame, temperature: float = 0.07, batch: int = 256, share: float = 0.3, seed: int = 0) -> DataFrame:
    """Contrastive loss of every pair with the other items of its batch, and with its hard negatives: ``user_id, item_id, batch, negatives, in_batch, hard, loss``.

    ``pairs(user_id, item_id, u, v)``: distinct pairs with the vectors of user and item; ``hard(item_id, w)``: vectors of an item's hard negatives. Pairs are put in the order of the md5 of seed, user and item and
    cut into batches. A batch is one group: its users by its items as one product, over ``temperature``; an item doesn't count against a pair of the same item or user or whose user has it in ``history``.
    ``negatives`` is how many count. ``loss`` is ``in_batch`` + ``share`` * ``hard``; without hard negatives ``hard`` is 0.
    """
    past = history.groupBy("user_id").agg(F.collect_set("item_id").alias("past"))
    more = hard.groupBy("item_id").agg(F.flatten(F.array_sort(F.collect_list(F.col("w").cast("array<double>")))).alias("hard"))
    vectors = pairs.select("user_id", "item_id", F.col("u").cast("array<double>").alias("u"), F.col("v").cast("array<double>").alias("v"))
    order = F.md5(F.concat_ws(":", F.lit(seed), "user_id", "item_id"))
    at = numbered(vectors.select("user_id", "item_id"), "_at", order, F.col("user_id"), F.col("item_id")).select("user_id", "item_id", F.floor((F.col("_at") - 1) / batch).cast("int").alias("batch"))
    rows = vectors.join(at, ["user_id", "item_id"]).join(past, "user_id", "left").join(more, "item_id", "left")
    kinds = dict(pairs.dtypes)

    def run(t: pa.Table) -> pa.Table:
        n = len(t)
        user, item = (t.column(c).to_numpy(zero_copy_only=False) for c in ("user_id", "item_id"))
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        u, v = flat("u").reshape(n, -1), flat("v").reshape(n, -1)
        logits = u @ v.T / temperature
        known = (item[:, None] == item) | (user[:, None] == user)
        seen, extra = t.column("past").to_pylist(), t.column("hard").to_pylist()
        for i, own in enumerate(seen):
            known[i] |= np.isin(item, np.array(own or [], item.dtype))
        np.fill_diagonal(known, False)
        value = np.where(known, -np.inf, logits)
        top = value.max(axis=1)
        main = top + np.log(np.exp(value - top[:, None]).sum(axis=1)) - np.diagonal(logits)
        other = np.zeros(n)
        for i, w in enumerate(extra):
            if w:
                x = np.append(logits[i, i], np.array(w).reshape(-1, v.shape[1]) @ u[i] / temperature)
                other[i] = x.max() + np.log(np.exp(x - x.max()).sum()) - x[0]
        return pa.table({"user_id": t.column("user_id"), "item_id": t.column("item_id"), "batch": t.column("batch"), "negatives": (~known).sum(axis=1) - 1, "in_batch": main, "hard": other, "loss": main + share * other})

    return rows.groupBy("batch").applyInArrow(run, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, batch int, negatives long, in_batch double, hard double, loss double")
