"""Samples of training: prefixes, negatives, factors, and the comparisons of pools, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import metrics, sequence, training


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(3)
    rows = {(u, int(i)): (int(rng.integers(0, 12)), float(rng.integers(1, 6))) for u in range(15) for i in rng.choice(40, 9, replace=False)}
    return spark.createDataFrame([(u, i, t, r) for (u, i), (t, r) in rows.items()], "user_id long, item_id long, ts long, rating double")


def test_prefix_windows_hold_the_last_strictly_earlier_events(events):
    rows = [tuple(r) for r in events.collect()]
    want = {}
    for u, i, t, _ in rows:
        before = sorted((t2, i2) for u2, i2, t2, _ in rows if u2 == u and t2 < t)
        if before:
            want[u, i] = (len(before), before[-3:])
    got = {}
    for r in sequence.prefix_windows(events, 3).collect():
        got.setdefault((r["sample"]["user_id"], r["sample"]["target"]), (r["hist_len"], []))[1].append((r["ts"], r["item_id"]))
    assert {k: (n, sorted(v)) for k, (n, v) in got.items()} == want


def test_fixed_pools_are_full_legal_and_repeat(spark, events):
    catalogue = spark.range(40).select(F.col("id").alias("item_id"))
    samples = events.select("user_id", F.col("item_id").alias("target"))
    known = {(r["user_id"], r["item_id"]) for r in events.collect()}
    pools = training.fixed_pools(samples, catalogue, events, 16)
    first = {(r["user_id"], r["target"]): list(r["items"]) for r in pools.collect()}
    assert len(first) == len(known)
    for (u, t), items in first.items():
        assert len(set(items)) == len(items) == 16 and t not in items and not any((u, i) in known for i in items)
    again = training.fixed_pools(samples.repartition(3), catalogue, events, 16)
    assert {(r["user_id"], r["target"]): list(r["items"]) for r in again.collect()} == first
    # 31 items are left to a user: a wider pool takes them all
    assert {len(r["items"]) for r in training.fixed_pools(samples, catalogue, events, 50).collect()} == {31}
    four = {(r["user_id"], r["target"]): list(r["items"]) for r in training.pool_prefix(pools, events, 4).collect()}
    assert four == {k: v[:4] for k, v in first.items()}
    bad = pools.withColumn("items", F.array_repeat(F.col("items")[0], 16))
    with pytest.raises(Exception, match="invalid negative"):
        training.pool_prefix(bad, events, 4).collect()


def test_candidate_negatives_put_hard_ones_first(spark):
    hard = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "user_id long, item_id long, rank int")
    rand = spark.createDataFrame([(u, i, p) for u in (1, 2) for p, i in enumerate((8, 11, 12, 13, 14), 1)], "user_id long, item_id long, place int")
    got = training.candidate_negatives(hard, rand, 4, 1).collect()
    for u, n_hard in ((1, 1), (2, 0)):
        own = sorted((r["place"], r["item_id"], r["hard"]) for r in got if r["user_id"] == u)
        assert len({i for _, i, _ in own}) == 4 and [h for _, _, h in own] == [True] * n_hard + [False] * (4 - n_hard)


def test_factors_span_the_leading_directions(spark):
    rng = np.random.default_rng(1)
    # three groups of users and items, and noise
    m = np.zeros((60, 30))
    for g in range(3):
        m[g * 20 : g * 20 + 20, g * 10 : g * 10 + 10] = rng.random((20, 10)) < 0.4 + 0.2 * g
    m[rng.random(m.shape) < 0.02] = 1
    m[0] = 1  # every item is met
    log = spark.createDataFrame([(int(u), int(i)) for u, i in np.argwhere(m)], "user_id long, item_id long")
    factors, values = training.svd_factors(log, dim=3, rounds=6, spare=5)
    _, s, vt = np.linalg.svd(m)
    assert np.allclose(values, s[:3], rtol=1e-3)
    got = np.array([r["embedding"] for r in factors.orderBy("item_id").collect()])
    want = vt[:3].T / np.linalg.norm(vt[:3].T, axis=1, keepdims=True)
    assert np.allclose(np.abs((got * want).sum(0)), np.abs((want * want).sum(0)), atol=0.05)


def test_leave_last_out_counts_ties_half_and_needs_all_negatives(spark):
    pos = spark.createDataFrame([(1, 0.5), (2, 0.1)], "user_id long, score double")
    neg = spark.createDataFrame([(1, 0.5), (1, 0.2), (2, 0.3), (2, 0.0)], "user_id long, score double")
    assert metrics.leave_last_out(pos, neg, 2).first()["auc"] == pytest.approx((0.75 + 0.5) / 2)
    with pytest.raises(Exception, match="has not 3 negatives"):
        metrics.leave_last_out(pos, neg, 3).collect()


def test_pool_changes_by_band(spark):
    old = spark.createDataFrame([(u, i, i) for u in (1, 2, 3) for i in range(1, 31)], "user_id long, item_id long, rank int")
    new = spark.createDataFrame(
        [(1, i, i) for i in range(1, 31)] + [(2, i, {1: 2, 2: 1}.get(i, i)) for i in range(1, 31)] + [(3, 99 if i == 12 else i, i) for i in range(1, 31)],
        "user_id long, item_id long, rank int",
    )
    r = metrics.pool_changes(old, new).first()
    assert (r["users"], r["same_order"], r["same_set"], r["added"], r["removed"], r["changed_11_25"], r["changed_26_50"]) == (3, 1, 2, 1, 1, 1, 0)


def test_mean_cosine_matches_all_pairs(spark):
    x = np.random.default_rng(2).normal(size=(30, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    assert metrics.mean_cosine(df).first()["mean_cosine"] == pytest.approx((c.sum() - 30) / (30 * 29), abs=1e-6)


def test_fixed_pools_send_only_short_samples_through_joins(spark, events, monkeypatch):
    samples = training.prefix_windows(events).select("sample.user_id", "sample.target").distinct()
    wide = spark.range(1, 5001).withColumnRenamed("id", "item_id")
    joins, sent = training.drawn_by_joins, []

    def spy(s, *rest):
        sent.append(s.count())
        return joins(s, *rest)

    monkeypatch.setattr(training, "drawn_by_joins", spy)
    rows = lambda d: sorted((r["user_id"], r["target"], tuple(r["items"])) for r in d.collect())
    got = rows(training.fixed_pools(samples, wide, events, 16))
    assert len(got) == samples.count() and sent[0] < len(got) / 4
    for name, value in (("LISTED", 0), ("LOOKED_THROUGH", 0)):
        with monkeypatch.context() as m:
            m.setattr(training, name, value)
            assert rows(training.fixed_pools(samples, wide, events, 16)) == got
    assert sent[1:] == [len(got), len(got)]


def brute_pool(hist, seen, near, kind, hot, weights, budget, half_life, n, top, each, first):
    """The pool after ``hist`` (ts, item), in plain Python: similarities ``near``, categories ``kind``, popular items ``hot`` in order."""
    late = sorted(hist)[-n:]
    free = [i for i in hot if i not in seen]
    nine = lambda x: math.floor(x * 1e9 + 0.5)
    cf = {}
    for ts, i in late:
        for j, s in near.get(i, {}).items():
            if j not in seen:
                cf[j] = cf.get(j, 0.0) + 2.0 ** (-((late[-1][0] - ts) / 86_400_000) / half_life) * s
    cf = dict(sorted(cf.items(), key=lambda x: (-nine(x[1]), x[0]))[:budget])
    cf.update(dict.fromkeys([i for i in free if i not in cf][: budget - len(cf)], -1.0))
    count = {}
    for _, i in late:
        if i in kind:
            count[kind[i]] = count.get(kind[i], 0) + 1
    best = sorted(count, key=lambda c: (-count[c], c is not None, c or ""))[:top]
    cat = {i: count[c] / sum(count.values()) for c in best if c is not None for i in [i for i in free if kind.get(i) == c][:each]}
    score = {}
    for w, channel in ((weights["cf"], cf), (weights["category"], cat), (weights["hot"], {i: 1 / p for p, i in enumerate(free[:first], 1)})):
        for p, i in enumerate(sorted(channel, key=lambda i: (-nine(channel[i]), i)), 1):
            score[i] = score.get(i, 0.0) + w / (60 + p)
    return sorted(score, key=lambda i: (-nine(score[i]), i))[:budget]


@pytest.mark.parametrize("block", [4096, 3])
def test_training_pools_are_made_where_the_user_is(spark, monkeypatch, block):
    """No row of a sample is stored, whatever the blocks; pools as by hand, with ties of time, items without neighbours, of no category and unknown to the catalogue."""
    rng = np.random.default_rng(5)
    weights, wide = {"cf": 2.0, "category": 0.7, "hot": 0.05}, dict(budget=12, half_life=3.0, n=4, top=2, each=3, first=2)
    log = {u: sorted((int(t) * 86_400_000, int(i)) for t, i in zip(rng.integers(0, 9, size), rng.choice(40, size, replace=False), strict=True)) for u, size in enumerate([1, 2, 9, 14, 25, 40])}
    near = {i: {int(j): float(rng.integers(1, 9)) / 10 for j in rng.choice(40, 5, replace=False) if j != i} for i in range(30)}
    kind = {i: None if i % 13 == 0 else f"c{i % 5}" for i in range(36)}
    hot = [int(i) for i in rng.permutation(40)]
    train = spark.createDataFrame([(u, i, t, 4.0) for u, own in log.items() for t, i in own], "user_id long, item_id long, ts long, rating double")
    sim = spark.createDataFrame([(i, j, s) for i, own in near.items() for j, s in own.items()], "item_id long, neighbor long, sim double")
    dim = spark.createDataFrame(list(kind.items()), "item_id long, category string")
    ranks = spark.createDataFrame([(i, r) for r, i in enumerate(hot, 1)], "item_id long, hot_rank int")
    stored = []
    monkeypatch.setattr(training, "stored", lambda df, name: stored.append(name) or df)
    monkeypatch.setattr(training, "SAMPLE_BLOCK", block, raising=False)
    got = {}
    for r in training.training_pools(train, sim, dim, ranks, weights, **wide).collect():
        got.setdefault((r["user_id"], r["target"]), {})[r["rank"]] = r["item_id"]
    want = {}
    for u, own in log.items():
        for t, i in own:
            if hist := [x for x in own if x[0] < t]:
                want[u, i] = dict(enumerate(brute_pool(hist, {i for _, i in hist}, near, kind, hot, weights, **wide), 1))
    assert got == want
    assert not stored
