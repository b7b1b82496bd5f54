"""Rerankers, losses, bootstrap, gate, weight grid, co-occurrence in blocks and kept histories, against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import channels, clean, fusion, metrics, ranking, sequence, shared, similarity


def relu(x):
    return max(x, 0.0)


def attention_by_hand(m, past, v, x):
    n, d = len(past), len(v)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    mean = [sum(h[i] for h in past) / n if n else 0.0 for i in range(d)]
    interest = [0.0] * d
    for h in past:
        a = sum(m.unit_out[r] * relu(dot(m.past[r], h) + dot(m.target[r], v) + dot(m.both[r], [p * q for p, q in zip(h, v, strict=True)]) + m.unit_bias[r]) for r in range(len(m.unit_out)))
        interest = [i + a * p / n for i, p in zip(interest, h, strict=True)]
    return sum(m.out[r] * relu(dot(m.item[r], v) + dot(m.interest[r], interest) + dot(m.cross[r], [p * q for p, q in zip(mean, v, strict=True)]) + dot(m.user[r], x) + m.bias[r]) for r in range(len(m.out)))


def test_attention_rank_matches_a_loop(spark):
    rng = np.random.default_rng(2)
    m = ranking.TargetAttention.by_rule(5, 2, units=3, hidden=4)
    items = {i: rng.standard_normal(5).tolist() for i in range(30)}
    hist = [(u, int(i), int(t)) for u in range(8) for t, i in enumerate(rng.choice(40, 7, replace=False))]
    pool = [(u, int(i)) for u in range(10) for i in rng.choice(40, 12 if u != 3 else 1, replace=False)]
    feats = {u: rng.standard_normal(2).tolist() for u in range(9)}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    args = frame(pool, "user_id long, item_id long"), frame(hist, "user_id long, item_id long, ts long"), frame(list(items.items()), "item_id long, v array<double>"), frame(list(feats.items()), "user_id long, x array<double>"), m
    got = {(r["user_id"], r["rank"]): (r["item_id"], r["score"]) for r in ranking.attention_rank(*args, k=6, n=5, microbatch=4).collect()}
    for u in range(10):
        late = [i for _, i, _ in sorted((x for x in hist if x[0] == u), key=lambda x: -x[2])[:5]]
        past = [items[i] for i in late if i in items]
        scored = sorted((-attention_by_hand(m, past, items.get(i, [0.0] * 5), feats.get(u, [0.0] * 2)), i) for w, i in pool if w == u)[:6]
        assert [got[u, k + 1][0] for k in range(len(scored))] == [i for _, i in sorted(scored, key=lambda x: (round(x[0], 9), x[1]))]
        assert np.allclose([got[u, k + 1][1] for k in range(len(scored))], [-s for s, _ in scored])
    assert len(got) == 9 * 6 + 1
    flat = ranking.TargetAttention(*(x * 0 for x in (m.past, m.target, m.both, m.unit_bias, m.unit_out, m.item, m.interest, m.cross, m.user, m.bias, m.out)))
    tied = ranking.attention_rank(*args[:4], flat, k=20).orderBy("user_id", "rank").collect()  # all scores equal: by id
    assert [(r["user_id"], r["item_id"]) for r in tied] == sorted(pool)
    assert ranking.attention_rank(args[0].where("false"), *args[1:], k=3).count() == 0


def test_in_batch_loss_matches_a_loop(spark):
    rng = np.random.default_rng(5)
    u, v = {i: rng.standard_normal(4) for i in range(9)}, {i: rng.standard_normal(4) for i in range(12)}
    pairs = [(a, b) for a in u for b in v if rng.random() < 0.3]
    hist = [(a, int(b)) for a in u for b in rng.choice(12, 3, replace=False)]
    hard = [(b, rng.standard_normal(4).tolist()) for b in range(0, 12, 2) for _ in range(2)]
    frame = spark.createDataFrame([(a, b, u[a].tolist(), v[b].tolist()) for a, b in pairs], "user_id long, item_id long, u array<double>, v array<double>")
    rows = ranking.in_batch_loss(frame, spark.createDataFrame(hist, "user_id long, item_id long"), spark.createDataFrame(hard, "item_id long, w array<double>"), temperature=0.3, batch=10, share=0.3).collect()
    assert len(rows) == len(pairs) and sorted({r["batch"] for r in rows}) == list(range(math.ceil(len(pairs) / 10)))
    for r in rows:
        a, b = r["user_id"], r["item_id"]
        mates = [(x["user_id"], x["item_id"]) for x in rows if x["batch"] == r["batch"]]
        other = [y for x, y in mates if y != b and x != a and (a, y) not in hist]
        score = lambda y: float(u[a] @ y) / 0.3  # noqa: B023, E731
        want = math.log(sum(math.exp(score(v[y])) for y in [b, *other])) - score(v[b])
        extra = [np.array(w) for i, w in hard if i == b]
        more = math.log(sum(math.exp(score(y)) for y in [v[b], *extra])) - score(v[b])
        assert r["negatives"] == len(other) and math.isclose(r["in_batch"], want, abs_tol=1e-9) and math.isclose(r["hard"], more, abs_tol=1e-9) and math.isclose(r["loss"], want + 0.3 * more, abs_tol=1e-9)


def test_sampled_softmax(spark):
    df = spark.createDataFrame([(1.0, [0.5, 2.0]), (1000.0, [-1000.0, 999.0]), (0.0, [])], "p double, n array<double>")
    got = [r[0] for r in df.select(ranking.sampled_softmax_loss(F.col("p"), F.col("n"), 0.5)).collect()]
    assert np.allclose(got, [math.log(math.exp(2) + math.exp(1) + math.exp(4)) - 2, math.log1p(math.exp(-2)), 0.0])
    for bad in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(ValueError):
            ranking.sampled_softmax_loss(F.col("p"), F.col("n"), bad)


def test_bootstrap_is_near_the_exact_interval(spark):
    rng = np.random.default_rng(1)
    x = rng.choice([-1.0, 0.0, 0.0, 0.0, 1.0, 1.0], 3000)
    df = spark.createDataFrame([(i, float(v), float(v) / 2) for i, v in enumerate(x)], "user_id long, hr double, ndcg double").repartition(7)
    got = {r["metric"]: r for r in metrics.bootstrap(df, ["hr", "ndcg"], draws=2000, alpha=0.025).collect()}
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert got["hr"]["users"] == 3000 and math.isclose(got["hr"]["mean"], x.mean()) and abs(got["hr"]["low"] - (x.mean() - half)) < 0.1 * half and abs(got["hr"]["high"] - (x.mean() + half)) < 0.1 * half
    assert math.isclose(got["ndcg"]["low"], got["hr"]["low"] / 2)
    again = {r["metric"]: r for r in metrics.bootstrap(df.repartition(2), ["hr", "ndcg"], draws=2000, alpha=0.025).collect()}
    assert all(math.isclose(again[m][c], got[m][c], abs_tol=1e-12) for m in got for c in ("low", "high"))
    none = metrics.bootstrap(df.where("false"), ["hr"], draws=10).first()
    assert (none["users"], none["mean"], none["low"], none["high"]) == (0, 0.0, 0.0, 0.0)
    same = metrics.bootstrap(df.withColumn("hr", F.lit(0.0)), ["hr"], draws=10).first()
    assert (same["low"], same["high"]) == (0.0, 0.0)


def test_acceptance_needs_all_six(spark):
    rows = [(s, "screen" if u % 4 == 0 else "confirm", u, 1.0 if (u + s) % 10 == 0 else 0.0, 0.1 if u % 7 == 0 else 0.0) for s in (1, 2, 3) for u in range(800)]
    gate = lambda r: metrics.acceptance(spark.createDataFrame(r, "seed int, cohort string, user_id long, hr double, ndcg double"), draws=300).first()
    good = gate(rows)
    assert good["accepted"] and good["users"] == 600
    tests = ("screen_gains", "screen_holds", "every_seed_gains", "gain_suffices", "interval_gains", "confirm_holds")
    faults = {
        "screen_gains": lambda s, c, h, n: (-h if c == "screen" else h, n), "screen_holds": lambda s, c, h, n: (h, -n if c == "screen" else n), "every_seed_gains": lambda s, c, h, n: (0.0 if s == 2 and c == "confirm" else h, n),
        "confirm_holds": lambda s, c, h, n: (h, -n if c == "confirm" else n),
    }
    for name, f in faults.items():
        r = gate([(s, c, u, *f(s, c, h, n)) for s, c, u, h, n in rows])
        assert not r["accepted"] and not r[name] and all(r[t] for t in tests if t != name), name
    few = gate([(s, c, u, h if c == "screen" or u == 10 * 3 - s else 0.0, n) for s, c, u, h, n in rows])
    assert not few["accepted"] and not few["interval_gains"] and few["gain_suffices"]
    assert not gate([r for r in rows if r[1] == "screen"])["accepted"]


def test_tune_weights_equals_built_lists(spark):
    r = random.Random(3)
    rows, targets = [], [(u, r.randrange(40)) for u in range(30) for _ in range(2)]
    for u, c in itertools.product(range(30), ("a", "b", "c")):
        scores = sorted(((r.randrange(1, 9) / 4, i) for i in r.sample(range(40), r.randrange(12))), key=lambda x: (-x[0], x[1]))
        rows += [(c, u, i, s, k + 1) for k, (s, i) in enumerate(scores)]
    stacked = spark.createDataFrame(rows, "channel string, user_id long, item_id long, score double, rank int")
    truth = spark.createDataFrame(targets, "user_id long, item_id long")
    sets = fusion.weight_sets({"a": (0.5, 1.0, 2.0), "b": (0.0, 1.0), "c": (0.25, 3.0)}, {})
    assert len(sets) == 12 and sets[1] == {"a": 0.5, "b": 0.0, "c": 3.0}
    tuned = fusion.tune_weights(stacked, sets, truth, n=10, at=5)
    got = {x["combo"]: x for x in tuned.collect()}
    for i, w in enumerate(sets):
        lists = fusion.legacy_weighted(stacked, w, 10)
        want = metrics.legacy_metrics(lists, truth, 10).first()["hr"], metrics.legacy_metrics(lists, truth, 5).first()["dcg"]
        assert (got[i]["hr"], got[i]["ndcg"]) == pytest.approx(want, abs=2e-6)
    best = fusion.best_weights(tuned, ["a", "b", "c"])
    assert best == {c: got[min(got, key=lambda i: (-got[i]["hr"], i))][c] for c in "abc"}


def test_pairs_of_a_very_active_user_are_dealt_into_blocks(spark):
    rng = np.random.default_rng(4)
    rows = {(0, i) for i in range(700)} | {(u, int(i)) for u in range(1, 30) for i in rng.choice(700, 12, replace=False)}
    train = spark.createDataFrame([(u, i, int(rng.integers(0, 5)) * 86_400_000) for u, i in sorted(rows)], "user_id long, item_id long, ts long").cache()
    events = train.join(train.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select("user_id", "n", F.col("item_id").alias("e"))
    pairs = similarity.user_pairs(events, block=64).select("user_id", "x.e", F.col("y.e").alias("f"))
    assert pairs.count() == pairs.distinct().count() == 700 * 699 // 2 + 29 * 66 and pairs.where("e >= f").count() == 0
    key = F.pmod(F.xxhash64("e"), F.ceil(F.col("n") / 64)).cast("int")
    assert events.where("user_id = 0").groupBy(key).count().agg(F.max("count")).first()[0] < 128  # what one key joins
    for f in (similarity.cosine_iuf, similarity.time_decayed):
        one, many = ({(r["item_id"], r["neighbor"]): (r["rank"], round(r["sim"], 9)) for r in f(train, 5, block=b).collect()} for b in (10**6, 64))
        assert one == many and len(one) == 3500


def test_refill_lays_out_popular_items_for_short_lists_only(spark):
    hot = spark.createDataFrame([(i, 100 - i, i) for i in range(1, 31)], "item_id long, cnt long, hot_rank int")
    hist = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4)], "user_id long, item_id long")
    pool = spark.createDataFrame([(1, 3, 0.9, 1), (1, 20, 0.8, 2), *[(2, 10 + k, 1.0 - k / 10, k) for k in range(1, 6)]], "user_id long, item_id long, score double, rank int")
    got = {}
    for r in sorted(channels.refill(pool, hist, hot, hist, 5).collect(), key=lambda r: (r["user_id"], r["rank"])):
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"], r["score"]))
    assert got == {1: [(1, 3, 0.9), (2, 20, 0.8), (3, 4, -1.0), (4, 5, -1.0), (5, 6, -1.0)], 2: [(k, 10 + k, pytest.approx(1.0 - k / 10)) for k in range(1, 6)], 3: [(1, 1, -1.0), (2, 2, -1.0), (3, 3, -1.0), (4, 5, -1.0), (5, 6, -1.0)]}


def test_numbering_in_ranges_equals_one_window(spark, monkeypatch):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("x"))
    one = {r["x"]: r["n"] for r in shared.numbered(df, "n", "x").collect()}
    monkeypatch.setattr(shared, "ONE_TASK", 10)
    assert one == {r["x"]: r["n"] for r in shared.numbered(df, "n", "x").collect()} == {i: i + 1 for i in range(500)}


def test_kept_history_equals_batch_over_late_rows_and_a_restart(spark, tmp_path):
    from tidewheel.streaming.history import latest_history

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(7)
    rows = [(u, i, 1_700_000_000 + r.randrange(400)) for u in range(6) for i in range(r.randrange(1, 40))]
    r.shuffle(rows)  # many rows come late
    log = lambda part: spark.createDataFrame(part, "user_id long, item_id long, s long").select("user_id", "item_id", F.timestamp_seconds("s").alias("ts"))
    schema = "user_id long, item_id long, ts timestamp"
    want = {x["user_id"]: (x["events"], x["items"]) for x in sequence.latest_history(log(rows), 10).collect()}
    seen = {}

    def keep(df, _):
        seen.update({x["user_id"]: (x["events"], x["items"]) for x in df.collect()})

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = latest_history(stream, 10).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    third = len(rows) // 3
    for k in range(2):
        log(rows[k * third : (k + 1) * third]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert seen != want
    log(rows[2 * third :]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()  # a new query goes on from the checkpoint
    assert seen == want


def test_kept_encoder_over_three_loads(spark):
    load = lambda *x: spark.createDataFrame([(v,) for v in x], "x string")
    ids = lambda d: {r["raw"]: r["idx"] for r in d.collect()}
    first, done = clean.kept_ids(None, load("b", "a", None, "b"), "x")
    assert done == "rebuilt" and ids(first) == {"a": 2, "b": 3}
    same, done = clean.kept_ids(first, load("b"), "x")
    assert done == "kept" and ids(same) == ids(first)
    grown, done = clean.kept_ids(first, load("b", "d", "aa"), "x")
    assert done == "grown" and ids(grown) == {"a": 2, "b": 3, "aa": 4, "d": 5}
    again, done = clean.kept_ids(grown, load("z"), "x")  # four ids for one value
    assert done == "rebuilt" and ids(again) == {"z": 2}


def test_hash_tree_names_the_range_that_differs(spark):
    rows = [(i, f"v{i}") for i in range(500)]
    frame = lambda r: spark.createDataFrame([(n, *x) for n, x in enumerate(r)], "n int, a int, b string").repartition(3)
    tree = lambda r: metrics.hash_tree(frame(r).drop("x"), ["n"], leaf=16)
    base = tree(rows).cache()
    root = lambda t: t.orderBy(F.desc("level")).first()
    assert root(base)["node"] == 0 and base.count() == 32 + 16 + 8 + 4 + 2 + 1
    assert metrics.first_difference(base, tree(rows), 16) is None and root(base) == root(tree(rows))
    for change, at in (({300: (300, "x")}, 288), ({70: rows[71], 71: rows[70]}, 64), ({499: (1, "y")}, 496)):
        other = tree([change.get(i, r) for i, r in enumerate(rows)])
        assert metrics.first_difference(base, other, 16) == (at, at + 16) and root(base)["hash"] != root(other)["hash"]
    assert metrics.first_difference(base, tree(rows[:-1]), 16) == (496, 512)
    assert tree([]).count() == 0
