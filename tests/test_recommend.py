"""Golden values and invariants of the retrieval and evaluation plans."""

import math

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import channels, clean, fusion, grouped, metrics, sampling, sequence, shared, similarity
from tidewheel.plans.recommend import Tables
from tidewheel.sources import interactions as src

SF = "/root/testdata/sf0.001"
DAY = 86_400_000


def log(spark, rows):
    return spark.createDataFrame([(u, i, t * DAY, 4.0, "c", "b") for u, i, t in rows], "user_id long, item_id long, ts long, rating double, category string, brand string")


@pytest.fixture(scope="module")
def example(spark):
    """12 users with 6 events each, items never shared."""
    return log(spark, [(u, u * 6 + t, t) for u in range(12) for t in range(6)])


def test_leave_two_out_trains_on_four_of_six(example):
    assert sequence.leave_two_out(example).where("split = 'train'").count() == 48


def test_future_window_takes_the_last_two(example):
    t = sequence.future_window(example).where("split = 'target'").groupBy("user_id").agg(F.min("pos").alias("p"), F.count("*").alias("n")).collect()
    assert len(t) == 12 and all((r["p"], r["n"]) == (4, 2) for r in t)


def test_ties_never_cross_a_cut(spark):
    df = log(spark, [(1, i, t) for i, t in enumerate([0, 0, 1, 1, 1, 1])] + [(2, 50, 0), (2, 51, 0), (3, 60, 1)])
    out = {(r["user_id"], r["item_id"]): r for r in sequence.future_window(df).collect()}
    assert {k[1] for k, r in out.items() if r["split"] == "target"} == {2, 3, 4, 5}
    assert not out[(2, 50)]["eligible"] and not out[(3, 60)]["eligible"]
    assert all(r["hist_len"] == (0 if r["ts"] == 0 else 2) for r in sequence.strict_history(df).where("user_id = 1").collect())
    assert sequence.future_window(df.where("false")).count() == 0


def test_cosine_by_hand(spark):
    df = log(spark, [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 4, 1)])
    sim = {(r["item_id"], r["neighbor"]): r["sim"] for r in similarity.cosine_iuf(df).collect()}
    assert math.isclose(sim[(2, 3)], (1 / math.log(4) + 1 / math.log(3)) / math.sqrt(6)) and sim[(2, 3)] == sim[(3, 2)]


def test_pairs_below_the_least_double_keep_their_place(spark):
    """Items 1 and 2 are so far apart that their weight is above 0 and their similarity isn't."""
    rows = [(1, 1, 0.0), (1, 3, 100.0), (1, 2, 744.4), *[(u, i, 0.0) for u in (2, 3, 4) for i in (1,)], *[(u, 2, 0.0) for u in (5, 6, 7)]]
    got = {(r["item_id"], r["neighbor"]): r["rank"] for r in similarity.time_decayed(log(spark, [(u, i, int(t * 10)) for u, i, t in rows]).withColumn("ts", (F.col("ts") / 10).cast("long"))).collect()}
    assert (1, 2) not in got and got[(1, 3)] == 2


def test_rounding_keeps_the_sign_of_zero(spark):
    from tidewheel.operators.shared import signed_round

    got = [r[0] for r in spark.createDataFrame([(-2e-7,), (2e-7,), (0.0,), (-1.5e-6,), (0.1234565,)], "x double").select(signed_round(F.col("x"), 6)).collect()]
    assert list(map(str, got)) == ["-0.0", "0.0", "0.0", "-2e-06", "0.123457"]


def test_vectors_in_blocks_leave_out_what_a_query_names(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_NUMBERS", 40)
    monkeypatch.setattr(similarity, "BLOCK_QUERIES", 3)
    v = {i: [float(i % 7), float(i % 5), 1.0, float(i % 3)] for i in range(60)}
    skip = {r: list(range(r, 60, 4)) for r in range(9)}
    q = spark.createDataFrame([(0, r, v[r], 5, skip[r] or None) for r in range(9)], "part int, record long, q array<double>, k int, skip array<long>")
    items = spark.createDataFrame([(0, i, x) for i, x in v.items()], "part int, item_id long, v array<float>")
    got = {(r["record"], r["rank"]): r["item_id"] for r in similarity.block_top_k(q, items).collect()}
    for r in range(9):
        want = sorted((i for i in v if i not in skip[r]), key=lambda i: (-sum(a * b for a, b in zip(v[r], v[i], strict=True)), i))[:5]
        assert [got[(r, n)] for n in range(1, 6)] == want


def test_weight_grid_lays_no_rows_out_by_set(spark):
    rows = [(c, u, (u * 3 + n * m) % 11, 1.0 / n, n) for c, m in (("a", 1), ("b", 2)) for u in range(5) for n in range(1, 8)]
    truth = [(u, (u * 5) % 11) for u in range(5)] + [(9, 1)]
    sets = {0: {"a": 1.0, "b": 0.5}, 1: {"a": 0.0, "b": 2.0}, 2: {"a": 0.0, "b": 0.0}}
    out = fusion.weight_grid(ranks(spark, rows), spark.createDataFrame([(i, c, w) for i, s in sets.items() for c, w in s.items()], "combo int, channel string, w double"), spark.createDataFrame(truth, "user_id long, item_id long"), 3)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()
    got = {r["combo"]: r["hr"] for r in out.collect()}
    for i, s in sets.items():
        hits = set()
        for u, x in truth:
            score = {}
            for c, v, item, _, n in rows:
                if v == u and s[c] > 0:
                    score[item] = score.get(item, 0.0) + s[c] / (60 + n)
            hits |= {u} if x in sorted(score, key=lambda k: (-math.floor(score[k] * 1e9 + 0.5), k))[:3] else set()
        assert got[i] == round(len(hits) / 6, 6)


def test_unseen_popular_items_in_place_are_those_of_the_joins(spark, monkeypatch):
    hot = spark.createDataFrame([(i, i + 1) for i in range(40)], "item_id long, hot_rank int")
    hist = spark.createDataFrame([(u, i) for u in range(4) for i in range(0, 5 * u + 1, u + 1)] + [(7, 99)], "user_id long, item_id long")
    got = channels.hot_items(hist, hot, hist)
    assert "Exchange hashpartitioning(hot_rank" not in got._jdf.queryExecution().toString()
    rows = lambda d: sorted(map(tuple, d.select("user_id", "item_id", "rank").collect()))
    first = rows(got)
    monkeypatch.setattr(channels, "BROADCAST_ROWS", 0)
    assert first == rows(channels.hot_items(hist, hot, hist)) and (7, 0, 1) in first and len(first) == 25


def ranks(spark, rows):
    return spark.createDataFrame(rows, "channel string, user_id long, item_id long, score double, rank int")


def test_rrf_of_one_channel(spark):
    out = {r["item_id"]: r["score"] for r in fusion.rrf(ranks(spark, [("a", 1, 10, 0.9, 1), ("a", 1, 20, 0.8, 2)]), {"a": 1.0}, 5).collect()}
    assert math.isclose(out[10], 1 / 61) and math.isclose(out[20], 1 / 62)


def test_quota_is_full_and_leaves_seen_out(spark):
    rows = [(c, 1, i, float(100 - i), i + 1) for c in ("a", "b") for i in range(100)]
    seen = spark.createDataFrame([(1, 0), (1, 1)], "user_id long, item_id long")
    out = fusion.quota(ranks(spark, rows), {"a": 1.0, "b": 1.0}, 75, seen).collect()
    assert len(out) == 75 and not {0, 1} & {r["item_id"] for r in out}
    assert fusion.quota(ranks(spark, rows), {"c": 1.0}, 75).count() == 0


def test_quota_breaks_ties_by_text(spark):
    out = fusion.quota(ranks(spark, [("a", 1, 9, 1.0, 1), ("a", 1, 10, 1.0, 2)]), {"a": 1.0}, 5).orderBy("rank").collect()
    assert [r["item_id"] for r in out] == [10, 9]


@pytest.mark.parametrize("bad", [(1, 2), (1, 1, 1, 1, 1), (0, 0, 0, 0), (float("nan"), 1, 1, 1), (-1, 1, 1, 1)])
def test_bad_weights(bad):
    assert fusion.check_weights(None) == fusion.DEFAULT_WEIGHTS
    with pytest.raises(ValueError):
        fusion.check_weights(bad)


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 3, 1)], "user_id long, item_id long, rank int")
    targets = spark.createDataFrame([(1, 1), (1, 2), (2, 4)], "user_id long, item_id long")
    r = metrics.ranking_metrics(ranked, targets, 2).first()
    assert (r["hr"], r["ndcg"]) == (0.5, 0.5)
    late = spark.createDataFrame([(1, 7, 1), (1, 1, 2), (1, 2, 3)], "user_id long, item_id long, rank int")
    n = metrics.user_metrics(late, targets.where("user_id = 1"), 5).first()["ndcg"]
    assert math.isclose(n, (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))


def test_auc_by_hand(spark):
    s = spark.createDataFrame([(1, 0.9, 1), (1, 0.8, 0), (2, 0.5, 1), (2, 0.5, 0), (3, 0.1, 0)], "user_id long, score double, label int")
    assert {r["user_id"]: r["auc"] for r in metrics.auc(s, ["user_id"]).collect()} == {1: 1.0, 2: 0.5, 3: None}


def test_paired_comparison(spark):
    old = spark.range(1000).select(F.col("id").alias("user_id"), F.lit(0).alias("hit"), F.lit(0.0).alias("ndcg"))
    new = old.withColumn("hit", (F.col("user_id") < 100).cast("int")).withColumn("ndcg", F.col("hit") * 1.0)
    r = metrics.paired(old, new).first()
    assert (r["gained"], r["lost"], r["delta_hr"]) == (100, 0, 0.1)
    lo, hi = metrics.bootstrap_interval(100, 0, 1000)
    assert 0 < lo < 0.1 < hi and metrics.bootstrap_interval(0, 0, 10) == (0.0, 0.0) and metrics.accepted(0.1, 0.1)
    with pytest.raises(Exception, match="different users"):
        metrics.paired(old, new.where("user_id > 3")).collect()


def test_recency_is_anchored_at_the_last_event(spark):
    sim = spark.createDataFrame([(1, 9, 1.0, 1), (2, 8, 1.0, 1)], "item_id long, neighbor long, sim double, rank int")
    a = channels.item_cf(log(spark, [(1, 1, 0), (1, 2, 90)]), sim, log(spark, [(1, 1, 0)]), 5, 90.0).collect()
    assert {r["item_id"]: r["score"] for r in a} == {8: 1.0, 9: 0.5}


def test_pool_is_full_legal_and_independent_of_partitions(spark):
    t = Tables(spark, SF)
    audit = metrics.pool_audit(t.pool, t.hist, 75, t.dim).first().asDict()
    assert not any(audit.values())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = sorted(map(tuple, t.pool.where("rank <= 5").select("user_id", "item_id", "rank").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    other = Tables(spark, SF)
    other.inter = other.inter.repartition(5, "item_id")
    again = sorted(map(tuple, other.pool.where("rank <= 5").select("user_id", "item_id", "rank").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows == again


def test_parts_grow_with_the_log(spark, monkeypatch):
    """A part's rows, and so what a task holds, don't grow with the log, however few parts the session shuffles into."""
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [shared.enough_parts(spark, n * shared.PART_EVENTS) for n in (0, 1, few, few + 3)] == [few, few, few, few + 3]
    t, wide = Tables(spark, SF), Tables(spark, SF)
    wide.parts = 3 * few
    monkeypatch.setattr(similarity, "PART_PAIRS", 1000)
    assert [x.rdd.getNumPartitions() for x in (wide.fw.groupBy("user_id").count(), wide.lists.groupBy("user_id").count())] == [3 * few] * 2
    assert wide.sim.groupBy("item_id").count().rdd.getNumPartitions() == similarity.similarity_parts(wide.train) > few
    own = lambda x: sorted(map(tuple, x.select("channel", "user_id", "item_id", F.round("score", 9), "rank").collect()))
    monkeypatch.undo()
    assert own(wide.lists) == own(t.lists)


def test_negatives_are_legal_and_repeat(spark):
    t = Tables(spark, SF)
    neg = sampling.random_negatives(t.hist, t.hot, t.hist, 4)
    a = sampling.negative_audit(neg, t.hist, t.hot).first()
    assert (a["repeated"], a["known"], a["outside"]) == (0, 0, 0)
    assert neg.groupBy("user_id").count().where("count <> 4").count() == 0
    assert neg.exceptAll(sampling.random_negatives(t.hist.repartition(9), t.hot, t.hist, 4)).count() == 0


def test_weighted_negatives_cover_the_catalogue(spark):
    """By popularity from all 3000 items; users who know nearly all of it still get what is left."""
    n = 3000
    hot = spark.range(1, n + 1).select(F.col("id").alias("item_id"), (F.floor(n / F.col("id")) + 1).alias("cnt"), F.col("id").cast("int").alias("hot_rank"))
    ids = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("item_id"))
    known = ids(1, 2951).withColumn("user_id", F.lit(-1).cast("long")).unionByName(ids(3, 3001).withColumn("user_id", F.lit(-2).cast("long")))
    records = known.select("user_id").unionByName(spark.range(500).select(F.col("id").alias("user_id")))
    neg = sampling.weighted_negatives(records, hot, known, 4)
    got = {}
    for r in neg.collect():
        got.setdefault(r["user_id"], {})[r["place"]] = r["item_id"]
    assert len(got) == 502 and all(set(v) == {1, 2, 3, 4} and len(set(v.values())) == 4 for u, v in got.items() if u != -2)
    assert set(got[-2].values()) == {1, 2} and all(i > 2950 for i in got[-1].values())
    cnt = {r["item_id"]: r["cnt"] for r in hot.collect()}
    for lo, hi in ((1, 10), (1001, 3000)):
        share = sum(c for i, c in cnt.items() if lo <= i <= hi) / sum(cnt.values())
        drawn = sum(lo <= v[1] <= hi for u, v in got.items() if u >= 0) / 500
        assert abs(drawn - share) < 0.08
    assert neg.exceptAll(sampling.weighted_negatives(records.repartition(9), hot.repartition(3, "cnt"), known, 4)).count() == 0


def test_k_core_is_a_fixpoint(spark):
    df = log(spark, [(u, i, u + i) for u in range(6) for i in range(6) if (u + i) % 5])
    core = clean.k_core(df, 4, 4)
    assert core.groupBy("user_id").count().where("count < 4").count() == 0 and core.groupBy("item_id").count().where("count < 4").count() == 0
    assert clean.k_core(df, 99, 99).count() == 0


def test_propagation_covers_all_of_train(spark):
    import __spark_entry__

    ids = [(r["user_id"] * 10 + 1, r["item_id"] * 10 + 2) for r in Tables(spark, SF).train.collect()]
    near, vec = {}, {}
    for a, b in ids:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
        vec |= {x: [math.sin(x * k) for k in (1, 2, 3)] for x in (a, b)}
    now, total = vec, {i: list(v) for i, v in vec.items()}
    for _ in range(3):
        now = {i: [sum(now[j][k] / math.sqrt(len(near[i]) * len(near[j])) for j in near[i]) for k in range(3)] for i in near}
        for i, v in now.items():
            total[i] = [x + y for x, y in zip(total[i], v)]
    got = {r["id"]: r["v"] for r in __spark_entry__.queries()["j_propagation"](spark, SF).collect()}
    assert max(a for a, _ in ids) > 501 and set(got) == set(total)
    assert all(math.isclose(x, y / 4, abs_tol=1e-9) for i in got for x, y in zip(got[i], total[i], strict=True))


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("user_id,item_id,rating,ts\nu,i,5.0,1\nv,j,3,2\n")
    df = src.read_ratings_csv(spark, {"books": str(tmp_path / "r.csv"), "toys": str(tmp_path / "r.csv")}, per_file=1)
    assert df.count() == 2 and {r["category"] for r in df.collect()} == {"books", "toys"}
    (tmp_path / "r.jsonl").write_text('{"user_id":"u","parent_asin":"p","rating":4.0,"timestamp":5,"verified_purchase":true}\nnot json\n{"user_id":"u"}\n')
    r = src.read_reviews_jsonl(spark, str(tmp_path / "r.jsonl")).collect()
    assert len(r) == 1 and r[0]["asin"] == "p" and r[0]["verified_purchase"] == 1
    (tmp_path / "m.jsonl").write_text('{"parent_asin":"p","store":"S","details":{"Brand":" "},"price":"$1,200.50"}\n{"parent_asin":"q","price":"from 3"}\n')
    m = {x["item_id"]: x for x in src.read_meta_jsonl(spark, str(tmp_path / "m.jsonl")).collect()}
    assert (m["p"]["brand"], m["p"]["price"], m["q"]["brand"], m["q"]["price"]) == ("S", 1200.5, "Unknown", -1.0)
    ranked = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "user_id long, rank int, item_id long")
    src.write_predictions(ranked, str(tmp_path / "out"), 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().asDict() == {"user_id": "1", "item_1": "7", "item_2": "8"}
    src.write_predictions(ranked, str(tmp_path / "js"), 2, "json")
    assert spark.read.json(str(tmp_path / "js")).first()["items"] == [7, 8]
    assert src.first_existing([str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)


def test_encoding(spark):
    ids = clean.dense_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string"), "x")
    assert sorted(map(tuple, ids.collect())) == [("a", 2), ("b", 3)]
    assert clean.still_covers(ids, spark.createDataFrame([("a",)], "x string"), "x")
    with pytest.raises(ValueError):
        clean.dense_ids(spark.createDataFrame([("[PAD]",)], "x string"), "x")


def test_streamed_popularity_equals_batch(spark):
    from tidewheel.streaming.popularity import windowed_popularity

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    to_ts = lambda d: d.withColumn("ts", F.col("ts").cast("timestamp"))
    q = windowed_popularity(to_ts(stream)).writeStream.outputMode("complete").format("memory").queryName("pop").start()
    q.processAllAvailable()
    q.stop()
    batch = windowed_popularity(to_ts(spark.read.parquet(f"{SF}/events.parquet")))
    assert sorted(map(tuple, spark.table("pop").collect())) == sorted(map(tuple, batch.collect()))


def test_every_query_has_named_columns(spark):
    import __spark_entry__

    qs, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 90
    assert __spark_entry__.entry(spark).columns == ["user_id", "item_id", "score", "rank"]


def test_the_pool_moves_no_row_that_is_stored_by_user(spark):
    """Channels and pool are stored by user: fusion, and full lists in the top-up, send nothing."""
    t = Tables(spark, SF)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(fusion.rrf(t.stacked, {"cf": 2.0, "category": 0.7, "hot": 0.05}, 75, placed=True))
    assert "Exchange" not in plan(t.pool.groupBy("user_id").agg(F.count("*")))
    assert {r["rank"] for r in t.cf.collect()} == set(range(1, 76))


def test_similarities_send_lists_and_split_popular_items(spark, monkeypatch):
    df = log(spark, [(u, i, i) for u in range(12) for i in range(30) if (u * i) % 5 < 3])
    rows = lambda d: {(r["item_id"], r["neighbor"], r["rank"]): round(r["sim"], 12) for r in d.collect()}
    want = rows(similarity.cosine_iuf(df, 10))
    monkeypatch.setattr(similarity, "HOT_EVENTS", 5)
    assert rows(similarity.cosine_iuf(df, 10)) == want and len(want) == 300
    assert rows(similarity.cosine_iuf(df, 10, block=4)) == want


def test_channels_of_all_users_at_once_are_those_of_the_joins(spark):
    """The channels' lists are made where a user's events are; what reads a single channel sends nothing either."""
    t = Tables(spark, SF)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in plan(d) for d in (t.cf, t.category, t.hot5))
    cf = channels.refill(channels.item_cf(t.hist, t.sim, t.hist, 75, 90.0), t.hist, t.hot, t.hist, 75)
    joined = fusion.stack({"cf": cf, "category": channels.category(t.hist, t.dim, t.hot, t.hist), "hot": channels.hot_items(t.hist, t.hot, t.hist)})
    rows = lambda d: {(r["channel"], r["user_id"], r["item_id"], r["rank"]): round(r["score"], 9) for r in d.collect()}
    want = rows(joined)
    assert rows(t.stacked) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows(grouped.user_channels(t.hist, t.sim, t.dim, t.hot, 75)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lists_of_a_group_are_laid_out_a_few_asks_at_a_time(spark, monkeypatch):
    t = Tables(spark, SF)
    ev = sequence.positions(t.hist).selectExpr("user_id", "item_id", "ts", "cast(pos + 1 as int) as e", "n as _n", "0 as before", "true as inside")
    table, who, base = grouped.in_order(grouped.with_lists(ev, ("user_id",), t.sim, t.dim, t.hot, 75, 20, channels.longest(t.hist)).toArrow())

    def rows():
        out, parts = set(), 0
        for asks, item, lists in grouped.channel_lists(table, who, base, who, ev_number, 75, 90.0, 50, 3, 20, 5):
            parts += 1
            out |= {(name, int(asks[s]), int(item[c]), round(float(x), 9), int(rank)) for name, each in lists.items() for s, c, x, rank in zip(*each, strict=True)}
        return out, parts

    ev_number = table.column("e").to_numpy().astype("int64")
    want, one = rows()
    monkeypatch.setattr(grouped, "LAID_OUT", 2000)
    got, many = rows()
    assert got == want and one < many


def test_nearest_vectors_equal_brute_force_and_are_stored_by_user(spark, monkeypatch):
    """Vectors pass by users that stay: equal scores, copies, repeated ids, users without vectors, more blocks and chunks than one; what reads the stored lists sends nothing."""
    import numpy as np

    from tidewheel.operators import nearest

    r = np.random.default_rng(3)
    vec = {i: np.round(r.normal(size=4), 1).astype(np.float32).tolist() for i in range(0, 120, 2)}
    vec |= {i + 1: vec[i] for i in range(0, 40, 2)}
    events = [(u, (u * 7 + j * 11) % 130, j) for u in range(60) for j in range(1 + u % 9)] + [(99, 129, 1)]
    items = spark.createDataFrame([*vec.items(), (6, vec[6]), (500, None), (501, [float("nan")] * 4)], "item_id long, v array<float>")
    want = {}
    for u in {u for u, _, _ in events}:
        mine = sorted((e for e in events if e[0] == u), key=lambda e: (e[2], e[1]))
        late = [v for _, i, _ in mine[-5:] for v in [vec.get(i)] * (2 if i == 6 else 1) if v]
        if late:
            mean = np.mean(np.array(late, np.float64), axis=0)
            found = [(-math.floor(float(np.dot(mean, np.float64(vec[i]))) * 1e9 + 0.5), i) for i in [*vec, 6] if i not in {e[1] for e in mine}]
            want[u] = [i for _, i in sorted(found)[:10]]
    for name, value in (("BLOCK_USERS", 7), ("CHUNK", 3), ("TILE", 2)):
        monkeypatch.setattr(nearest, name, value)
    hist = log(spark, events)
    for batch in ("4", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {x["user_id"]: x for x in nearest.vector_lists(hist, items, 10, 4, n=5).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {u: x["ids"] for u, x in got.items()} == want and 99 not in got
    t = Tables(spark, SF)
    assert "Exchange" not in t.vector.groupBy("user_id").agg(F.max("rank"))._jdf.queryExecution().executedPlan().toString()


def test_weight_tuning_moves_no_list_that_is_stored_by_user(spark):
    """Lists of several stored tables meet by their user; a channel that isn't stored, or isn't there for a user, meets them too."""
    t = Tables(spark, SF)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    sets = [{"cf": 1.0, "category": 0.5, "hot": 0.1, "vector": v, "brand": b} for v in (0.0, 1.0) for b in (0.0, 0.7)]
    assert "Exchange hashpartitioning" not in plan(fusion._with_targets([t.stacked, t.vector_rows], list(sets[0]), t.targets)[1])
    some = t.brand.where("user_id % 2 = 0")
    one = t.stacked.unionByName(fusion.stack({"vector": t.vector, "brand": some})).repartition(3)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(fusion.tune_weights([t.stacked, t.vector_rows, fusion.stack({"brand": some})], sets, t.targets)) == rows(fusion.tune_weights(one, sets, t.targets))


def test_brands_that_events_have_are_those_of_their_items(spark):
    t = Tables(spark, SF)
    dim = t.dim.withColumn("brand", F.when(F.col("item_id") % 3 > 0, F.col("brand")))
    hist = t.hist.drop("brand").join(dim.select("item_id", "brand"), "item_id")
    rows = lambda d: {(r["user_id"], r["item_id"], r["rank"]): round(r["score"], 9) for r in d.collect()}
    got = rows(channels.brand(hist, dim, t.hot, t.hist, 75, named=True, parts=3))
    assert got == rows(channels.brand(hist, dim, t.hot, t.hist, 75)) and got
    # shares are of all last events, those of unknown brand as well
    last = sequence.last_events(hist).groupBy("user_id").agg(F.count("*").alias("n"), F.count("brand").alias("known"))
    best = {r["user_id"]: r["known"] / r["n"] for r in last.collect()}
    assert all(s <= best[u] + 1e-9 for (u, _, _), s in got.items())


def test_four_channels_are_fused_where_they_are_stored(spark):
    t = Tables(spark, SF)
    assert "Exchange hashpartitioning" not in t.four_channels._jdf.queryExecution().executedPlan().toString()
    one = t.stacked.unionByName(fusion.stack({"vector": t.vector})).repartition(3)
    rows = lambda d: {(r["user_id"], r["item_id"], r["rank"]): round(r["score"], 9) for r in d.collect()}
    assert rows(t.four_channels) == rows(fusion.rrf(one, fusion.DEFAULT_WEIGHTS, 75))


def test_attribution_meets_by_user(spark):
    """Equal to counting by hand: repeated rows, users without candidates, a channel that only the union counts; lists that are stored by user aren't sent."""
    from tidewheel.operators import metrics

    stacked = [(c, u, i) for c, m in (("a", 2), ("b", 3), ("other", 5)) for u in range(6) for i in range(0, 12, m) if (u + i) % 4] + [("a", 1, 2)] * 2
    reach = [(c, u, i) for c, m in (("a", 1), ("b", 4)) for u in range(7) for i in range(0, 12, m)] + [("b", 1, 4)]
    targets = [(u, i) for u in range(8) for i in (u, 2 * u, 11)] + [(1, 1)]
    frame = lambda rows: spark.createDataFrame(rows, "channel string, user_id long, item_id long")
    got = {r["channel"]: tuple(r)[1:] for r in metrics.attribution(frame(stacked), frame(reach), spark.createDataFrame(targets, "user_id long, item_id long"), ["a", "b"]).collect()}
    truth, users = set(targets), {u for u, _ in targets}
    for name in ("a", "b", "all"):
        own, can = ({(u, i) for c, u, i in rows if name in (c, "all")} for rows in (stacked, reach))
        sizes = [len({i for v, i in own if v == u}) for u in users]
        want = (len({u for u, _ in truth & own}), len(truth & own), len(truth & can), len(truth & can - own), len(truth - can), round(sum(sizes) / len(sizes), 6), min(sizes), max(sizes))
        assert got[name] == want
    t = Tables(spark, SF)
    none = frame([("cf", 1, 1)])
    plan = metrics.attribution(t.stacked, none.where("false"), t.targets, ["cf", "category", "hot"])._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in line and "user_id#" in line for line in plan.splitlines())
    near = {(r["user_id"], r["item_id"]) for r in channels.reached(channels.recent(t.hist), t.targets, t.sim).collect()}
    joined = channels.recent(t.hist).join(t.sim.select("item_id", "neighbor"), "item_id").select("user_id", F.col("neighbor").alias("item_id"))
    assert near == {(r["user_id"], r["item_id"]) for r in t.targets.join(joined, ["user_id", "item_id"], "left_semi").collect()}
