"""Queries on evaluation, attribution, comparison and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators import channels, fusion, metrics, sampling

from .oracle import lot, using
from .recommend import BUDGET, WEIGHTS, Tables
from .registry import query

_MEANS = "count(*) AS users, round(avg(hit), 6) AS hr, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg"


def _um(t: Tables) -> DataFrame:
    return metrics.user_metrics(t.pool, t.targets, 5)


@query("e_user_metrics", using("um", "SELECT user_id, hit, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM um"))
def _(t: Tables) -> DataFrame:
    return _um(t).select("user_id", "hit", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


@query("e_ranking_metrics", using("um", f"SELECT {_MEANS} FROM um"))
def _(t: Tables) -> DataFrame:
    return metrics.ranking_metrics(t.pool, t.targets, 5)


@query("e_legacy_metrics", using("pool tgt", "SELECT round(avg(CAST(d IS NOT NULL AS INTEGER)), 6) AS hr, round(avg(coalesce(d, 0.0)), 6) AS dcg FROM (SELECT DISTINCT user_id FROM tgt) LEFT JOIN (SELECT user_id, sum(1 / log2(rank + 1)) AS d FROM pool JOIN tgt USING (user_id, item_id) WHERE rank <= 20 GROUP BY 1) USING (user_id)"))
def _(t: Tables) -> DataFrame:
    return metrics.legacy_metrics(t.pool, t.targets, 20)


@query("e_hit_rates", using("stacked tgt", """SELECT channel, round(count(*) FILTER (r <= 5) / n, 6) AS hr5, round(count(*) FILTER (r <= 20) / n, 6) AS hr20, round(count(*) FILTER (r <= 50) / n, 6) AS hr50
  FROM (SELECT channel, user_id, min(rank) AS r FROM stacked JOIN tgt USING (user_id, item_id) GROUP BY 1, 2), (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS n FROM tgt) GROUP BY channel, n"""))
def _(t: Tables) -> DataFrame:
    return metrics.hit_rates(t.stacked, t.targets)


def _scored(t: Tables) -> DataFrame:
    """Pool scores, coarse enough to tie, with 0/1 labels."""
    hit = t.targets.distinct().withColumn("label", F.lit(1))
    return t.pool.join(hit, ["user_id", "item_id"], "left").select("user_id", F.round("score", 2).alias("score"), F.coalesce("label", F.lit(0)).alias("label"))


_SCORED = "sc AS (SELECT p.user_id, round(score, 2) AS score, CAST(t.user_id IS NOT NULL AS INTEGER) AS label FROM pool p LEFT JOIN (SELECT DISTINCT * FROM tgt) t ON p.user_id = t.user_id AND p.item_id = t.item_id)"
_AUC = "SELECT user_id, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY 1"
_WON = "SELECT a.user_id, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc FROM sc a JOIN sc b ON a.user_id = b.user_id WHERE a.label = 1 AND b.label = 0 GROUP BY 1"


@query("e_user_auc", using("pool tgt", f"SELECT user_id, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, round(auc, 6) AS auc FROM ({_AUC}) LEFT JOIN ({_WON}) USING (user_id)", _SCORED))
def _(t: Tables) -> DataFrame:
    return metrics.auc(_scored(t), ["user_id"]).select("user_id", F.col("pos").cast("bigint"), F.col("neg").cast("bigint"), F.round("auc", 6).alias("auc"))


@query("e_global_auc", using("pool tgt", """SELECT CAST(sum(p) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS neg, round(sum(p * (below + n * 0.5)) / (sum(p) * sum(n)), 6) AS auc FROM (SELECT score, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n,
  coalesce(sum(sum(1 - label)) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM sc GROUP BY score)""", _SCORED))
def _(t: Tables) -> DataFrame:
    return metrics.auc(_scored(t), []).select(F.col("pos").cast("bigint"), F.col("neg").cast("bigint"), F.round("auc", 6).alias("auc"))


@query("e_gauc", using("pool tgt", f"SELECT round(avg(auc), 6) AS gauc, round(avg(CAST(auc IS NOT NULL AS INTEGER)), 6) AS coverage FROM ({_AUC}) LEFT JOIN ({_WON}) USING (user_id)", _SCORED))
def _(t: Tables) -> DataFrame:
    return metrics.gauc(_scored(t))


@query("e_sampled_rank", """SELECT round(avg(CAST(rank <= 10 AS INTEGER)), 6) AS hr, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg FROM (SELECT o_custkey, 1 + count(*) FILTER (o_totalprice >= p) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, max(o_totalprice) FILTER (o_orderkey = f) OVER (PARTITION BY o_custkey) AS p FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders)) WHERE rn > 1 GROUP BY 1)""")
def _(t: Tables) -> DataFrame:
    o = t.read("orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("f"))
    s = o.join(first, "o_custkey").select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") == F.col("f")).cast("int").alias("label"))
    return metrics.sampled_rank(s, 10)


_COV = "SELECT round(avg(CAST(s > 0 AS INTEGER)), 6) AS pool_hr, round(avg(s), 6) AS coverage FROM (SELECT t.user_id, avg(CAST(p.user_id IS NOT NULL AS INTEGER)) AS s FROM (SELECT DISTINCT * FROM tgt) t LEFT JOIN pool p ON p.user_id = t.user_id AND p.item_id = t.item_id GROUP BY 1)"


@query("e_pool_coverage", using("pool tgt", _COV))
def _(t: Tables) -> DataFrame:
    return metrics.pool_coverage(t.pool, t.targets)


@query("e_conditional_hr", using("um", f"SELECT round(CASE WHEN pool_hr = 0 THEN 0 ELSE hr / pool_hr END, 5) AS conditional_hr, CASE WHEN pool_hr < 0.9 THEN 'recall' WHEN pool_hr - hr > 0.1 THEN 'rank' ELSE 'balanced' END AS verdict FROM (SELECT round(avg(hit), 6) AS hr FROM um), ({_COV})"))
def _(t: Tables) -> DataFrame:
    j = metrics.ranking_metrics(t.pool, t.targets, 5).crossJoin(metrics.pool_coverage(t.pool, t.targets))
    return j.select(F.round(metrics.conditional_hr(F.col("hr"), F.col("pool_hr")), 5).alias("conditional_hr"), metrics.verdict(F.col("hr"), F.col("pool_hr")).alias("verdict"))


_NAMES = ["cf", "category", "hot"]
_FLAGS = "fl AS (SELECT user_id, coalesce(max(CAST(channel = 'cf' AS INTEGER)), 0) AS cf, coalesce(max(CAST(channel = 'category' AS INTEGER)), 0) AS category, coalesce(max(CAST(channel = 'hot' AS INTEGER)), 0) AS hot FROM (SELECT DISTINCT user_id FROM tgt) LEFT JOIN (SELECT user_id, channel FROM stacked JOIN tgt USING (user_id, item_id)) USING (user_id) GROUP BY 1)"


@query("e_channel_hits", using("stacked tgt", "SELECT * FROM fl", _FLAGS))
def _(t: Tables) -> DataFrame:
    return metrics.channel_hits(t.stacked, t.targets, _NAMES)


@query("e_union_gain", using("stacked tgt", " UNION ALL ".join(f"SELECT '{n}' AS channel, CAST(sum({n}) AS BIGINT) AS hits, CAST(sum(CAST({n} = 1 AND cf + category + hot = 1 AS INTEGER)) AS BIGINT) AS alone, round(avg(CAST(cf + category + hot > 0 AS INTEGER)), 6) AS union_hr, round(avg(CAST(cf + category + hot - {n} > 0 AS INTEGER)), 6) AS without_hr FROM fl" for n in _NAMES), _FLAGS))
def _(t: Tables) -> DataFrame:
    return metrics.union_gain(metrics.channel_hits(t.stacked, t.targets, _NAMES), _NAMES)


@query("e_reachability", using("tgt hist sim", """SELECT user_id, item_id, CASE WHEN EXISTS (SELECT 1 FROM hist h WHERE h.user_id = t.user_id AND h.item_id = t.item_id) THEN 'in_history' WHEN r <= 10 THEN 'near' WHEN r IS NOT NULL THEN 'edge' ELSE 'unreachable' END AS reach
  FROM (SELECT DISTINCT * FROM tgt) t LEFT JOIN (SELECT h.user_id, s.neighbor AS item_id, min(s.rank) AS r FROM hist h JOIN sim s USING (item_id) GROUP BY 1, 2) USING (user_id, item_id)"""))
def _(t: Tables) -> DataFrame:
    return metrics.reachability(t.targets, t.hist, t.sim)


@query("e_pool_overlap", using("cf cat", """SELECT user_id, CAST(count(*) FILTER (a AND b) AS INTEGER) AS shared, CAST(count(*) FILTER (b AND NOT a) AS INTEGER) AS added, CAST(count(*) FILTER (a AND NOT b) AS INTEGER) AS removed, round(count(*) FILTER (a AND b) / CAST(count(*) AS DOUBLE), 6) AS jaccard
  FROM (SELECT user_id, item_id, bool_or(c = 1) AS a, bool_or(c = 2) AS b FROM (SELECT user_id, item_id, 1 AS c FROM cf UNION ALL SELECT user_id, item_id, 2 FROM cat) GROUP BY 1, 2) GROUP BY 1"""))
def _(t: Tables) -> DataFrame:
    return metrics.overlap(t.cf, t.category)


@query("s_set_operations", using("hist tgt", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT user_id FROM hist WHERE rating = 5 INTERSECT SELECT user_id FROM hist WHERE rating = 4) UNION ALL SELECT 'only', count(*) FROM (SELECT user_id FROM hist WHERE rating = 5 EXCEPT SELECT user_id FROM hist WHERE rating = 4) UNION ALL SELECT 'either', count(*) FROM (SELECT user_id FROM hist WHERE rating = 5 UNION SELECT user_id FROM hist WHERE rating = 4)"))
def _(t: Tables) -> DataFrame:
    a, b = t.hist.where("rating = 5").select("user_id"), t.hist.where("rating = 4").select("user_id")
    parts = {"both": a.intersect(b), "only": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for k, d in parts.items():
        d = d.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
        out = d if out is None else out.unionByName(d)
    return out


@query("s_train_target_disjoint", using("fw", "SELECT count(*) AS shared FROM (SELECT user_id, item_id FROM fw WHERE split = 'train' INTERSECT SELECT user_id, item_id FROM fw WHERE split = 'target')"))
def _(t: Tables) -> DataFrame:
    return t.train.select("user_id", "item_id").intersect(t.targets).agg(F.count("*").alias("shared"))


_OLD = "old AS (SELECT user_id, CAST(coalesce(f, 0) > 0 AS INTEGER) AS hit, coalesce(d, 0.0) / list_sum(list_transform(range(1, CAST(least(5, n) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM (SELECT user_id, count(*) AS n FROM tgt GROUP BY 1) LEFT JOIN (SELECT user_id, count(*) AS f, sum(1 / log2(rank + 1)) AS d FROM hot5 JOIN tgt USING (user_id, item_id) GROUP BY 1) USING (user_id))"


@query("e_paired", using("um hot5", """SELECT count(*) AS users, CAST(sum(CAST(n.hit > o.hit AS INTEGER)) AS BIGINT) AS gained, CAST(sum(CAST(n.hit < o.hit AS INTEGER)) AS BIGINT) AS lost, round(avg(n.hit - o.hit), 6) AS delta_hr, round(avg(n.ndcg - o.ndcg), 6) AS delta_ndcg,
  round(stddev_samp(n.ndcg - o.ndcg) * 1.96 / sqrt(count(*)), 6) AS ndcg_half_width, true AS aligned FROM old o JOIN um n USING (user_id)""", _OLD))
def _(t: Tables) -> DataFrame:
    return metrics.paired(metrics.user_metrics(t.hot5, t.targets, 5), _um(t))


_GROUPS = "u AS (SELECT um.user_id, hit, l AS history_length, coalesce(cnt, 0) AS popularity FROM um JOIN (SELECT user_id, count(*) AS l FROM hist GROUP BY 1) USING (user_id) JOIN (SELECT user_id, min(item_id) AS item_id FROM tgt GROUP BY 1) USING (user_id) LEFT JOIN hot USING (item_id))"


@query("e_groups", using("um hist tgt hot", """SELECT kind, bin, count(*) AS users, round(avg(hit), 6) AS hr FROM (SELECT hit, 'history_length' AS kind, CASE WHEN history_length <= 5 THEN '1-5' WHEN history_length <= 20 THEN '6-20' ELSE '21+' END AS bin FROM u
  UNION ALL SELECT hit, 'popularity', CASE WHEN popularity = 0 THEN '0' WHEN popularity <= 5 THEN '1-5' WHEN popularity <= 50 THEN '6-50' ELSE '51+' END FROM u) GROUP BY 1, 2""", _GROUPS))
def _(t: Tables) -> DataFrame:
    length = t.hist.groupBy("user_id").agg(F.count("*").alias("history_length"))
    target = t.targets.groupBy("user_id").agg(F.min("item_id").alias("item_id")).join(t.hot.select("item_id", F.col("cnt").alias("popularity")), "item_id", "left").na.fill(0)
    return metrics.by_groups(_um(t).join(length, "user_id").join(target, "user_id"))


@query("e_popularity_baseline", using("hot5 tgt", "SELECT round(count(DISTINCT h.user_id) / CAST((SELECT count(DISTINCT user_id) FROM tgt) AS DOUBLE), 6) AS hr FROM hot5 h JOIN tgt USING (user_id, item_id)"))
def _(t: Tables) -> DataFrame:
    return metrics.ranking_metrics(t.hot5, t.targets, 5).select("hr")


@query("e_best_checkpoint", "SELECT step, hr, ndcg FROM (SELECT o_orderkey AS step, floor(o_totalprice / 100000) AS hr, floor(o_totalprice / 10000) % 10 AS ndcg FROM orders) ORDER BY hr DESC, ndcg DESC, step LIMIT 1")
def _(t: Tables) -> DataFrame:
    p = F.col("o_totalprice").cast("double")
    return metrics.best_checkpoint(t.read("orders").select(F.col("o_orderkey").alias("step"), F.floor(p / 100000).cast("double").alias("hr"), (F.floor(p / 10000) % 10).cast("double").alias("ndcg")))


@query("e_pool_audit", using("pool hist", """SELECT CAST(sum(CAST(n <> 75 AS INTEGER)) AS BIGINT) AS wrong_size, CAST(sum(CAST(n <> d AS INTEGER)) AS BIGINT) AS repeated, CAST(sum(o) AS BIGINT) AS outside, CAST(sum(s) AS BIGINT) AS seen FROM (
  SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS d, max(CAST(item_id NOT IN (SELECT p_partkey FROM part) AS INTEGER)) AS o, max(CAST(EXISTS (SELECT 1 FROM hist h WHERE h.user_id = g.user_id AND h.item_id = g.item_id) AS INTEGER)) AS s FROM g GROUP BY 1)""", """g AS (SELECT user_id, item_id FROM pool WHERE user_id % 7 <> 0 OR rank < 75
  UNION ALL SELECT user_id, item_id FROM pool WHERE rank = 2 AND user_id % 3 = 0 UNION ALL SELECT user_id, -1 FROM pool WHERE rank = 1 AND user_id % 5 = 0 UNION ALL SELECT user_id, max(item_id) FROM hist WHERE user_id % 4 = 0 GROUP BY 1)"""))
def _(t: Tables) -> DataFrame:
    """The pool with faults put in, all of which must be counted."""
    good = t.pool.where("user_id % 7 <> 0 or rank < 75").select("user_id", "item_id")
    twice = t.pool.where("rank = 2 and user_id % 3 = 0").select("user_id", "item_id")
    outside = t.pool.where("rank = 1 and user_id % 5 = 0").select("user_id", F.lit(-1).cast(dict(t.pool.dtypes)["item_id"]).alias("item_id"))
    seen = t.hist.where("user_id % 4 = 0").groupBy("user_id").agg(F.max("item_id").alias("item_id"))
    return metrics.pool_audit(good.union(twice).union(outside).union(seen), t.hist, BUDGET, t.dim)


@query("e_embedding_health", """SELECT round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max, any_value(v) AS dim_variance FROM (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
  (SELECT round(avg(x), 6) AS v FROM (SELECT var_pop(CAST(embedding[k] AS DOUBLE)) AS x FROM embeddings, range(1, 65) AS r(k) GROUP BY k))""")
def _(t: Tables) -> DataFrame:
    return metrics.embedding_health(t.read("embeddings"))


@query("e_stage_counts", using("ded", "SELECT 'all' AS stage, count(*) AS rows FROM inter UNION ALL SELECT 'positive', count(*) FROM inter WHERE rating >= 4 UNION ALL SELECT 'first', count(*) FROM ded"))
def _(t: Tables) -> DataFrame:
    return metrics.reduced(t.inter, {"positive": t.inter.where("rating >= 4"), "first": t.ded})


@query("e_cohorts", using("tgt", f"SELECT user_id, CASE WHEN row_number() OVER (ORDER BY {lot(5, 'user_id')}, user_id) <= 200 THEN 'screen' ELSE 'confirm' END AS cohort FROM (SELECT DISTINCT user_id FROM tgt)"))
def _(t: Tables) -> DataFrame:
    return sampling.cohorts(t.targets, 200, seed=5)


@query("e_cohorts_split", using("tgt", f"SELECT user_id, CASE WHEN row_number() OVER (ORDER BY {lot(5, 'user_id')}, user_id) <= 200 THEN 'screen' ELSE 'confirm' END AS cohort, user_id IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1993-01-01') AS historical FROM (SELECT DISTINCT user_id FROM tgt)"))
def _(t: Tables) -> DataFrame:
    """Cohorts, and whether the user had ordered before 1993."""
    past = t.read("orders").where("o_orderdate < DATE '1993-01-01'").select(F.col("o_custkey").alias("user_id"))
    return sampling.split_cohorts(t.targets, 200, 5, past)


@query("i_hash_tree", using("ded", f"""SELECT 0 AS level, CAST(spot // 1024 AS BIGINT) AS node, bit_xor({lot(0, 'spot', 'user_id', 'item_id', 'ts', 'rating', 'category', 'brand')}) AS hash FROM (SELECT *, row_number() OVER (ORDER BY user_id, ts, item_id) - 1 AS spot FROM ded) GROUP BY 2"""))
def _(t: Tables) -> DataFrame:
    """The leaves of the tree over the log in the order of users and time."""
    return metrics.hash_tree(t.ded, ["user_id", "ts", "item_id"]).where("level = 0")


@query("i_fingerprint", using("ded", f"SELECT count(*) AS rows, bit_xor({lot(0, 'user_id', 'item_id', 'ts', 'rating', 'category', 'brand')}) AS hash FROM ded"))
def _(t: Tables) -> DataFrame:
    return metrics.fingerprint(t.ded)


@query("e_attribution", using("stacked reach", """SELECT channel, users_hit, target_hits, reachable, outside, unreachable, mean_size, min_size, max_size FROM (
  SELECT channel, count(DISTINCT CASE WHEN h THEN user_id END) AS users_hit, count(*) FILTER (h) AS target_hits, count(*) FILTER (c) AS reachable, count(*) FILTER (c AND NOT h) AS outside, count(*) FILTER (NOT c) AS unreachable FROM (
    SELECT n.channel, t.user_id, t.item_id, EXISTS (SELECT 1 FROM s WHERE s.channel = n.channel AND s.user_id = t.user_id AND s.item_id = t.item_id) AS h, EXISTS (SELECT 1 FROM r WHERE r.channel = n.channel AND r.user_id = t.user_id AND r.item_id = t.item_id) AS c
    FROM (SELECT DISTINCT * FROM tgt) t, n) GROUP BY 1) JOIN (SELECT channel, round(avg(k), 6) AS mean_size, min(k) AS min_size, max(k) AS max_size FROM (SELECT n.channel, u.user_id, (SELECT count(*) FROM s WHERE s.channel = n.channel AND s.user_id = u.user_id) AS k FROM (SELECT DISTINCT user_id FROM tgt) u, n) GROUP BY 1) USING (channel)""",
  """s AS (SELECT channel, user_id, item_id FROM stacked UNION SELECT 'all', user_id, item_id FROM stacked), r AS (SELECT * FROM reach UNION SELECT 'all', user_id, item_id FROM reach), n AS (SELECT unnest(['cf', 'category', 'hot', 'all']) AS channel)"""))
def _(t: Tables) -> DataFrame:
    on = ["user_id", "item_id"]
    liked = channels.preferred(t.hist, "category").groupBy("user_id").agg(F.collect_set("category").alias("liked"))
    alike = F.when(F.array_contains("liked", F.col("category")), "category")
    want = t.fw.where("split = 'target'").select(*on, "category").join(liked, "user_id", "left").select(*on, F.array_compact(F.array(F.lit("hot"), F.lit("cf"), alike)).alias("channels"))
    popular = want.join(t.hot.select("item_id"), "item_id", "left_semi").select(F.explode("channels").alias("channel"), *on)
    all_ = popular.unionByName(channels.reached(channels.recent(t.hist), t.targets, t.sim).select(F.lit("cf").alias("channel"), *on))
    return metrics.attribution(t.stacked, all_, t.targets, ["hot", "cf", "category"])


@query("g_reach_by_length", using("tgt hist sim", """SELECT hist_len, count(*) AS users, CAST(sum(reached) AS BIGINT) AS reached FROM (SELECT user_id, count(*) AS hist_len FROM hist GROUP BY 1) JOIN (
  SELECT user_id, max(CAST(EXISTS (SELECT 1 FROM hist h JOIN sim s ON s.item_id = h.item_id WHERE h.user_id = t.user_id AND s.neighbor = t.item_id) AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = t.user_id AND h.item_id = t.item_id) AS INTEGER)) AS reached FROM tgt t GROUP BY 1) USING (user_id) GROUP BY 1"""))
def _(t: Tables) -> DataFrame:
    return metrics.reach_by_length(metrics.reachability(t.targets, t.hist, t.sim), t.hist)


@query("e_exposure_groups", using("pool hot5 tgt hist", """SELECT grp, count(*) AS users, round(count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE), 6) AS share, round(avg(o), 6) AS old_mean, round(avg(n), 6) AS new_mean, round(avg(n - o), 6) AS delta FROM b GROUP BY 1""",
  """b AS (SELECT user_id, CASE WHEN len <= 5 THEN 'short' WHEN len <= 20 THEN 'middle' ELSE 'long' END AS grp, CAST(EXISTS (SELECT 1 FROM hot5 h JOIN tgt USING (user_id, item_id) WHERE h.user_id = u.user_id) AS DOUBLE) AS o,
  CAST(EXISTS (SELECT 1 FROM pool p JOIN tgt USING (user_id, item_id) WHERE p.user_id = u.user_id AND p.rank <= 5) AS DOUBLE) AS n FROM (SELECT user_id, count(*) AS len FROM hist GROUP BY 1) u)"""))
def _(t: Tables) -> DataFrame:
    hit = lambda ranked, name: t.targets.join(ranked.where("rank <= 5").select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").select("user_id").distinct().withColumn(name, F.lit(1.0))
    users = t.hist.groupBy("user_id").agg(F.count("*").alias("len"))
    paired = users.join(hit(t.hot5, "old"), "user_id", "left").join(hit(t.pool, "new"), "user_id", "left").na.fill(0.0, ["old", "new"])
    group = F.when(F.col("len") <= 5, "short").when(F.col("len") <= 20, "middle").otherwise("long")
    out = metrics.grouped_delta(paired, group)
    return out.select("grp", "users", *[F.round(c, 6).alias(c) for c in ("share", "old_mean", "new_mean", "delta")])


@query("e_leave_last_out", using("pool tgt hot fw", """SELECT round(avg(auc), 6) AS auc, round(avg(p), 6) AS pos_mean, count(*) AS users FROM (
  SELECT user_id, any_value(a.s) AS p, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc FROM a JOIN b USING (user_id) GROUP BY 1)""", """sc AS (SELECT item_id, ln(1 + CAST(cnt AS DOUBLE)) AS s FROM hot),
  a AS (SELECT user_id, coalesce(s, 0.0) AS s FROM (SELECT user_id, item_id FROM fw WHERE split = 'target' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) = 1) LEFT JOIN sc USING (item_id)),
  b AS (SELECT user_id, s FROM (SELECT user_id, item_id FROM pool p WHERE NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.user_id = p.user_id AND tgt.item_id = p.item_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank DESC) <= 20) JOIN sc USING (item_id))"""))
def _(t: Tables) -> DataFrame:
    """The last target of a user against 20 unseen items that aren't targets, scored by popularity."""
    score = t.hot.select("item_id", F.log1p("cnt").alias("score"))
    back = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("item_id").desc())
    last = t.fw.where("split = 'target'").withColumn("b", F.row_number().over(back)).where("b = 1").select("user_id", "item_id")
    low = Window.partitionBy("user_id").orderBy(F.col("rank").desc())
    other = channels.unseen(t.pool, t.targets).withColumn("n", F.row_number().over(low)).where("n <= 20").select("user_id", "item_id")
    return metrics.leave_last_out(last.join(score, "item_id", "left").na.fill(0.0, ["score"]), other.join(score, "item_id"), 20)


@query("e_pool_changes", using("cf fused", """SELECT count(*) AS users, sum(CAST(x = y AS BIGINT)) AS same_order, sum(CAST(list_sort(x) = list_sort(y) AS BIGINT)) AS same_set, sum(len(list_intersect(x, y))) AS shared, sum(len(y) - len(list_intersect(x, y))) AS added,
  sum(len(x) - len(list_intersect(x, y))) AS removed, round(avg(len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE)), 6) AS jaccard,
  sum(CAST(list_sort(x[11:25]) <> list_sort(y[11:25]) AS BIGINT)) AS changed_11_25, sum(CAST(list_sort(x[26:50]) <> list_sort(y[26:50]) AS BIGINT)) AS changed_26_50
  FROM (SELECT user_id, list(item_id ORDER BY rank) AS x FROM cf GROUP BY 1) JOIN (SELECT user_id, list(item_id ORDER BY rank) AS y FROM fused GROUP BY 1) USING (user_id)"""))
def _(t: Tables) -> DataFrame:
    return metrics.pool_changes(t.cf, fusion.rrf(t.stacked, WEIGHTS, BUDGET))


@query("e_mean_cosine", """SELECT CAST(any_value(c) AS BIGINT) AS vectors, round(sum(s) / (any_value(c) * (any_value(c) - 1.0)), 6) AS mean_cosine FROM (SELECT count(*) OVER () AS c, * FROM embeddings) a,
  LATERAL (SELECT sum(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s FROM embeddings b WHERE b.vec_id <> a.vec_id)""")
def _(t: Tables) -> DataFrame:
    return metrics.mean_cosine(t.read("embeddings"))
