"""Queries on rerankers, losses of batches, bootstrap intervals and the acceptance of challengers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import metrics, ranking, similarity

from .oracle import using
from .recommend import Tables
from .registry import query

_TOP = "CAST(rank AS INTEGER) AS rank"
_VEC = "iv AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _vectors(t: Tables) -> DataFrame:
    return t.read("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))


# rerankers
D, UNITS, HIDDEN = 64, 2, 2


def _weights(block: int, row: int, length: int = D, of: str = "v", before: int = 0) -> str:
    """Inner product, in SQL, of ``of`` with a row of the parameters that ``TargetAttention.by_rule`` takes as its ``block``-th table of rows of 64."""
    start = before + (block * 2 + row) * length
    return f"list_dot_product({of}, list_transform(range(1, {length + 1}), lambda i: sin(CAST({start} + i AS DOUBLE)) / sqrt({length}.0::DOUBLE)))"


def _scaled(block: int, row: int, before: int = 0) -> str:
    start = before + (block * 2 + row) * D
    return f"list_transform(v, lambda x, i: x * sin(CAST({start} + i AS DOUBLE)) / sqrt({D}.0::DOUBLE))"


def _single(at: int) -> str:
    return f"sin({at}.0::DOUBLE)"


_A, _B = 3 * UNITS * D, 3 * UNITS * D + 2 * UNITS  # numbers taken before the units' biases, and before the hidden tables
_C = _B + 3 * HIDDEN * D  # before the features' table
_UNIT = [f"greatest(p{r} + q{r} + list_dot_product(b{r}, c.v) + {_single(_A + 1 + r)}, 0) * {_single(_A + UNITS + 1 + r)}" for r in range(UNITS)]
_ATTENTION = f"""{_VEC}, z AS (SELECT list_transform(range(64), lambda i: 0.0::DOUBLE) AS v),
  cv AS (SELECT p.user_id, p.item_id, coalesce(iv.v, z.v) AS v FROM pool p CROSS JOIN z LEFT JOIN iv USING (item_id)),
  ci AS (SELECT item_id, any_value(v) AS v FROM cv GROUP BY 1),
  cq AS (SELECT item_id, {", ".join(f"{_weights(1, r)} AS q{r}, {_weights(0, r, before=_B)} AS m{r}, {_scaled(2, r, before=_B)} AS x{r}" for r in range(2))} FROM ci),
  hq AS (SELECT item_id, v AS hv, {", ".join(f"{_weights(0, r)} AS p{r}, {_scaled(2, r)} AS b{r}, {_weights(1, r, before=_B)} AS i{r}" for r in range(2))} FROM iv),
  hs AS (SELECT r.user_id, hq.* FROM recent r JOIN hq USING (item_id)),
  att AS (SELECT c.user_id, c.item_id, {", ".join(f"avg(({' + '.join(_UNIT)}) * h.i{r}) AS n{r}" for r in range(2))} FROM cv c JOIN cq USING (item_id) JOIN hs h ON h.user_id = c.user_id GROUP BY 1, 2),
  um AS (SELECT user_id, list(x ORDER BY k) AS u FROM (SELECT user_id, k, avg(hv[k]) AS x FROM hs, range(1, 65) AS r(k) GROUP BY 1, 2) GROUP BY 1),
  ft AS (SELECT user_id, ln(1 + count(*)) AS f0, count(DISTINCT category) / CAST(count(*) AS DOUBLE) AS f1 FROM hist GROUP BY 1),
  sc AS (SELECT c.user_id, c.item_id, {" + ".join(f"greatest(m{r} + coalesce(n{r}, 0) + CASE WHEN um.u IS NULL THEN 0 ELSE list_dot_product(x{r}, um.u) END + f0 * sin({_C + 2 * r + 1}.0::DOUBLE) / sqrt(2.0::DOUBLE) + f1 * sin({_C + 2 * r + 2}.0::DOUBLE) / sqrt(2.0::DOUBLE) + {_single(_C + 5 + r)}, 0) * {_single(_C + 7 + r)}" for r in range(2))} AS score
    FROM cv c JOIN cq USING (item_id) JOIN ft USING (user_id) LEFT JOIN att USING (user_id, item_id) LEFT JOIN um USING (user_id))"""


@query("m_attention_rank", using("pool recent hist", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc) WHERE rank <= 5", _ATTENTION))
def _(t: Tables) -> DataFrame:
    """The pool reranked by target attention over a user's last items; the parameters are fixed by a rule, not trained."""
    about = t.hist.groupBy("user_id").agg(F.array(F.log1p(F.count("*")), F.count_distinct("category") / F.count("*")).alias("x"))
    got = ranking.attention_rank(t.pool, t.hist, _vectors(t), about, ranking.TargetAttention.by_rule(D, 2, UNITS, HIDDEN), 5)
    return got.select("user_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


# losses
@query("m_sampled_softmax", using("pool", """SELECT user_id, round(m + ln(sum(exp(score / 0.05 - m))) - max(p), 6) AS loss FROM (SELECT user_id, score, max(score / 0.05) OVER (PARTITION BY user_id) AS m, CASE WHEN rank = 3 THEN score / 0.05 END AS p FROM pool WHERE rank <= 20) GROUP BY user_id, m HAVING max(p) IS NOT NULL"""))
def _(t: Tables) -> DataFrame:
    """The third item of a pool as the positive among the others of the first twenty."""
    top = t.pool.where("rank <= 20").groupBy("user_id").agg(F.max(F.when(F.col("rank") == 3, F.col("score"))).alias("p"), F.collect_list(F.when(F.col("rank") != 3, F.col("score"))).alias("n")).where("p is not null")
    return top.select("user_id", F.round(ranking.sampled_softmax_loss(F.col("p"), F.col("n"), 0.05), 6).alias("loss"))


_BATCHES = f"""{_VEC}, um AS (SELECT user_id, list(x ORDER BY k) AS u FROM (SELECT user_id, k, avg(v[k]) AS x FROM hist JOIN iv USING (item_id), range(1, 65) AS r(k) GROUP BY 1, 2) GROUP BY 1),
  p AS (SELECT user_id, item_id, u, v, CAST((row_number() OVER (ORDER BY md5('0:' || user_id || ':' || item_id), user_id, item_id) - 1) // 256 AS INTEGER) AS batch FROM (SELECT DISTINCT user_id, item_id FROM tgt) JOIN um USING (user_id) JOIN iv USING (item_id)),
  l AS (SELECT a.user_id, a.item_id, a.batch, a.item_id = b.item_id AND a.user_id = b.user_id AS own, list_dot_product(a.u, b.v) / 0.5 AS x FROM p a JOIN p b USING (batch)
    WHERE (a.item_id = b.item_id AND a.user_id = b.user_id) OR (a.item_id <> b.item_id AND a.user_id <> b.user_id AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = a.user_id AND h.item_id = b.item_id))),
  nb AS (SELECT item_id, neighbor FROM (SELECT a.vec_id AS item_id, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id) WHERE r <= 2),
  h AS (SELECT p.user_id, p.item_id, list_dot_product(p.u, n.v) / 0.5 AS x, list_dot_product(p.u, p.v) / 0.5 AS o FROM p JOIN nb ON nb.item_id = p.item_id JOIN iv n ON n.item_id = nb.neighbor),
  a AS (SELECT user_id, item_id, batch, count(*) - 1 AS negatives, max(x) + ln(sum(exp(x - m))) - max(CASE WHEN own THEN x END) AS in_batch FROM (SELECT *, max(x) OVER (PARTITION BY user_id, item_id) AS m FROM l) GROUP BY 1, 2, 3),
  b AS (SELECT user_id, item_id, greatest(max(x), max(o)) + ln(sum(exp(x - m)) + max(exp(o - m))) - max(o) AS hard FROM (SELECT *, greatest(max(x) OVER (PARTITION BY user_id, item_id), o) AS m FROM h) GROUP BY 1, 2)"""


@query("m_in_batch_loss", using("tgt hist", "SELECT user_id, item_id, batch, negatives, round(in_batch, 6) AS in_batch, round(coalesce(hard, 0), 6) AS hard, round(in_batch + 0.3::DOUBLE * coalesce(hard, 0), 6) AS loss FROM a LEFT JOIN b USING (user_id, item_id)", _BATCHES))
def _(t: Tables) -> DataFrame:
    """Targets against the other targets of batches of 256, user vectors being the means of their items', and two neighbours of the same label as hard negatives."""
    items = _vectors(t)
    each = t.hist.join(items, "item_id").select("user_id", F.posexplode("v").alias("d", "x"))
    mean = each.groupBy("user_id", "d").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("u"))
    pairs = t.targets.distinct().join(mean, "user_id").join(items, "item_id").select("user_id", "item_id", "u", "v")
    near = similarity.same_label_neighbors(t.read("embeddings"), 2).select("item_id", F.col("neighbor").alias("n"))
    hard = near.join(items.select(F.col("item_id").alias("n"), F.col("v").alias("w")), "n").select("item_id", "w")
    got = ranking.in_batch_loss(pairs, t.hist, hard, temperature=0.5, batch=256)
    return got.select("user_id", "item_id", "batch", "negatives", *[F.round(c, 6).alias(c) for c in ("in_batch", "hard", "loss")])


# comparisons
_RANKED = {"1": "pool", "2": "cf", "3": "cat"}


def _user(name: str) -> str:
    return f"""SELECT user_id, CAST(coalesce(f, 0) > 0 AS INTEGER) AS hit, coalesce(d, 0.0) / list_sum(list_transform(range(1, CAST(least(5, n) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
  FROM (SELECT user_id, count(*) AS n FROM tgt GROUP BY 1) LEFT JOIN (SELECT user_id, count(*) AS f, sum(1 / log2(rank + 1)) AS d FROM {name} JOIN tgt USING (user_id, item_id) WHERE rank <= 5 GROUP BY 1) USING (user_id)"""


def _drawn(rows: str, draws: int, *columns: str) -> str:
    """Bootstrap means of the columns of ``rows`` as the table ``bs``: the hash and the Poisson weights in SQL."""
    low = "& 4294967295::UBIGINT"
    mixed = lambda h: f"(SELECT xor(c, c >> 16) FROM (SELECT (xor(b, b >> 13) * 3266489909::UBIGINT) {low} AS c FROM (SELECT (xor(a, a >> 16) * 2246822507::UBIGINT) {low} AS b FROM (SELECT {h} AS a))))"
    weight = " + ".join(f"CAST(u > {float(p)!r}::DOUBLE AS INTEGER)" for p in metrics.POISSON)
    means = ", ".join(f"sum(w * {c}) / CAST(sum(w) AS DOUBLE) AS {c}" for c in columns)
    return f"""k AS (SELECT *, {mixed(f"xor(CAST(user_id AS UBIGINT) {low}, 20::UBIGINT)")} AS own FROM {rows}),
  hsh AS (SELECT k.*, draw, (k.own + CAST(draw AS UBIGINT) * 2654435761::UBIGINT) {low} AS a0 FROM k, range({draws}) AS r(draw)),
  h1 AS (SELECT *, (xor(a0, a0 >> 16) * 2246822507::UBIGINT) {low} AS a1 FROM hsh), h2 AS (SELECT *, (xor(a1, a1 >> 13) * 3266489909::UBIGINT) {low} AS a2 FROM h1),
  wt AS (SELECT *, {weight} AS w FROM (SELECT *, (CAST(xor(a2, a2 >> 16) AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE AS u FROM h2)),
  bs AS (SELECT draw, {means} FROM wt GROUP BY draw)"""


_DELTA = f"o AS ({_user('hot5')}), dl AS (SELECT user_id, n.hit - o.hit AS hr, n.ndcg - o.ndcg AS ndcg FROM ({_user('pool')}) n JOIN o USING (user_id))"


@query("e_bootstrap", using("pool hot5 tgt", " UNION ALL ".join(f"SELECT '{c}' AS metric, (SELECT count(*) FROM dl) AS users, round((SELECT avg({c}) FROM dl), 6) AS mean, round(quantile_cont({c}, 0.0125), 6) AS low, round(quantile_cont({c}, 0.9875), 6) AS high FROM bs" for c in ("hr", "ndcg")), f"{_DELTA}, {_drawn('dl', 500, 'hr', 'ndcg')}"))
def _(t: Tables) -> DataFrame:
    """Bootstrap intervals of the gain of the pool over popularity."""
    old, new = (metrics.user_metrics(r, t.targets, 5) for r in (t.hot5, t.pool))
    d = new.join(old.select("user_id", F.col("hit").alias("h0"), F.col("ndcg").alias("n0")), "user_id").select("user_id", (F.col("hit") - F.col("h0")).alias("hr"), (F.col("ndcg") - F.col("n0")).alias("ndcg"))
    return metrics.bootstrap(d, ["hr", "ndcg"], draws=500).select("metric", "users", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


_SEEDS = " UNION ALL ".join(f"SELECT {s} AS seed, CASE WHEN md5('5:' || user_id) < '8' THEN 'screen' ELSE 'confirm' END AS cohort, user_id, n.hit - o.hit AS hr, n.ndcg - o.ndcg AS ndcg FROM ({_user(r)}) n JOIN o USING (user_id)" for s, r in _RANKED.items())
_GATE = f"""o AS ({_user('hot5')}), dl AS ({_SEEDS}), per AS (SELECT cohort, seed, avg(hr) AS hr, avg(ndcg) AS ndcg FROM dl GROUP BY 1, 2),
  m AS (SELECT avg(hr) FILTER (cohort = 'screen') AS screen_hr, avg(ndcg) FILTER (cohort = 'screen') AS screen_ndcg, avg(hr) FILTER (cohort = 'confirm') AS confirm_hr, avg(ndcg) FILTER (cohort = 'confirm') AS confirm_ndcg,
    min(hr) FILTER (cohort = 'confirm') AS worst_hr, stddev_samp(hr) FILTER (cohort = 'confirm') AS hr_spread FROM per),
  pooled AS (SELECT user_id, avg(hr) AS hr FROM dl WHERE cohort = 'confirm' GROUP BY 1), {_drawn('pooled', 500, 'hr')},
  e AS (SELECT (SELECT count(*) FROM pooled) AS users, quantile_cont(hr, 0.0125) AS low, quantile_cont(hr, 0.9875) AS high FROM bs)"""
_TESTS = {"screen_gains": "screen_hr > 0", "screen_holds": "screen_ndcg >= 0", "every_seed_gains": "worst_hr > 0", "gain_suffices": "confirm_hr >= 0.0005", "interval_gains": "low > 0", "confirm_holds": "confirm_ndcg >= 0"}
_FIGURES = ("screen_hr", "screen_ndcg", "confirm_hr", "confirm_ndcg", "worst_hr", "hr_spread", "low", "high")


@query("e_acceptance", using("pool cf cat hot5 tgt", f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in _FIGURES)}, users, {', '.join(f'{x} AS {c}' for c, x in _TESTS.items())}, {' AND '.join(f'({x})' for x in _TESTS.values())} AS accepted FROM m, e", _GATE))
def _(t: Tables) -> DataFrame:
    """The six conditions over three challengers of popularity, which stand for the runs of three seeds."""
    old = metrics.user_metrics(t.hot5, t.targets, 5).select("user_id", F.col("hit").alias("h0"), F.col("ndcg").alias("n0"))
    cohort = F.when(F.md5(F.concat_ws(":", F.lit("5"), "user_id")) < "8", "screen").otherwise("confirm").alias("cohort")
    all_ = None
    for seed, ranked in ((1, t.pool), (2, t.cf), (3, t.category)):
        d = metrics.user_metrics(ranked, t.targets, 5).join(old, "user_id").select(F.lit(seed).alias("seed"), cohort, "user_id", (F.col("hit") - F.col("h0")).alias("hr"), (F.col("ndcg") - F.col("n0")).alias("ndcg"))
        all_ = d if all_ is None else all_.unionByName(d)
    got = metrics.acceptance(all_, draws=500)
    return got.select(*[F.round(c, 6).alias(c) for c in _FIGURES], "users", *_TESTS, "accepted")


@query("e_channel_overlap", using("stacked", """SELECT a, b, count(*) AS users, CAST(sum(s) AS BIGINT) AS shared, round(avg(s / CAST(n AS DOUBLE)), 6) AS mean_jaccard FROM (
  SELECT a, b, user_id, count(*) FILTER (x AND y) AS s, count(*) AS n FROM (SELECT a, b, user_id, item_id, bool_or(channel = a) AS x, bool_or(channel = b) AS y FROM stacked JOIN (VALUES ('cf', 'category'), ('cf', 'hot'), ('category', 'hot')) p(a, b) ON channel IN (a, b) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def _(t: Tables) -> DataFrame:
    return metrics.pairwise_overlap(t.stacked, ["cf", "category", "hot"])


@query("e_category_groups", using("um tgt", "SELECT p_type AS category, count(*) AS users, round(avg(hit), 6) AS hr FROM um JOIN (SELECT user_id, min(item_id) AS item_id FROM tgt GROUP BY 1) USING (user_id) LEFT JOIN part ON p_partkey = item_id GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    one = t.targets.groupBy("user_id").agg(F.min("item_id").alias("item_id"))
    return metrics.by_category(metrics.user_metrics(t.pool, t.targets, 5).join(one, "user_id"), t.dim)
