"""Queries on similarity, retrieval channels, fusion and sampling."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import channels, fusion, sampling, sequence, similarity, training
from tidewheel.operators.shared import signed_round

from .oracle import PARTS, inner, lot, random_items, using
from .recommend import BUDGET, WEIGHTS, Tables
from .registry import query


def _r(df: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    return df.select(*keys, F.round(score, 6).alias(score), F.col("rank").cast("int").alias("rank"))


_TOP = "CAST(rank AS INTEGER) AS rank"


# similarity
@query("j_cosine_iuf", using("sim", f"SELECT item_id, neighbor, round(sim, 6) AS sim, {_TOP} FROM sim"))
def _(t: Tables) -> DataFrame:
    return _r(t.sim, "item_id", "neighbor", score="sim")


@query("j_time_decayed", using("train", f"SELECT item_id, neighbor, round(sim, 6) AS sim, {_TOP} FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, neighbor) AS rank FROM s) WHERE rank <= 10 AND sim > 0", """e AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM train), c AS (SELECT item_id, count(*) AS c FROM train GROUP BY 1),
  s AS (SELECT p.item_id, p.neighbor, w / sqrt(CAST(a.c AS DOUBLE) * b.c) AS sim FROM (SELECT x.item_id, y.item_id AS neighbor, sum(CASE WHEN y.ts > x.ts THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END * exp(-abs(y.ts - x.ts) / 86400000.0) / ln(1 + x.n)) AS w
  FROM e x JOIN e y USING (user_id) WHERE x.item_id <> y.item_id GROUP BY 1, 2) p JOIN c a USING (item_id) JOIN c b ON b.item_id = p.neighbor WHERE w > 0)"""))
def _(t: Tables) -> DataFrame:
    return _r(similarity.time_decayed(t.train, 10), "item_id", "neighbor", score="sim")


@query("j_same_label_neighbors", f"""SELECT item_id, neighbor, round(sim, 6) AS sim, {_TOP} FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, neighbor) AS rank FROM (
  SELECT a.vec_id AS item_id, b.vec_id AS neighbor, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id)) WHERE rank <= 5""")
def _(t: Tables) -> DataFrame:
    return _r(similarity.same_label_neighbors(t.read("embeddings"), 5), "item_id", "neighbor", score="sim")


@query("j_vector_top_k", f"""SELECT record, item_id, round(score, 6) AS score, {_TOP} FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT a.vec_id AS record, b.vec_id AS item_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10""")
def _(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    return _r(similarity.vector_top_k(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("record"), F.col("embedding").alias("q")), e, 10), "record", "item_id")


@query("n_popular_in_category", using("hot", "SELECT item_id, neighbor, CAST(rank AS INTEGER) AS rank FROM (SELECT a.item_id, b.item_id AS neighbor, row_number() OVER (PARTITION BY a.item_id ORDER BY b.cnt DESC, b.item_id) AS rank FROM c a JOIN c b USING (category) WHERE a.item_id <> b.item_id) WHERE rank <= 4", "c AS (SELECT item_id, p_type AS category, cnt FROM hot JOIN part ON p_partkey = item_id)"))
def _(t: Tables) -> DataFrame:
    return similarity.popular_in_category(t.hot.join(t.dim, "item_id").select("item_id", "category", "cnt"), 4)


@query("n_hard_negatives", using("sim hot", "SELECT item_id, neighbor, CAST(rank AS INTEGER) AS rank FROM (SELECT s.item_id, s.neighbor, row_number() OVER (PARTITION BY s.item_id ORDER BY s.rank) AS rank FROM sim s WHERE s.rank <= 12 AND s.neighbor IN (SELECT item_id FROM hot)) WHERE rank <= 4"))
def _(t: Tables) -> DataFrame:
    return similarity.hard_negatives(t.sim, t.hot, 4)


@query("j_propagation")
def _propagated(t: Tables) -> DataFrame:
    edges = t.train.select((F.col("user_id") * 10 + 1).alias("a"), (F.col("item_id") * 10 + 2).alias("b"))
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    vec = ids.select("id", F.array(*[F.sin(F.col("id") * k) for k in (1, 2, 3)]).alias("v"))
    return similarity.propagate(edges, vec)


_LAYERS = ", ".join(f"l{n} AS MATERIALIZED (SELECT e.a AS id, v.k, sum(e.w * v.x) AS x FROM e JOIN l{n - 1} v ON v.id = e.b GROUP BY 1, 2)" for n in (1, 2, 3))


@query("j_propagation_rounded", using("train", "SELECT id, list(round(x, 6) ORDER BY k) AS v FROM (SELECT id, k, sum(x) / 4 AS x FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1, 2) GROUP BY 1", f"""b AS (SELECT user_id * 10 + 1 AS a, item_id * 10 + 2 AS b FROM train UNION ALL SELECT item_id * 10 + 2, user_id * 10 + 1 FROM train), d AS (SELECT a, count(*) AS d FROM b GROUP BY 1),
  e AS MATERIALIZED (SELECT b.a, b.b, 1 / sqrt(CAST(x.d AS DOUBLE) * y.d) AS w FROM b JOIN d x ON x.a = b.a JOIN d y ON y.a = b.b), l0 AS MATERIALIZED (SELECT a AS id, k - 1 AS k, sin(a * k) AS x FROM d, range(1, 4) AS r(k)), {_LAYERS}"""))
def _(t: Tables) -> DataFrame:
    """The same vectors to six digits, which SQL states."""
    return _propagated(t).select("id", F.transform("v", lambda x: signed_round(x, 6)).alias("v"))


# channels
@query("f_item_cf", using("cf", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM cf"))
def _(t: Tables) -> DataFrame:
    return _r(t.cf, "user_id", "item_id")


@query("f_legacy_item_cf", using("hist sim", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s) WHERE rank <= 20", """s AS (SELECT r.user_id, s.neighbor AS item_id, sum(d * s.sim) AS score FROM (SELECT *, exp(-((max(ts) OVER (PARTITION BY user_id) - ts) / 86400000.0) / 7.0) AS d FROM hist) r JOIN sim s USING (item_id)
  WHERE s.rank <= 10 AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = r.user_id AND h.item_id = s.neighbor) GROUP BY 1, 2)"""))
def _(t: Tables) -> DataFrame:
    return _r(channels.legacy_item_cf(t.hist, t.sim, t.hist, 20), "user_id", "item_id")


@query("f_category", using("cat", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM cat"))
def _(t: Tables) -> DataFrame:
    return _r(t.category, "user_id", "item_id")


@query("f_legacy_category", using("hist hot", f"SELECT user_id, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank FROM c", """p AS (SELECT user_id, category, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS share FROM hist GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) <= 3),
  k AS (SELECT p_type AS category, item_id, row_number() OVER (PARTITION BY p_type ORDER BY hot_rank) AS r FROM hot JOIN part ON p_partkey = item_id), c AS (SELECT user_id, item_id, share * 0.5 AS score FROM p JOIN k USING (category) WHERE r <= 20)"""))
def _(t: Tables) -> DataFrame:
    return _r(channels.legacy_category(t.hist, t.dim, t.hot), "user_id", "item_id")


@query("f_brand", using("recent hot hist", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM c) WHERE rank <= 75", """p AS (SELECT user_id, brand, count(*) AS cnt, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS len FROM recent GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, brand) <= 3),
  c AS (SELECT user_id, item_id, cnt / len / place AS score FROM (SELECT p.*, h.item_id, row_number() OVER (PARTITION BY p.user_id, p.brand ORDER BY h.hot_rank) AS place FROM p JOIN part ON p_brand = p.brand JOIN hot h ON h.item_id = p_partkey
  WHERE NOT EXISTS (SELECT 1 FROM hist x WHERE x.user_id = p.user_id AND x.item_id = h.item_id)) WHERE place <= 75)"""))
def _(t: Tables) -> DataFrame:
    return _r(t.brand, "user_id", "item_id")


@query("f_hot", using("hot5", f"SELECT user_id, item_id, round(CAST(score AS DOUBLE), 6) AS score, {_TOP} FROM hot5"))
def _(t: Tables) -> DataFrame:
    return _r(t.hot5, "user_id", "item_id")


@query("f_multi_interest", f"""SELECT user_id, item_id, round(1.0::DOUBLE / rank, 6) AS score, {_TOP} FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY k) AS rank FROM (SELECT user_id, item_id, min(interest * 1000 + r) AS k FROM i GROUP BY 1, 2)) WHERE rank <= 12
""".replace("SELECT user_id, item_id, round", """WITH i AS (SELECT user_id, interest, item_id, row_number() OVER (PARTITION BY user_id, interest ORDER BY round(s, 9) DESC, item_id) AS r FROM (
  SELECT a.label AS user_id, a.vec_id % 3 AS interest, b.vec_id AS item_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM (SELECT label, vec_id % 3, min_by(embedding, vec_id) AS embedding, min(vec_id) AS vec_id FROM embeddings GROUP BY 1, 2) a, embeddings b) QUALIFY r <= 8)
  SELECT user_id, item_id, round""", 1))
def _(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    q = e.groupBy("label", (F.col("vec_id") % 3).alias("interest")).agg(F.min_by("embedding", "vec_id").alias("q"))
    near = similarity.vector_top_k(q.select(F.struct("label", "interest").alias("record"), "q"), e, 8)
    return _r(channels.multi_interest(near.select(F.col("record.label").alias("user_id"), F.col("record.interest").alias("interest"), "item_id", "rank"), 12), "user_id", "item_id")


@query("f_vector", using("vec", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM vec"))
def _(t: Tables) -> DataFrame:
    return _r(t.vector, "user_id", "item_id")


@query("f_four_channels", using("pool4", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM pool4"))
def _(t: Tables) -> DataFrame:
    return _r(t.four_channels, "user_id", "item_id")


@query("f_refilled_pool", using("pool", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM pool"))
def _(t: Tables) -> DataFrame:
    return _r(t.pool, "user_id", "item_id")


@query("f_recommend_top5", using("pool", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM pool WHERE rank <= 5"))
def _(t: Tables) -> DataFrame:
    return _r(t.pool.where("rank <= 5"), "user_id", "item_id")


# fusion
@query("f_rrf", using("fused", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM fused"))
def _(t: Tables) -> DataFrame:
    return _r(fusion.rrf(t.stacked, WEIGHTS, BUDGET, placed=True), "user_id", "item_id")


_QUOTA = """q AS (SELECT *, CAST(w AS DOUBLE) * score AS ws, row_number() OVER (PARTITION BY channel, user_id ORDER BY rank) <= greatest(1, floor(20 * CAST(w AS DOUBLE) / 2.75)) AS c FROM stacked),
  s AS (SELECT user_id, item_id, sum(ws) AS score, max(CAST(c AS INTEGER)) AS chosen FROM q GROUP BY 1, 2),
  k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY chosen DESC, round(score, 9) DESC, CAST(item_id AS VARCHAR)) <= 20)"""


@query("f_quota", using("stacked", "SELECT user_id, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, CAST(item_id AS VARCHAR)) AS INTEGER) AS rank FROM k", _QUOTA))
def _(t: Tables) -> DataFrame:
    return _r(fusion.quota(t.stacked, WEIGHTS, 20, placed=True), "user_id", "item_id")


@query("f_legacy_weighted", using("stacked", f"SELECT user_id, item_id, round(score, 6) AS score, {_TOP} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (SELECT user_id, item_id, sum(score * CAST(w AS DOUBLE)) AS score FROM stacked WHERE rank <= greatest(3, floor(30 * CAST(w AS DOUBLE) / 2.75)) GROUP BY 1, 2)) WHERE rank <= 30"))
def _(t: Tables) -> DataFrame:
    return _r(fusion.legacy_weighted(t.stacked, WEIGHTS, 30), "user_id", "item_id")


@query("f_union_pool", using("stacked", "SELECT user_id, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank FROM (SELECT user_id, item_id, max(1.0::DOUBLE / rank) AS score FROM stacked GROUP BY 1, 2)"))
def _(t: Tables) -> DataFrame:
    return _r(fusion.union_pool(t.stacked), "user_id", "item_id")


@query("f_weight_grid", using("stacked tgt", """SELECT combo, round(coalesce(hits, 0) / CAST((SELECT count(DISTINCT user_id) FROM tgt) AS DOUBLE), 6) AS hr FROM (SELECT DISTINCT combo FROM g) LEFT JOIN (
  SELECT combo, count(DISTINCT user_id) AS hits FROM (SELECT combo, user_id, item_id, row_number() OVER (PARTITION BY combo, user_id ORDER BY round(sum(g.w / (60 + rank)), 9) DESC, item_id) AS r FROM stacked JOIN g USING (channel) GROUP BY 1, 2, 3) JOIN tgt USING (user_id, item_id) WHERE r <= 20 GROUP BY 1) USING (combo)""",
  "g AS (SELECT i * 3 + j AS combo, channel, CAST(CASE channel WHEN 'cf' THEN i + 1 WHEN 'category' THEN j * 0.5 + 0.1 ELSE 0.05 END AS DOUBLE) AS w FROM (VALUES (0), (1), (2)) a(i), (VALUES (0), (1), (2)) b(j), (VALUES ('cf'), ('category'), ('hot')) c(channel))"))
def _(t: Tables) -> DataFrame:
    rows = [(i * 3 + j, c, w) for i in range(3) for j in range(3) for c, w in (("cf", float(i + 1)), ("category", j * 0.5 + 0.1), ("hot", 0.05))]
    return fusion.weight_grid(t.stacked, t.spark.createDataFrame(rows, "combo int, channel string, w double"), t.targets, 20)


_GRID = {"cf": (0.5, 1.0, 1.2, 1.5, 2.0, 3.0), "vector": (1.0, 1.5, 2.0, 2.5, 3.0, 4.0), "category": (0.1, 0.3, 0.5, 0.7, 1.0), "hot": (0.05, 0.1, 0.2)}
_MORE = {"recent": (0.5, 1.0, 1.5, 2.0), "brand": (0.3, 0.5, 1.0, 1.5)}


def _grid_sql(names: list[str], grid: str) -> str:
    """Lists under every set of the table ``grid``, of the users with a target in a channel; channels in ``ch``."""
    total = " + ".join(names)
    each = " UNION ALL ".join(f"SELECT combo, '{c}' AS channel, {c} AS w, {total} AS total FROM {grid}" for c in names)
    return f"""(SELECT g.*, round(coalesce(h.hits, 0) / u.n, 6) AS hr, round(coalesce(h.dcg, 0.0) / u.n, 6) AS ndcg FROM {grid} g CROSS JOIN (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS n FROM tgt) u LEFT JOIN (
  SELECT combo, count(DISTINCT user_id) AS hits, sum(CASE WHEN r <= 20 THEN 1 / log2(r + 1) ELSE 0.0 END) AS dcg FROM (
    SELECT combo, user_id, item_id, row_number() OVER (PARTITION BY combo, user_id ORDER BY round(sum(q.w * score), 9) DESC, item_id) AS r FROM ch JOIN ({each}) q USING (channel)
    WHERE q.w > 0 AND rank <= greatest(3, floor(100 * q.w / total)) AND user_id IN (SELECT user_id FROM ch JOIN tgt USING (user_id, item_id)) GROUP BY 1, 2, 3) JOIN tgt USING (user_id, item_id) WHERE r <= 100 GROUP BY 1) h USING (combo))"""


def _lists_sql(lists: dict[str, tuple[float, ...]]) -> str:
    """All combinations, the last list varying fastest."""
    number, step = [], 1
    for c in reversed(lists):
        number.append(f"{c}_at * {step}")
        step *= len(lists[c])
    return f"SELECT CAST({' + '.join(number)} AS INTEGER) AS combo, {', '.join(lists)} FROM " + ", ".join(f"(SELECT unnest(range({len(v)})) AS {c}_at, unnest([{', '.join(f'{x}::DOUBLE' for x in v)}]) AS {c})" for c, v in lists.items())


_BRANDS = """bp AS (SELECT user_id, brand, count(*) AS cnt, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS len FROM recent GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, brand) <= 3),
  brd AS (SELECT user_id, item_id, cnt / len / place AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(cnt / len / place, 9) DESC, item_id) AS rank FROM (SELECT p.*, h.item_id, row_number() OVER (PARTITION BY p.user_id, p.brand ORDER BY h.hot_rank) AS place FROM bp p JOIN part ON p_brand = p.brand JOIN hot h ON h.item_id = p_partkey
    WHERE NOT EXISTS (SELECT 1 FROM hist x WHERE x.user_id = p.user_id AND x.item_id = h.item_id)) WHERE place <= 75 QUALIFY rank <= 75)"""
_CH = "ch AS (SELECT channel, user_id, item_id, CAST(score AS DOUBLE) AS score, rank FROM stacked UNION ALL SELECT 'vector', user_id, item_id, score, rank FROM vec{more})"
_FIRST = f"g4 AS ({_lists_sql(_GRID)})"


@query("f_weight_tuning", using("stacked vec tgt", f"SELECT * FROM {_grid_sql(list(_GRID), 'g4')}", f"{_CH.format(more='')}, {_FIRST}"))
def _tuned(t: Tables) -> DataFrame:
    """The whole grid of four channels, 540 sets."""
    return fusion.tune_weights([t.stacked, t.vector_rows], fusion.weight_sets(_GRID), t.targets)


@query("f_weight_tuning_six", using("stacked vec tgt hist sim recent hot", f"SELECT * FROM {_grid_sql([*_GRID, *_MORE], 'g6')}", f"""{_FIRST},
  rec AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (SELECT r.user_id, s.neighbor AS item_id, sum(d * s.sim) AS score FROM (SELECT *, exp(-((max(ts) OVER (PARTITION BY user_id) - ts) / 86400000.0) / 7.0) AS d FROM hist) r JOIN sim s USING (item_id)
    WHERE s.rank <= 10 AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = r.user_id AND h.item_id = s.neighbor) GROUP BY 1, 2) QUALIFY rank <= 75),
  {_BRANDS},
  {_CH.format(more=" UNION ALL SELECT 'recent', user_id, item_id, score, rank FROM rec UNION ALL SELECT 'brand', user_id, item_id, score, rank FROM brd")},
  ch4 AS (SELECT * FROM ch WHERE channel NOT IN ('recent', 'brand')),
  first4 AS (SELECT {', '.join(_GRID)} FROM {_grid_sql(list(_GRID), 'g4').replace('FROM ch JOIN tgt', "FROM ch4 JOIN tgt").replace('FROM ch JOIN (', 'FROM ch4 JOIN (')} ORDER BY hr DESC, combo LIMIT 1),
  more AS ({_lists_sql(_MORE)}), g6 AS (SELECT combo, {', '.join([*_GRID, *_MORE])} FROM more, first4)"""))
def _(t: Tables) -> DataFrame:
    """Second stage: the best of the first, with two more channels, 16 sets. The short-term item-item channel and the brands stand for the two models of the survey."""
    four = fusion.best_weights(_tuned(t), list(_GRID))
    more = {"recent": channels.legacy_item_cf(t.hist, t.sim, t.hist, BUDGET, parts=t.parts), "brand": t.brand}
    return fusion.tune_weights([t.stacked, t.vector_rows, *(fusion.stack({k: v}) for k, v in more.items())], fusion.weight_sets(_MORE, four), t.targets)


def _recipe_sql(name: str) -> str:
    """SQL tables of a recipe's pool, ``out_<name>``."""
    mode, half, brands = fusion.RECIPES[name]
    own = {c: w for c, w in fusion.RECIPE_WEIGHTS.items() if brands or c != "brand"}
    mine = ", ".join(re.sub(r"\b(recent|cfraw|cf)\b", rf"\1_{name}", PARTS[n]).replace("/ 90.0", f"/ {half or 1e300}") for n in ("recent", "cfraw", "cf"))
    source = {"cf": f"cf_{name}", "vector": "vec", "category": "cat", "hot": "hot5", "brand": "brd"}
    rows = " UNION ALL ".join(f"SELECT '{c}' AS channel, {w}::DOUBLE AS w, user_id, item_id, CAST(score AS DOUBLE) AS score, rank FROM {source[c]}" for c, w in own.items())
    if mode == "rrf":
        out = f"""SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (SELECT user_id, item_id, sum(w / (60 + place)) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY channel, user_id ORDER BY round(score, 9) DESC, item_id) AS place FROM st_{name}) GROUP BY 1, 2)"""
    else:
        out = f"""SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, CAST(item_id AS VARCHAR)) AS rank FROM (SELECT * FROM (SELECT user_id, item_id, sum(w * score) AS score, max(CAST(c AS INTEGER)) AS chosen FROM (
    SELECT *, row_number() OVER (PARTITION BY channel, user_id ORDER BY rank) <= greatest(1, floor({BUDGET} * w / {sum(own.values())!r}::DOUBLE)) AS c FROM st_{name}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY chosen DESC, round(score, 9) DESC, CAST(item_id AS VARCHAR)) <= {BUDGET})"""
    return f"{mine}, st_{name} AS ({rows}), out_{name} AS ({out})"


@query("f_recipes", using("cf vec cat hot5 recent sim hist unseen", " UNION ALL ".join(f"SELECT '{n}' AS recipe, user_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM out_{n} WHERE rank <= 5" for n in fusion.RECIPES), f"{_BRANDS}, " + ", ".join(map(_recipe_sql, fusion.RECIPES))))
def _(t: Tables) -> DataFrame:
    """The first five items of every user by every named recipe."""
    out = None
    for name in fusion.RECIPES:
        d = _r(t.recipe(name).where("rank <= 5"), "user_id", "item_id").withColumn("recipe", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


@query("f_popular_minus_known", using("unseen", "SELECT user_id, item_id, CAST(place AS INTEGER) AS rank FROM unseen WHERE place <= 20"))
def _(t: Tables) -> DataFrame:
    return channels.hot_items(t.hist, t.hot, t.hist, 20).select("user_id", "item_id", "rank")


# sampling, in the order of hashes that SQL has too
_KNOWN = "kn AS (SELECT user_id, item_id FROM fw WHERE eligible)"
_CFNEG = f"""cn AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {lot(0, 'user_id', 'item_id')}, item_id) AS INTEGER) AS place FROM (SELECT DISTINCT h.user_id, s.neighbor AS item_id FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) <= 10) h JOIN sim s USING (item_id)) c
  WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.user_id = c.user_id AND kn.item_id = c.item_id))"""


@query("n_random_negatives", using("hist hot", "SELECT * FROM rnd", f"{_KNOWN}, {random_items('rnd', 'hist', 'kn', 4)}"))
def _(t: Tables) -> DataFrame:
    return sampling.random_negatives(t.hist, t.hot, t.known, 4)


@query("n_mixed_negatives", using("pool hist hot", "SELECT user_id, item_id, CAST(tier AS INTEGER) AS tier, CAST(place AS INTEGER) AS place FROM f WHERE place <= 16", f"""{_KNOWN}, {random_items('rnd', 'hist', 'kn', 20)},
  p AS (SELECT user_id, item_id, CASE WHEN rank BETWEEN 11 AND 25 THEN 0 WHEN rank BETWEEN 26 AND 50 THEN 1 ELSE 2 END AS band, {lot(0, 'user_id', 'item_id')} AS h FROM pool a WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.user_id = a.user_id AND kn.item_id = a.item_id)),
  q AS (SELECT *, CASE WHEN band < 2 AND row_number() OVER (PARTITION BY user_id, band ORDER BY h, item_id) <= 2 THEN band ELSE 2 END AS tier FROM p),
  r AS (SELECT *, count(*) FILTER (tier < 2) OVER (PARTITION BY user_id) AS got, row_number() OVER (PARTITION BY user_id, tier ORDER BY h, item_id) AS n FROM q),
  a AS (SELECT user_id, item_id, tier, n FROM r WHERE tier < 2 OR n <= 4 - got UNION ALL SELECT user_id, item_id, 3, place FROM rnd),
  f AS (SELECT user_id, item_id, x // 1000000 AS tier, row_number() OVER (PARTITION BY user_id ORDER BY x, item_id) AS place FROM (SELECT user_id, item_id, min(tier * 1000000 + n) AS x FROM a GROUP BY 1, 2))"""))
def _(t: Tables) -> DataFrame:
    return sampling.mixed_negatives(t.pool, sampling.random_negatives(t.hist, t.hot, t.known, 20), t.known, 16)


@query("n_cf_negatives", using("hist sim", "SELECT * FROM cn WHERE place <= 4", f"{_KNOWN}, {_CFNEG}"))
def _(t: Tables) -> DataFrame:
    return sampling.cf_negatives(t.hist, t.sim, t.known, 4).select("user_id", "item_id", "place")


@query("n_weighted_negatives", using("hist hot", "SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY draw) AS INTEGER) AS place FROM d QUALIFY place <= 4", f"""{_KNOWN}, e AS (SELECT item_id, cnt, sum(cnt) OVER (ORDER BY hot_rank) AS hi, sum(cnt) OVER () AS total FROM hot),
  d AS (SELECT user_id, item_id, min(draw) AS draw FROM (SELECT user_id, draw, {lot(0, 'user_id', 'draw')} % (SELECT any_value(total) FROM e) AS at FROM (SELECT DISTINCT user_id FROM hist), range(1, 33) AS r(draw)) x JOIN e ON x.at < e.hi AND x.at >= e.hi - e.cnt
    WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.user_id = x.user_id AND kn.item_id = e.item_id) GROUP BY 1, 2)"""))
def _(t: Tables) -> DataFrame:
    return sampling.weighted_negatives(t.hist, t.hot, t.known, 4)


@query("n_negative_audit", using("pool hist hot", """SELECT count(*) FILTER (n > 1) AS repeated, count(*) FILTER (k) AS known, count(*) FILTER (NOT c) AS outside FROM (
  SELECT user_id, item_id, count(*) AS n, EXISTS (SELECT 1 FROM hist h WHERE h.user_id = g.user_id AND h.item_id = g.item_id) AS k, item_id IN (SELECT item_id FROM hot) AS c FROM g GROUP BY 1, 2)""", """g AS (SELECT user_id, item_id FROM pool WHERE rank <= 4
  UNION ALL SELECT user_id, item_id FROM pool WHERE rank = 3 AND user_id % 3 = 0 UNION ALL SELECT user_id, max(item_id) FROM hist GROUP BY 1 UNION ALL SELECT DISTINCT user_id, -1 FROM hist WHERE user_id % 5 = 0)"""))
def _(t: Tables) -> DataFrame:
    """Legal lists with faults put in, all of which must be counted."""
    good = t.pool.where("rank <= 4").select("user_id", "item_id")
    twice = t.pool.where("rank = 3 and user_id % 3 = 0").select("user_id", "item_id")
    known = t.hist.groupBy("user_id").agg(F.max("item_id").alias("item_id"))
    outside = t.hist.where("user_id % 5 = 0").select("user_id").distinct().withColumn("item_id", F.lit(-1).cast(dict(t.hist.dtypes)["item_id"]))
    return sampling.negative_audit(good.union(twice).union(known).union(outside), t.hist, t.hot)


@query("n_bpr_pairs", using("hist hot sim", "SELECT h.user_id, h.item_id, n.neg FROM hist h JOIN (SELECT user_id, neg FROM (SELECT user_id, neg, min(x) AS x FROM b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x) <= 3) n USING (user_id)",
  f"{_KNOWN}, {_CFNEG}, {random_items('rnd', 'hist', 'kn', 3)}, b AS (SELECT user_id, item_id AS neg, place AS x FROM cn WHERE place <= 2 UNION ALL SELECT user_id, item_id, 1000 + place FROM rnd)"))
def _(t: Tables) -> DataFrame:
    rand = sampling.random_negatives(t.hist, t.hot, t.known, 3)
    return sampling.bpr_pairs(t.hist, sampling.cf_negatives(t.hist, t.sim, t.known, 2), rand, 3).select("user_id", "item_id", "neg")


@query("n_user_sample", using("ded", f"SELECT user_id, item_id FROM ded WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM ded) ORDER BY {lot(7, 'user_id')}, user_id LIMIT 100)"))
def _(t: Tables) -> DataFrame:
    from tidewheel.operators.clean import sample_users

    return sample_users(t.ded, 100, seed=7).select("user_id", "item_id")


@query("m_blend", using("pool", "SELECT user_id, item_id, round(0.7 / (1 + exp(-(rank / 10.0 - 2))) + 0.3 * score / (abs(score) + 1), 6) AS blended FROM pool"))
def _(t: Tables) -> DataFrame:
    return t.pool.select("user_id", "item_id", F.round(sampling.blend(F.col("rank") / 10.0 - 2, F.col("score")), 6).alias("blended"))


@query("m_losses", using("pool", "SELECT user_id, round(avg(ln(1 + exp(score - 0.05))), 6) AS bpr, round(max(score) + ln(sum(exp(score - m))) - max(score), 6) AS spread FROM (SELECT *, max(score) OVER (PARTITION BY user_id) AS m FROM pool) GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    top = t.pool.groupBy("user_id").agg(F.max("score").alias("m"))
    return t.pool.join(top, "user_id").groupBy("user_id").agg(F.round(F.avg(sampling.bpr_loss(F.lit(0.05), F.col("score"))), 6).alias("bpr"), F.round(F.ln(F.sum(F.exp(F.col("score") - F.col("m")))), 6).alias("spread"))


@query("m_rerank", using("pool", f"SELECT user_id, item_id, round(s, 6) AS score, {_TOP} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS rank FROM (SELECT user_id, item_id, score * 2 + 1.0 / (1 + rank % 7) AS s FROM pool)) WHERE rank <= 5"))
def _(t: Tables) -> DataFrame:
    return _r(sampling.rerank(t.pool, lambda f: f["score"] * 2 + 1.0 / (1 + f["rank"] % 7), ["score", "rank"], 5), "user_id", "item_id")


@query("m_als_factors")
def _(t: Tables) -> DataFrame:
    from pyspark.ml.recommendation import ALS

    als = ALS(rank=8, maxIter=3, implicitPrefs=True, alpha=10.0, userCol="user_id", itemCol="item_id", ratingCol="one", seed=1)
    model = als.fit(t.train.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.lit(1.0).alias("one")))
    return model.itemFactors.select(F.col("id").alias("item_id"), similarity.unit("features").alias("embedding"))


@query("g_exposed_items", using("stacked", "SELECT item_id, count(DISTINCT user_id) AS users FROM stacked GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return t.stacked.groupBy("item_id").agg(F.count_distinct("user_id").alias("users"))


@query("f_legacy_hot", using("hist hot", "SELECT user_id, item_id, round(0.1::DOUBLE * (1 - (hot_rank - 1) / 5.0::DOUBLE), 6) AS score, CAST(hot_rank AS INTEGER) AS rank FROM (SELECT DISTINCT user_id FROM hist), hot WHERE hot_rank <= 5"))
def _(t: Tables) -> DataFrame:
    return _r(channels.legacy_hot(t.hist, t.hot), "user_id", "item_id")


# training samples
_SAMPLES = """smp AS (SELECT user_id AS u, item_id AS target, ts AS at, row_number() OVER (ORDER BY user_id, ts, item_id) AS id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM train) WHERE ts > first_ts),
  hist AS (SELECT s.id AS user_id, e.item_id, e.ts, e.rating, e.category, e.brand FROM smp s JOIN train e ON e.user_id = s.u AND e.ts < s.at)"""
_CHANNELS = ", ".join(PARTS[n] for n in ("recent", "unseen", "cfraw", "cf", "pref", "cat", "hot5", "stacked", "fused", "pool")).replace("/ 90.0", "/ 180.0")
_POOLS = using("hot sim", "SELECT u AS user_id, target, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM pool JOIN smp ON id = user_id", f"{_SAMPLES}, {_CHANNELS}")


@query("f_training_pools", _POOLS)
def _(t: Tables) -> DataFrame:
    """Every training position, not only users."""
    return _r(t.training_pools, "user_id", "target", "item_id")


@query("n_recall_negatives", inner("pool hot", "SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM pool p WHERE item_id IN (SELECT item_id FROM train0) AND NOT EXISTS (SELECT 1 FROM train0 t WHERE t.user_id = p.user_id AND t.item_id = p.item_id)"))
def _recall_negatives(t: Tables) -> DataFrame:
    return training.recall_negatives(t.inner.pool, t.hot, t.train).withColumn("rank", F.col("rank").cast("int"))


_RECALLED = "el AS (SELECT user_id, item_id FROM pool p WHERE item_id IN (SELECT item_id FROM train0) AND NOT EXISTS (SELECT 1 FROM train0 t WHERE t.user_id = p.user_id AND t.item_id = p.item_id))"


@query("n_candidate_negatives", inner("pool hist", "SELECT user_id, item_id, x < 1000 AS hard, CAST(row_number() OVER (PARTITION BY user_id ORDER BY x, item_id) AS INTEGER) AS place FROM (SELECT user_id, item_id, min(x) AS x FROM b GROUP BY 1, 2) QUALIFY place <= 4",
  f"""{_RECALLED}, h0 AS (SELECT DISTINCT item_id FROM train0), {random_items('rnd', 'hist', 'train0', 5, 'h0')},
  b AS (SELECT user_id, item_id, 1 AS x FROM el QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {lot(0, 'user_id', 'item_id')}, item_id) <= 1 UNION ALL SELECT user_id, item_id, 1000 + place FROM rnd)"""))
def _(t: Tables) -> DataFrame:
    """Four negatives a user, one of them from the pool of the inner split."""
    rand = sampling.random_negatives(t.inner.hist, t.hot, t.train, 5)
    return training.candidate_negatives(_recall_negatives(t), rand, 4, 1).select("user_id", "item_id", "hard", "place")


def _fixed(t: Tables) -> DataFrame:
    samples = sequence.train_samples(t.train).select("user_id", F.col("item_id").alias("target"))
    return training.fixed_pools(samples, t.hot, t.fw.select("user_id", "item_id"), 16)


_FIXED = f"""sm AS (SELECT user_id, item_id AS target FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM train) WHERE ts > first_ts), od AS (SELECT item_id, row_number() OVER (ORDER BY {lot(0, 'item_id')}, item_id) AS slot, count(*) OVER () AS size FROM hot),
  dr AS (SELECT user_id, target, draw, {lot(1, 'user_id', 'target', 'draw')} % (SELECT any_value(size) FROM od) + 1 AS slot FROM sm, range(1, 41) AS r(draw)),
  fx AS (SELECT user_id, target, list(item_id ORDER BY n) AS items FROM (SELECT user_id, target, item_id, min(draw) AS n FROM dr x JOIN od USING (slot) WHERE item_id <> target AND NOT EXISTS (SELECT 1 FROM fw k WHERE k.user_id = x.user_id AND k.item_id = od.item_id) GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY user_id, target ORDER BY n) <= 16) GROUP BY 1, 2)"""


@query("n_fixed_pools", using("train hot", "SELECT user_id, target, items FROM fx", _FIXED))
def _(t: Tables) -> DataFrame:
    """Sixteen distinct unknown items for each sample, which the check raises on otherwise."""
    return training.pool_prefix(_fixed(t), t.fw, 16).select("user_id", "target", "items")


@query("n_prefix_stream", using("train hot", """SELECT user_id, s.item_id AS target, ts, hist_len, list_concat(h, list_transform(range(50 - len(h)), lambda i: CAST(0 AS BIGINT))) AS items, round(m, 6) AS rating_mean, fx.items[1:4] AS negatives FROM (
  SELECT a.user_id, a.item_id, a.ts, count(*) AS hist_len, list_reverse(list_slice(list(b.item_id ORDER BY b.ts DESC, b.item_id DESC), 1, 50)) AS h, list_avg(list_slice(list(b.rating ORDER BY b.ts DESC, b.item_id DESC), 1, 50)) AS m FROM train a JOIN train b ON b.user_id = a.user_id AND b.ts < a.ts GROUP BY 1, 2, 3) s
  JOIN fx USING (user_id) WHERE fx.target = s.item_id""", _FIXED))
def _(t: Tables) -> DataFrame:
    rows = training.prefix_stream(t.train, training.pool_prefix(_fixed(t), t.fw, 4))
    return rows.select("user_id", "target", "ts", "hist_len", "items", F.round("rating_mean", 6).alias("rating_mean"), "negatives")


@query("m_svd_factors")
def _(t: Tables) -> DataFrame:
    return training.svd_factors(t.train)[0]
