"""Common table expressions of the oracle SQL, each stating the table of the same name in ``recommend.Tables``."""

import re

PARTS = {
    "inter": """inter AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(least(5, 1 + floor(l_quantity / 10)) AS INTEGER) AS rating,
  epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ts, p_type AS category, p_brand AS brand
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)""",
    "ded": """ded AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, rating) AS rn FROM inter WHERE rating >= 4) WHERE rn = 1)""",
    "seq": """seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ded)""",
    "fw": """fw AS (SELECT *, n >= 2 AND cut_ts > first_ts AS eligible, CASE WHEN n >= 2 AND cut_ts > first_ts AND ts >= cut_ts THEN 'target' ELSE 'train' END AS split
  FROM (SELECT *, max(CASE WHEN pos = least(greatest(n * 4 // 5, 1), n - 1) THEN ts END) OVER (PARTITION BY user_id) AS cut_ts, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM seq))""",
    "train": """train AS (SELECT user_id, item_id, ts, rating, category, brand FROM fw WHERE split = 'train')""",
    "tgt": """tgt AS (SELECT user_id, item_id FROM fw WHERE split = 'target')""",
    "hist": """hist AS (SELECT user_id, item_id, ts, rating, category, brand FROM fw WHERE split = 'train' AND eligible)""",
    "hot": """hot AS (SELECT item_id, cnt, row_number() OVER (ORDER BY cnt DESC, item_id) AS hot_rank FROM (SELECT item_id, count(*) AS cnt FROM train GROUP BY item_id))""",
    "simall": """simall AS (SELECT item_id, neighbor, w / sqrt(CAST(di AS DOUBLE) * dj) AS sim FROM (
  SELECT a.item_id, b.item_id AS neighbor, sum(1 / greatest(1.0, ln(1 + du))) AS w FROM train a JOIN train b USING (user_id) JOIN (SELECT user_id, count(*) AS du FROM train GROUP BY 1) USING (user_id)
  WHERE a.item_id <> b.item_id GROUP BY 1, 2)
  JOIN (SELECT item_id, count(*) AS di FROM train GROUP BY 1) USING (item_id) JOIN (SELECT item_id AS neighbor, count(*) AS dj FROM train GROUP BY 1) USING (neighbor))""",
    "sim": """sim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, neighbor) AS rank FROM simall) WHERE rank <= 30)""",
    "recent": """recent AS (SELECT *, power(2.0, -((max(ts) OVER (PARTITION BY user_id) - ts) / 86400000.0) / 90.0) AS decay FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS back FROM hist) WHERE back <= 50)""",
    "cfraw": """cfraw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT r.user_id, s.neighbor AS item_id, sum(r.decay * s.sim) AS score FROM recent r JOIN sim s USING (item_id)
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = r.user_id AND h.item_id = s.neighbor) GROUP BY 1, 2)) WHERE rank <= 75)""",
    "cf": """cf AS (SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, spot) AS rank FROM (
  SELECT user_id, item_id, score, 0 AS tier, rank AS spot FROM cfraw UNION ALL
  SELECT user_id, item_id, -1.0, 1, hot_rank FROM unseen u WHERE NOT EXISTS (SELECT 1 FROM cfraw f WHERE f.user_id = u.user_id AND f.item_id = u.item_id))) WHERE rank <= 75)""",
    "pref": """pref AS (SELECT user_id, category, cnt / CAST(len AS DOUBLE) AS share FROM (SELECT user_id, category, count(*) AS cnt, sum(count(*)) OVER (PARTITION BY user_id) AS len,
  row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS place FROM recent GROUP BY 1, 2) WHERE place <= 3)""",
    "cat": """cat AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT p.user_id, h.item_id, p.share AS score, row_number() OVER (PARTITION BY p.user_id, p.category ORDER BY h.hot_rank) AS place
  FROM pref p JOIN part ON p_type = p.category JOIN hot h ON h.item_id = p_partkey
  WHERE NOT EXISTS (SELECT 1 FROM hist x WHERE x.user_id = p.user_id AND x.item_id = h.item_id)) WHERE place <= 20)""",
    "unseen": """unseen AS (SELECT u.user_id, h.item_id, h.hot_rank, row_number() OVER (PARTITION BY u.user_id ORDER BY h.hot_rank) AS place
  FROM (SELECT user_id, count(*) + 150 AS deep FROM hist GROUP BY 1) u JOIN hot h ON h.hot_rank <= u.deep WHERE NOT EXISTS (SELECT 1 FROM hist x WHERE x.user_id = u.user_id AND x.item_id = h.item_id))""",
    "hot5": """hot5 AS (SELECT user_id, item_id, 1.0 / place AS score, place AS rank FROM unseen WHERE place <= 5)""",
    "stacked": """stacked AS (SELECT 'cf' AS channel, 2.0 AS w, user_id, item_id, score, rank FROM cf UNION ALL SELECT 'category', 0.7, user_id, item_id, score, rank FROM cat
  UNION ALL SELECT 'hot', 0.05, user_id, item_id, CAST(score AS DOUBLE), rank FROM hot5)""",
    "fused": """fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT user_id, item_id, sum(CAST(w AS DOUBLE) / (60 + place)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY channel, user_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, item_id) AS place FROM stacked) GROUP BY 1, 2)) WHERE rank <= 75)""",
    "vec": """vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT r.user_id, b.vec_id AS item_id, avg(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS score FROM recent r JOIN embeddings a ON a.vec_id = r.item_id, embeddings b
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = r.user_id AND h.item_id = b.vec_id) GROUP BY 1, 2)) WHERE rank <= 75)""",
    "four": """four AS (SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT user_id, item_id, sum(CAST(w AS DOUBLE) / (60 + place)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY w, user_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, item_id) AS place FROM (
  SELECT CASE channel WHEN 'cf' THEN 1.0 ELSE w END AS w, user_id, item_id, score FROM stacked UNION ALL SELECT 1.5, user_id, item_id, score FROM vec)) GROUP BY 1, 2)) WHERE rank <= 75)""",
    "pool4": """pool4 AS (SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, spot) AS rank FROM (
  SELECT user_id, item_id, score, 0 AS tier, rank AS spot FROM four UNION ALL
  SELECT user_id, item_id, -1.0, 1, hot_rank FROM unseen u WHERE NOT EXISTS (SELECT 1 FROM four f WHERE f.user_id = u.user_id AND f.item_id = u.item_id))) WHERE rank <= 75)""",
    "reach": """reach AS (SELECT 'hot' AS channel, user_id, item_id FROM tgt WHERE item_id IN (SELECT item_id FROM hot) UNION SELECT 'cf', user_id, item_id FROM tgt WHERE item_id IN (SELECT item_id FROM hot)
  UNION SELECT 'cf', t.user_id, t.item_id FROM tgt t JOIN recent r USING (user_id) JOIN sim s ON s.item_id = r.item_id AND s.neighbor = t.item_id
  UNION SELECT 'category', t.user_id, t.item_id FROM tgt t JOIN part ON p_partkey = t.item_id JOIN pref p ON p.user_id = t.user_id AND p.category = p_type WHERE t.item_id IN (SELECT item_id FROM hot))""",
    "pool": """pool AS (SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, spot) AS rank FROM (
  SELECT user_id, item_id, score, 0 AS tier, rank AS spot FROM fused UNION ALL
  SELECT user_id, item_id, -1.0, 1, hot_rank FROM unseen u WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.user_id = u.user_id AND f.item_id = u.item_id))) WHERE rank <= 75)""",
    "um": """um AS (SELECT user_id, CAST(coalesce(found, 0) > 0 AS INTEGER) AS hit, coalesce(found, 0) / CAST(targets AS DOUBLE) AS recall,
  coalesce(dcg, 0.0) / list_sum(list_transform(range(1, CAST(least(5, targets) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
  FROM (SELECT user_id, count(*) AS targets FROM tgt GROUP BY 1) LEFT JOIN (
  SELECT p.user_id, count(*) AS found, sum(1 / log2(p.rank + 1)) AS dcg FROM pool p JOIN tgt USING (user_id, item_id) WHERE p.rank <= 5 GROUP BY 1) USING (user_id))""",
}
NEEDS = {
    "ded": ["inter"], "seq": ["ded"], "fw": ["seq"], "train": ["fw"], "tgt": ["fw"], "hist": ["fw"], "hot": ["train"], "simall": ["train"], "sim": ["simall"],
    "recent": ["hist"], "cfraw": ["recent", "sim", "hist"], "cf": ["cfraw", "unseen"], "vec": ["recent", "hist"], "four": ["stacked", "vec"], "pool4": ["four", "unseen"], "reach": ["tgt", "hot", "recent", "sim", "pref"], "pref": ["recent"], "cat": ["pref", "hot", "hist"], "unseen": ["hist", "hot"], "hot5": ["unseen"],
    "stacked": ["cf", "cat", "hot5"], "fused": ["stacked"], "pool": ["fused", "unseen"], "um": ["tgt", "pool"],
}


def lot(seed: int, *cols: str) -> str:
    """SQL of :func:`tidewheel.operators.shared.lot`."""
    return f"CAST('0x' || md5(concat_ws(':', {', '.join([str(seed), *cols])}))[1:15] AS BIGINT)"


def random_items(name: str, users: str, known: str, k: int, catalogue: str = "hot") -> str:
    """SQL tables of random negatives: ``name(user_id, item_id, place)``."""
    return f"""{name}_o AS (SELECT item_id, row_number() OVER (ORDER BY {lot(0, 'item_id')}, item_id) AS at, count(*) OVER () AS size FROM {catalogue}),
  {name} AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY step) AS INTEGER) AS place FROM (SELECT u.user_id, o.item_id, (o.at - 1 - {lot(1, 'u.user_id')} % o.size + o.size) % o.size AS step FROM (SELECT DISTINCT user_id FROM {users}) u, {name}_o o
    WHERE NOT EXISTS (SELECT 1 FROM {known} n WHERE n.user_id = u.user_id AND n.item_id = o.item_id)) QUALIFY place <= {k})"""


def inner(names: str, sql: str, more: str = "") -> str:
    """As :func:`using` over the inner split: ``train0`` is the outer training part, which stands for the log."""
    outer = ", ".join(re.sub(r"\b(ded|seq|fw|train)\b", r"\g<1>0", PARTS[n]) for n in ("inter", "ded", "seq", "fw", "train"))
    rest = using(names, sql, more).removeprefix("WITH ")
    rest = rest.removeprefix(PARTS["inter"] + ", " + PARTS["ded"] + ", ")
    return f"WITH {outer}, ded AS (SELECT * FROM train0), {rest}"


def using(names: str, sql: str, more: str = "") -> str:
    """``sql`` after the named tables and what they need; ``more`` adds tables of its own."""
    done: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in done:
            done.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join([*(PARTS[n] for n in done), *([more] if more else [])]) + " " + sql
