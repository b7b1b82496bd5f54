"""Queries on scans, cleaning, aggregation and ordered sequences."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import scalars
from tidewheel.operators import clean, sequence, stats
from tidewheel.operators.shared import delete_on_exit, new_path, stored
from tidewheel.sources import interactions as src
from tidewheel.sources import recovery
from tidewheel.sources.quarantine import line_counts, usable

from .oracle import using
from .recommend import Tables
from .registry import query

DAY = 86400000.0


# scans and sinks
@query("a_star_scan", using("inter", "SELECT * FROM inter"))
def _(t: Tables) -> DataFrame:
    return t.inter


@query("a_projected_scan", "SELECT l_partkey AS item_id, min(l_quantity) AS least FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.read("lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.min("l_quantity").alias("least"))


@query("a_json_properties", "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k is not null")


@query("a_ratings_as_reviews", using("inter", "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS parent_asin, CAST(rating AS FLOAT) AS rating, ts AS timestamp, 0 AS helpful_vote FROM inter"))
def _(t: Tables) -> DataFrame:
    r = t.inter.select(F.col("user_id").cast("string"), F.col("item_id").cast("string"), "rating", "ts")
    return src.ratings_as_reviews(r).select("user_id", "parent_asin", "rating", "timestamp", "helpful_vote")


@query("a_sanity", using("inter", "SELECT count(*) AS rows, round(avg(CAST(rating >= 4 AS INTEGER)), 9) AS positive_share FROM inter"))
def _(t: Tables) -> DataFrame:
    return src.sanity(t.inter)


@query("a_user_ids", "SELECT CAST(o_custkey AS VARCHAR) AS user_id FROM orders UNION SELECT CAST(user_id AS VARCHAR) FROM events")
def _(t: Tables) -> DataFrame:
    return src.all_user_ids(t.read("orders").select(F.col("o_custkey").alias("user_id")), t.read("events").select("user_id"))


# files with bad lines, and files of earlier runs, both written from the tables first
REVIEW_LINE = """CASE event_id % 20 WHEN 1 THEN '' WHEN 2 THEN '[1]' ELSE left(line, length(line) - CASE event_id % 20 WHEN 0 THEN 1 ELSE 0 END) END"""


def _lines(t: Tables, lines: DataFrame, name: str) -> str:
    path = new_path(t.spark, name)
    lines.write.text(path)
    delete_on_exit(t.spark, path)
    return path


def _reviews(t: Tables) -> DataFrame:
    """Events as review lines: of each twenty one is cut off, one is blank, one is an array, one has a rating in words and one has no user."""
    at = F.col("event_id") % 20
    fields = {
        "user_id": F.when(at != 4, F.concat(F.lit("u"), F.col("user_id").cast("string"))),
        "parent_asin": F.concat(F.lit("p"), (F.col("event_id") % 997).cast("string")),
        "rating": F.when(at == 3, "good").otherwise(F.col("value").cast("string")),
        "timestamp": src.epoch_ms("ts"),
        "verified_purchase": F.col("event_type") == "purchase",
    }
    rows = t.read("events").select("event_id", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("line"))
    return src.checked_reviews(t.spark, _lines(t, rows.selectExpr(f"{REVIEW_LINE} AS value"), "reviews"))


@query("a_review_jsonl", """SELECT 'u' || user_id AS user_id, 'p' || (event_id % 997) AS parent_asin, round(value, 4) AS rating, epoch_ms(ts) AS timestamp, count(*) AS lines,
CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS verified FROM events WHERE event_id % 20 > 4 AND value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    rows = usable(_reviews(t)).withColumn("rating", F.round(F.col("rating").cast("double"), 4))
    return rows.groupBy("user_id", "parent_asin", "rating", "timestamp").agg(F.count("*").alias("lines"), F.count_if("verified_purchase").alias("verified"))


@query("a_review_quarantine", """SELECT CASE event_id % 20 WHEN 0 THEN 'not json' WHEN 1 THEN 'blank' WHEN 2 THEN 'not an object' ELSE CASE WHEN event_id % 20 = 4 OR user_id IS NULL THEN 'no user_id'
WHEN event_id % 20 <> 3 AND value IS NULL THEN 'no rating' WHEN ts IS NULL THEN 'no timestamp' WHEN event_id % 20 = 3 THEN 'bad rating' ELSE 'usable' END END AS reason, count(*) AS lines FROM events GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return line_counts(_reviews(t)).groupBy("reason").agg(F.sum("lines").alias("lines"))


@query("a_meta_jsonl", """SELECT 'p' || p_partkey AS item_id, CASE WHEN p_partkey % 3 > 1 THEN p_brand WHEN p_partkey % 5 > 0 THEN upper(p_brand) ELSE 'Unknown' END AS brand,
CASE p_partkey % 4 WHEN 0 THEN -1.0 WHEN 3 THEN -1.0 ELSE CAST(p_size AS DOUBLE) + 1000.5 END AS price, CASE WHEN p_partkey % 5 > 0 THEN p_type ELSE 'Unknown' END AS skin_type FROM part WHERE p_partkey % 7 > 0""")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    price = F.when(k % 4 == 0, "from 3").when(k % 4 == 1, F.concat(F.lit("$1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".5"))).when(k % 4 == 2, (F.col("p_size") + F.lit(1000.5)).cast("string"))
    fields = {
        "parent_asin": F.concat(F.lit("p"), k.cast("string")),
        "store": F.when(k % 3 == 2, F.col("p_brand")).when(k % 3 == 1, " "),
        "details": F.create_map(F.lit("Brand"), F.upper("p_brand"), F.lit("Skin Type"), F.col("p_type")),
        "price": price,
    }
    line = F.to_json(F.struct(*[v.alias(c) for c, v in fields.items()]))
    line = F.when(k % 5 == 0, F.regexp_replace(line, r'"details":\{[^}]*\}', '"details":"none"')).otherwise(line)
    rows = t.read("part").select(F.when(k % 7 == 0, F.concat(line, F.lit("}"))).otherwise(line).alias("value"))
    return src.read_meta_jsonl(t.spark, _lines(t, rows, "meta")).select("item_id", "brand", "price", "skin_type")


def _write_runs(root: str):
    """Rows ``kind, user_id, uid`` as files of earlier runs under ``root``, a file a batch and kind; gives their paths."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(root)
        for n, batch in enumerate(batches):
            for kind, rows in batch.groupby("kind"):
                name = {"json": f"predictions_{part}_{n}.json", "csv": f"preds_{part}_{n}.csv", "npz": f"eval_{part}_{n}_users.npz"}[kind]
                buffer = io.BytesIO()
                if kind == "npz":
                    np.savez_compressed(buffer, uid=rows["uid"].to_numpy("int64"))
                elif kind == "csv":
                    rows[["user_id", "uid"]].to_csv(buffer, index=False)
                else:
                    made = [{"user_id": u, "labels": [{"user_id": "not this"}]} for u in rows["user_id"]]
                    buffer.write(json.dumps({"rows": made}).encode())
                with store.open_output_stream(f"{base}/{name}") as f:
                    f.write(buffer.getvalue())
                yield pd.DataFrame({"path": [f"{root}/{name}"]})

    return write


def _recovered(t: Tables) -> recovery.Recovery:
    """Customers with orders evaluated by runs that left JSON and CSV, users of events by one that left uids."""
    root = new_path(t.spark, "runs")
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base)
    delete_on_exit(t.spark, root)
    orders = t.read("orders").select(F.when(F.col("o_custkey") % 2 == 0, "json").otherwise("csv").alias("kind"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_id"), F.lit(0).cast("bigint").alias("uid"))
    events = t.read("events").where("user_id >= 0").select(F.lit("npz").alias("kind"), F.lit("").alias("user_id"), (F.col("user_id") + 2).alias("uid"))
    runs = stored(orders.where("o_custkey is not null").union(events).mapInPandas(_write_runs(root), "path string"), "inventory")
    with store.open_output_stream(f"{base}/{recovery.MANIFEST}") as f:
        f.write(b'{"source": {"data_id": "events"}}')
    users = t.read("events").where("user_id >= 0").select((F.col("user_id") + 2).alias("uid"), F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("user_id"))
    customers = t.read("customer").select((-F.col("c_custkey") - 1).alias("uid"), F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("user_id"))
    identity = users.union(customers).distinct().withColumn("data_id", F.lit("events"))
    return recovery.recover(runs, identity)


@query("a_recovered_users", "SELECT 'c' || o_custkey AS user_id FROM orders WHERE o_custkey IS NOT NULL UNION SELECT 'e' || user_id FROM events WHERE user_id >= 0")
def _(t: Tables) -> DataFrame:
    return _recovered(t).users


@query("a_recovered_encoders", """SELECT 'events' AS data_id, (SELECT count(DISTINCT user_id) FROM events WHERE user_id >= 0) + (SELECT count(DISTINCT c_custkey) FROM customer) AS n_users,
(SELECT count(DISTINCT c_custkey) FROM customer) AS n_outside""")
def _(t: Tables) -> DataFrame:
    return _recovered(t).encoders


@query("a_first_brand", "SELECT p_partkey AS item_id, p_brand AS brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND trim(p_brand) <> ''")
def _(t: Tables) -> DataFrame:
    meta = t.dim.withColumn("line", F.lit(0))
    return src.first_brand(meta, t.read("lineitem").select(F.col("l_partkey").alias("item_id")), ["line", "brand"])


@query("a_wide_predictions", using("pool", "SELECT user_id, max(CASE WHEN rank = 1 THEN item_id END) AS item_1, max(CASE WHEN rank = 2 THEN item_id END) AS item_2, max(CASE WHEN rank = 3 THEN item_id END) AS item_3 FROM pool GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return src.wide_predictions(t.pool, 3)


# projections, filters, dedupe, encoding
@query("b_positive_filter", using("inter", "SELECT user_id, item_id, rating, ts FROM inter WHERE rating >= 4"))
def _(t: Tables) -> DataFrame:
    return clean.positives(t.inter).select("user_id", "item_id", "rating", "ts")


@query("b_label_weight", using("inter", "SELECT user_id, item_id, rating, ts, CAST(rating >= 4 AS INTEGER) AS label, CASE rating WHEN 5 THEN 1.0::DOUBLE WHEN 4 THEN 0.5 ELSE 0.8 END AS weight FROM inter WHERE rating <> 3"))
def _(t: Tables) -> DataFrame:
    return clean.label_weight(t.inter).select("user_id", "item_id", "rating", "ts", "label", "weight")


@query("b_label_bin", """SELECT event_id, label, CAST(weight AS DOUBLE) AS weight FROM (SELECT event_id, CAST(greatest(1, least(5, floor(value / 20))) AS INTEGER) AS b FROM events)
  JOIN (VALUES (1, 0, 0.8), (2, 0, 0.8), (4, 1, 0.5), (5, 1, 1.0)) AS v(b, label, weight) USING (b)""")
def _(t: Tables) -> DataFrame:
    return clean.label_by_bin(t.read("events").select("event_id", (F.col("value") / 20).alias("rating"))).select("event_id", "label", "weight")


@query("b_click_columns", using("inter", "SELECT user_id, item_id AS click_article_id, ts AS click_timestamp FROM inter"))
def _(t: Tables) -> DataFrame:
    return clean.as_clicks(t.inter).select("user_id", "click_article_id", "click_timestamp")


@query("b_explicit_negatives", using("inter", "SELECT user_id, list_sort(list(DISTINCT item_id)) AS items FROM inter WHERE rating <= 2 GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    from tidewheel.operators.sampling import explicit_negatives

    return explicit_negatives(t.inter)


@query("b_exact_dedupe", using("inter", "SELECT user_id, item_id, ts, min(rating) AS rating FROM inter GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    return clean.exact_rows(t.inter.select("user_id", "item_id", "ts", "rating"))


@query("b_first_interaction", using("ded", "SELECT user_id, item_id, ts, rating FROM ded"))
def _(t: Tables) -> DataFrame:
    return t.ded.select("user_id", "item_id", "ts", "rating")


@query("b_first_category", "SELECT p_brand AS brand, min_by(p_type, p_partkey) AS category FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return clean.first_by_rank(t.dim, "brand", "category", ["item_id"])


@query("b_min_degree", using("ded", "SELECT user_id, item_id FROM ded WHERE user_id IN (SELECT user_id FROM ded GROUP BY 1 HAVING count(*) >= 10)"))
def _(t: Tables) -> DataFrame:
    return clean.min_degree(t.ded, "user_id", 10).select("user_id", "item_id")


#: Rounds of the SQL; the fixpoint of the driver's tables comes long before, and rounds after it change nothing.
_ROUNDS = 60
_CORE = ", ".join(
    f"u{k} AS MATERIALIZED (SELECT * FROM i{k - 1} WHERE user_id IN (SELECT user_id FROM i{k - 1} GROUP BY 1 HAVING count(*) >= 12)), "
    f"i{k} AS MATERIALIZED (SELECT * FROM u{k} WHERE item_id IN (SELECT item_id FROM u{k} GROUP BY 1 HAVING count(*) >= 8))"
    for k in range(1, _ROUNDS + 1)
)


@query("b_k_core", using("ded", f"SELECT user_id, item_id FROM i{_ROUNDS}", f"i0 AS MATERIALIZED (SELECT user_id, item_id FROM ded), {_CORE}"))
def _(t: Tables) -> DataFrame:
    return clean.k_core(t.ded, 12, 8).select("user_id", "item_id")


@query("b_dense_ids", "SELECT p_brand AS raw, CAST(dense_rank() OVER (ORDER BY p_brand) + 1 AS INTEGER) AS idx FROM (SELECT DISTINCT p_brand FROM part)")
def _(t: Tables) -> DataFrame:
    return clean.dense_ids(t.dim, "brand")


@query("b_label_encoder", "SELECT p_type AS raw, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT p_type FROM part)")
def _(t: Tables) -> DataFrame:
    return clean.dense_ids(t.dim, "category", first=0)


@query("b_lookup_default", """SELECT p_partkey AS item_id, coalesce(idx, 1) AS idx FROM part LEFT JOIN (SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) + 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#3')) USING (p_brand)""")
def _(t: Tables) -> DataFrame:
    return clean.encode(t.dim, clean.dense_ids(t.dim.where("brand < 'Brand#3'"), "brand"), "brand").select("item_id", "idx")


@query("b_in_range", "SELECT vec_id, list_filter([vec_id - 3, vec_id, vec_id + 1000], lambda x: x >= 0 AND x < 500) AS ids FROM embeddings")
def _(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    return t.read("embeddings").select("vec_id", clean.in_range(F.array(v - 3, v, v + 1000), 500).alias("ids"))


# joins
@query("j_left_features", """SELECT o_orderkey, o_custkey, coalesce(lines, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(t: Tables) -> DataFrame:
    extra = t.read("lineitem").where("l_quantity > 49").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return t.read("orders").select("o_orderkey", "o_custkey").join(extra, "o_orderkey", "left").na.fill(0)


@query("j_item_counts", using("ded", "SELECT p_partkey AS item_id, count(d.item_id) AS cnt FROM part LEFT JOIN ded d ON d.item_id = p_partkey GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return stats.every_id(t.dim.select("item_id"), t.ded.groupBy("item_id").agg(F.count("*").alias("cnt")), "item_id")


@query("j_semi", using("fw", "SELECT user_id, item_id FROM ded WHERE user_id IN (SELECT user_id FROM fw WHERE eligible)"))
def _(t: Tables) -> DataFrame:
    return t.ded.join(t.fw.where("eligible").select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id")


@query("j_as_of", """SELECT o_orderkey, o_custkey, max(e.ts) AS last_event FROM orders LEFT JOIN events e ON e.user_id = o_custkey AND epoch_ms(e.ts) < epoch_ms(CAST(o_orderdate AS TIMESTAMP)) + 1000000000000 GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    # both sides in one ordered stream a user: the last event before each order, without a range join
    orders = t.read("orders").select(F.col("o_custkey").alias("user_id"), (src.epoch_ms("cast(o_orderdate as timestamp_ntz)") + 1000000000000).alias("at"), "o_orderkey", F.lit(None).cast("timestamp_ntz").alias("ts"))
    events = t.read("events").select("user_id", src.epoch_ms("cast(ts as timestamp_ntz)").alias("at"), F.lit(None).cast(orders.schema["o_orderkey"].dataType).alias("o_orderkey"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    both = orders.unionByName(events).withColumn("last_event", F.max("ts").over(w))
    return both.where("o_orderkey is not null").select("o_orderkey", F.col("user_id").alias("o_custkey"), "last_event")


@query("j_boundary_intervals", using("seq", """SELECT user_id, item_id, CAST(pos AS INTEGER) AS pos, CAST((SELECT count(*) FROM seq b WHERE b.user_id = a.user_id AND b.rating = 5 AND b.pos + 1 <= a.pos) AS INTEGER) AS interval FROM seq a"""))
def _(t: Tables) -> DataFrame:
    """Positions by the intervals of their user, which end after each rating of 5."""
    p = sequence.positions(t.ded)
    return sequence.intervals(p.select("user_id", "item_id", "pos"), p.where("rating = 5").select("user_id", (F.col("pos") + 1).alias("bound")))


@query("b_complete_rows", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return clean.complete(t.read("documents").select("doc_id", "lang").join(t.read("labels").select("doc_id", "quality", "toxic"), "doc_id", "left"))


# aggregations
@query("g_popularity", using("hot", "SELECT item_id, cnt, CAST(hot_rank AS INTEGER) AS hot_rank FROM hot"))
def _(t: Tables) -> DataFrame:
    return t.hot


@query("g_top_items", using("train", "SELECT item_id, count(*) AS cnt FROM train GROUP BY 1 ORDER BY cnt DESC, item_id LIMIT 50"))
def _(t: Tables) -> DataFrame:
    return stats.top_items(t.train, 50)


@query("g_item_stats", using("train", "SELECT item_id, count(*) AS train_cnt, min(ts) AS train_first_ts, round(avg(rating) / 5, 6) AS train_mean_rating FROM train GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return stats.item_stats(t.train)


@query("g_user_stats", using("ded", f"""SELECT user_id, count(*) AS events, count(DISTINCT item_id) AS items, (max(ts) - min(ts)) / {DAY} AS span_days, round(avg(rating), 6) AS mean_rating,
  round(coalesce(stddev_samp(rating), 0.0), 6) AS std_sample, round(stddev_pop(rating), 6) AS std_population FROM ded GROUP BY 1"""))
def _(t: Tables) -> DataFrame:
    return stats.user_stats(t.ded)


@query("g_ordered_items", using("ded", "SELECT user_id, list(item_id ORDER BY ts, item_id) AS items FROM ded GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return stats.ordered_items(t.ded)


@query("g_item_sets", using("ded", "SELECT user_id, list_sort(list(DISTINCT item_id)) AS items FROM ded GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return stats.item_sets(t.ded)


@query("g_last_item", using("seq", "SELECT user_id, item_id FROM seq WHERE pos = n - 1"))
def _(t: Tables) -> DataFrame:
    return stats.last_item(t.ded)


@query("g_category_shares", using("ded", """SELECT user_id, category, count(*) AS cnt, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS share,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS INTEGER) AS rank FROM ded GROUP BY 1, 2 QUALIFY rank <= 3"""))
def _(t: Tables) -> DataFrame:
    return stats.category_shares(t.ded, 3)


@query("g_category_entropy", using("ded", """SELECT user_id, round(-sum(p * ln(p + 1e-8)) / (CASE WHEN count(*) > 1 THEN ln(count(*)) ELSE 1 END + 1e-8), 6) AS entropy FROM (
  SELECT user_id, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS p FROM ded GROUP BY user_id, category) GROUP BY 1"""))
def _(t: Tables) -> DataFrame:
    return stats.category_entropy(t.ded)


@query("g_activity_bucket", using("ded", """SELECT user_id, events, CASE WHEN events < 0.5 * m THEN 0 WHEN events <= 1.5 * m THEN 1 ELSE 2 END AS bucket
  FROM (SELECT user_id, count(*) AS events FROM ded GROUP BY 1), (SELECT quantile_cont(c, 0.5) AS m FROM (SELECT count(*) AS c FROM ded GROUP BY user_id))"""))
def _(t: Tables) -> DataFrame:
    return stats.activity_bucket(t.ded)


@query("g_quantiles", using("ded", """SELECT CAST(q AS DOUBLE) AS q, round(CASE q WHEN 0.0 THEN a[1] WHEN 0.25 THEN a[2] WHEN 0.5 THEN a[3] WHEN 0.75 THEN a[4] WHEN 0.95 THEN a[5] ELSE a[6] END, 6) AS value FROM
  (SELECT quantile_cont(c, [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]) AS a FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM ded GROUP BY user_id)), (VALUES (0.0), (0.25), (0.5), (0.75), (0.95), (1.0)) AS v(q)"""))
def _(t: Tables) -> DataFrame:
    return stats.quantiles(t.ded.groupBy("user_id").agg(F.count("*").alias("c")), "c")


@query("g_distribution", using("inter", "SELECT rating, count(*) AS cnt, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM inter GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return stats.distribution(t.inter, "rating")


@query("g_mean_vector", """SELECT CAST(label AS BIGINT) AS key, list(x ORDER BY dim) AS embedding FROM (SELECT label, dim, round(avg(CAST(embedding[dim] AS DOUBLE)), 6) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS dim) GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    return stats.mean_vector(e.select(F.col("label").cast("bigint").alias("key"), "vec_id"), e.select("vec_id", "embedding"))


@query("g_summary", using("inter", "SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(rating), 6) AS mean_rating FROM inter"))
def _(t: Tables) -> DataFrame:
    return stats.summary(t.inter)


@query("g_exposure", using("train", "SELECT user_id, count(*) AS seen FROM (SELECT user_id FROM train ORDER BY ts, user_id, item_id LIMIT 2000) GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return stats.exposure(t.train, 2000, ["ts", "user_id", "item_id"])


@query("g_recomputed", using("train", """SELECT item_id, cnt AS train_cnt, side FROM (SELECT item_id, cnt + CAST(item_id % 7 = 0 AS BIGINT) AS cnt, 'left' AS side FROM c WHERE item_id % 7 = 0 OR item_id % 11 = 0
  UNION ALL SELECT item_id, cnt, 'right' FROM c WHERE item_id % 7 = 0) WHERE side = 'right' OR item_id % 7 = 0""", "c AS (SELECT item_id, count(*) AS cnt FROM train GROUP BY 1)"))
def _(t: Tables) -> DataFrame:
    """Kept counts, every seventh of which is off by one, against those recomputed."""
    off = (F.col("item_id") % 7 == 0).cast("bigint")
    kept = t.train.groupBy("item_id").agg(F.count("*").alias("train_cnt")).withColumn("train_cnt", F.col("train_cnt") + off)
    return stats.differs(kept, stats.item_stats(t.train).select("item_id", "train_cnt"))


# ordered sequences
@query("w_positions", using("seq", "SELECT user_id, item_id, CAST(pos AS INTEGER) AS pos, n FROM seq"))
def _(t: Tables) -> DataFrame:
    return sequence.positions(t.ded).select("user_id", "item_id", "pos", "n")


@query("w_strict_history", using("ded", "SELECT user_id, item_id, (SELECT count(*) FROM ded b WHERE b.user_id = a.user_id AND b.ts < a.ts) AS hist_len, (SELECT max(ts) FROM ded b WHERE b.user_id = a.user_id AND b.ts < a.ts) AS hist_last_ts FROM ded a"))
def _(t: Tables) -> DataFrame:
    return sequence.strict_history(t.ded).select("user_id", "item_id", "hist_len", "hist_last_ts")


@query("w_ratio_split", using("seq", "SELECT user_id, item_id, CASE WHEN pos < greatest(1, floor(n * 0.8)) THEN 'train' ELSE 'val' END AS split FROM seq"))
def _(t: Tables) -> DataFrame:
    return sequence.ratio_split(t.ded).select("user_id", "item_id", "split")


_LTO = """x AS (SELECT *, max(CASE WHEN pos = n - 2 THEN ts END) OVER u AS val_ts, max(CASE WHEN pos = n - 1 THEN ts END) OVER u AS test_ts, min(ts) OVER u AS first_ts FROM {0} WINDOW u AS (PARTITION BY user_id)),
  lto AS (SELECT user_id, item_id, ts, CASE WHEN NOT coalesce(n >= 3 AND val_ts > first_ts AND test_ts > val_ts, false) THEN 'train' WHEN pos = n - 2 THEN 'val' WHEN pos = n - 1 THEN 'test' WHEN ts < val_ts THEN 'train' ELSE 'rest' END AS split FROM x)"""


@query("w_leave_two_out", using("seq", "SELECT user_id, item_id, split FROM lto", _LTO.format("seq")))
def _(t: Tables) -> DataFrame:
    return sequence.leave_two_out(t.ded).select("user_id", "item_id", "split")


@query("w_inner_split", using("train", "SELECT user_id, item_id, split FROM lto", "s2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM train), " + _LTO.format("s2")))
def _(t: Tables) -> DataFrame:
    return sequence.leave_two_out(t.train).select("user_id", "item_id", "split")


@query("w_future_window", using("fw", "SELECT user_id, item_id, split, eligible FROM fw"))
def _(t: Tables) -> DataFrame:
    return t.fw.select("user_id", "item_id", "split", "eligible")


@query("w_debug_split", using("seq", "SELECT user_id, item_id, CASE WHEN pos < greatest(1, floor(n * 0.8)) THEN 'train' ELSE 'val' END AS split FROM seq WHERE n > greatest(1, floor(n * 0.8))"))
def _(t: Tables) -> DataFrame:
    return sequence.debug_split(t.ded).select("user_id", "item_id", "split")


@query("w_train_samples", using("train", "SELECT user_id, item_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS f FROM train) WHERE ts > f"))
def _(t: Tables) -> DataFrame:
    return sequence.train_samples(t.train).select("user_id", "item_id")


@query("w_last_events", using("seq", "SELECT user_id, item_id, CAST(n - pos AS INTEGER) AS back FROM seq WHERE n - pos <= 10"))
def _(t: Tables) -> DataFrame:
    return sequence.last_events(t.ded, 10).select("user_id", "item_id", "back")


@query("w_padded", using("seq", "SELECT user_id, CAST(len(l) AS INTEGER) AS hist_len, list_resize(l, 20, 0) AS items FROM (SELECT user_id, list(item_id ORDER BY pos) AS l FROM seq WHERE n - pos <= 20 GROUP BY 1)"))
def _(t: Tables) -> DataFrame:
    return sequence.padded(t.ded, 20)


_GAP = f"coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, item_id)) / {DAY}, 0.0)"


@query("w_gaps", using("seq", "SELECT user_id, item_id, round(least(g / 30, 365 / 30.0), 6) AS gap FROM g WHERE back <= 50", f"g AS (SELECT user_id, item_id, back, {_GAP} AS g FROM (SELECT *, n - pos AS back FROM seq) WHERE back <= 50)"))
def _(t: Tables) -> DataFrame:
    return sequence.gaps(t.ded).select("user_id", "item_id", F.round("gap", 6).alias("gap"))


@query("w_legacy_gaps", using("seq", "SELECT user_id, item_id, round(least(g, 365.0) / (CASE WHEN max(least(g, 365.0)) OVER (PARTITION BY user_id) = 0 THEN 1.0 ELSE max(least(g, 365.0)) OVER (PARTITION BY user_id) END + 1e-8), 6) AS gap FROM g", f"g AS (SELECT user_id, item_id, {_GAP} AS g FROM (SELECT *, n - pos AS back FROM seq) WHERE back <= 50)"))
def _(t: Tables) -> DataFrame:
    return sequence.legacy_gaps(t.ded).select("user_id", "item_id", F.round("gap", 6).alias("gap"))


@query("w_recency", using("seq", "SELECT user_id, item_id, round(w / greatest(1.0, sum(w) OVER (PARTITION BY user_id)), 6) AS recency FROM w", f"""g AS (SELECT user_id, item_id, ts, least({_GAP} / 30, 365 / 30.0) AS gap FROM (SELECT *, n - pos AS back FROM seq) WHERE back <= 50),
  w AS (SELECT user_id, item_id, exp(-0.1 * coalesce(sum(gap) OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS w FROM g)"""))
def _(t: Tables) -> DataFrame:
    return sequence.recency(sequence.gaps(t.ded), 0.1).select("user_id", "item_id", F.round("recency", 6).alias("recency"))


@query("w_prefix_statistics", using("ded", f"""SELECT user_id, item_id, round(ln(1 + any_value(c)) / 5, 6) AS count_feature, round(ln(1 + (max(hts) - min(hts)) / {DAY}) / 8, 6) AS span_feature, round(avg(hr) / 5, 6) AS rating_mean, round(stddev_pop(hr) / 2, 6) AS rating_std
  FROM (SELECT a.user_id, a.item_id, b.ts AS hts, b.rating AS hr, count(*) OVER (PARTITION BY a.user_id, a.item_id) AS c, row_number() OVER (PARTITION BY a.user_id, a.item_id ORDER BY b.ts DESC, b.item_id DESC) AS r
  FROM ded a JOIN ded b ON a.user_id = b.user_id AND b.ts < a.ts) WHERE r <= 10 GROUP BY 1, 2"""))
def _(t: Tables) -> DataFrame:
    s = sequence.prefix_statistics(t.ded, 5.0, 8.0, n=10)
    return s.select("user_id", "item_id", *[F.round(c, 6).alias(c) for c in ("count_feature", "span_feature", "rating_mean", "rating_std")])


@query("w_min_max", using("train", "SELECT item_id, round((cnt - min(cnt) OVER ()) / (max(cnt) OVER () - min(cnt) OVER () + 1e-8), 6) AS scaled FROM (SELECT item_id, count(*) AS cnt FROM train GROUP BY 1)"))
def _(t: Tables) -> DataFrame:
    return stats.min_max(t.train.groupBy("item_id").agg(F.count("*").alias("cnt")), "cnt").select("item_id", F.round("cnt_scaled", 6).alias("scaled"))


@query("w_log_scaled", using("train", "SELECT item_id, round(ln(1 + cnt) / ln(1 + max(cnt) OVER ()), 6) AS scaled FROM (SELECT item_id, count(*) AS cnt FROM train GROUP BY 1)"))
def _(t: Tables) -> DataFrame:
    return stats.log_scaled(t.train.groupBy("item_id").agg(F.count("*").alias("cnt")), "cnt").select("item_id", F.round("cnt_log", 6).alias("scaled"))


@query("w_latest_history", "SELECT user_id, count(*) AS events, list_slice(list(event_id ORDER BY ts DESC, event_id DESC), 1, 50) AS items FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The whole log, up to and with each user's last event; :mod:`tidewheel.streaming.history` keeps the same up to date."""
    return sequence.latest_history(t.read("events").select("user_id", F.col("event_id").alias("item_id"), "ts"), 50)


@query("w_spaced_rows", using("seq", "SELECT DISTINCT user_id, item_id, CAST(pos AS INTEGER) AS pos FROM (SELECT user_id, item_id, pos, max(pos) OVER () AS last FROM seq), range(5) AS r(i) WHERE pos = floor(i * last / 4)"))
def _(t: Tables) -> DataFrame:
    return sequence.spaced(sequence.positions(t.ded), 5).select("user_id", "item_id", "pos")


@query("k_scalars", """SELECT vec_id, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(greatest(v, 0) + ln(1 + exp(-abs(v))), 6) AS softplus, round(log2(1 + abs(v)), 6) AS log2p, round(least(greatest(v, -0.1), 0.1), 6) AS clipped,
  list_transform(embedding[1:4], lambda x: round(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding[1:4], lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 6)) AS unit4
  FROM (SELECT *, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings)""")
def _(t: Tables) -> DataFrame:
    from tidewheel.operators.similarity import unit

    v = F.col("embedding")[0].cast("double")
    return t.read("embeddings").select("vec_id", F.round(scalars.sigmoid(v), 6).alias("sigmoid"), F.round(scalars.softplus(v), 6).alias("softplus"), F.round(F.log2(1 + F.abs(v)), 6).alias("log2p"), F.round(scalars.clip(v, -0.1, 0.1), 6).alias("clipped"), F.transform(unit(F.slice("embedding", 1, 4)), lambda x: F.round(x, 6)).alias("unit4"))
