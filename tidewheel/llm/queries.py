"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, licenses, lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    e = table(spark, sf_dir, "embeddings")
    return top_k(e, e.where("vec_id % 20 = 0"), k=20, scale=64.0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), cap=2048, keep_ids=False)


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import vector_components

    return vector_components(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import remainder
    from .quality import fit_quality, score_quality

    docs, held = table(spark, sf_dir, "documents"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, table(spark, sf_dir, "labels"), ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import remainder
    from .toxicity import fit_toxicity, score_toxicity

    docs, held = table(spark, sf_dir, "documents"), F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import drop_repeats

    cut = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), total_share=1.0, max_copies=3)


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(table(spark, sf_dir, "documents"), ratio=0.02, min_pages=3)
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), rate=100, spm=50, seed=7)
    both = fim.restore_text(made.withColumn("output_sha256", F.sha2("fim_text", 256)))
    return both.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), k=8, scale=1024.0, shift=100_000)


OPERATORS = (
    op1_topk_search, op2_best_fit_packing, op3_embedding_neardup, op4_quality_lines, op5_toxic_spans,
    op6_substring_dedup, op7_source_mixing, op8_minhash_neardup, op9_license_scan, op10_line_dedup,
    op11_decontamination, op12_fill_in_middle, op13_embedding_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP3 = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1, "op3_embedding_neardup": OP3, "op9_license_scan": licenses.oracle(), "op10_line_dedup": lines.ORACLE,
            "op11_decontamination": decontaminate.ORACLE, "op12_fill_in_middle": fim.ORACLE}
