"""A training corpus from ``documents``: toxicity, line dedup, near-dedup, mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``. In all stages other columns are left out, an empty table gives no
rows, and repeated rows, null ids, null sources and null, empty or very long texts are documents like any other unless a stage says more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import materialize
from tidewheel.llm.labelled import remainder
from tidewheel.llm.lines import drop_boilerplate
from tidewheel.llm.minhash import drop_near_duplicates
from tidewheel.llm.mixing import apply_mix
from tidewheel.llm.packing import pack_documents
from tidewheel.llm.queries import table, tokenizer_path
from tidewheel.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7; the model learns from labelled rows that op5 doesn't hold out.

    Null and empty texts have the lowest score and stay; without labels of both kinds all stay.
    """
    use = F.coalesce(remainder("doc_id", 3) != 1, F.lit(True))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), use)
    return score_toxicity(docs.select(*COLUMNS), model).where("score < 0.7").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source dropped; every document stays, ``n_chars`` follows its text (null for a null text). A null source is one source."""
    out = drop_boilerplate(docs.select(*COLUMNS), ratio=0.02, min_pages=3)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; repeated rows of that id stay together.

    Null and empty texts are nobody's duplicates, and a group without an id stays whole.
    """
    return drop_near_duplicates(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, repeating, null last; a document stands as often as the mix takes it, 0 to 3 times. Documents without words stay once."""
    return apply_mix(docs.select(*COLUMNS), weights=(1, 2, 3), total_share=1.0, max_copies=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids and their places in sequences of 2048 tokens and 64 pieces at most; a null or empty text is its end id alone."""
    return pack_documents(docs.select(*COLUMNS), tokenizer_path(), cap=2048, keep_ids=True, max_docs=64)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("source mixing", mixing),
    ("best-fit packing", packing),
]

#: A field, consistent sampling and a packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
