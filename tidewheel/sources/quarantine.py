"""JSON lines with every bad line kept and its reason, instead of dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checked_lines(spark: SparkSession, path: str | list[str], fields: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Every line with ``file, line, reason`` and its ``fields``, each cast to its type.

    ``reason`` is null for a usable line, else one of: ``blank``, ``not json``, ``not an object``, ``no <field>`` (a required one is missing or null), ``bad <field>`` (its value doesn't cast). Numbers and
    booleans in quotes count as such; MAP fields that aren't objects are null. Keys of no field are ignored; of a repeated key one value counts. A line is read once and parsed in the JVM.
    """
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    raw = ", ".join(f"`{c}`: STRING" for c in fields)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    # the parser ignores what follows a value; inside brackets anything but blanks is an error or a second element
    rows = rows.withColumn("_all", F.from_json(F.concat(F.lit("["), "line", F.lit("]")), f"ARRAY<STRUCT<{raw}>>", strict)).withColumn("_raw", F.get("_all", F.lit(0)))
    cast = {c: F.from_json(F.col("_raw")[c], t, {"mode": "PERMISSIVE"}) if t.upper().startswith("MAP") else F.col("_raw")[c].try_cast(t) for c, t in fields.items()}
    in_braces = F.from_json(F.concat(F.lit('{"r":'), "line", F.lit("}")), "r STRING, _corrupt STRING", strict)["_corrupt"].isNull()
    # only a line that closes the bracket itself passes the first test wrongly, so few lines need the second
    doubtful = F.col("_raw").isNull() | (F.size("_all") != 1) | F.col("line").rlike(r"\}\s*\]")
    why = F.when(F.col("line").rlike(r"^\s*$"), "blank").when(doubtful & ~in_braces, "not json").when(~F.ltrim("line").startswith("{"), "not an object").when(F.coalesce(F.size("_all"), F.lit(0)) != 1, "not json")
    for c in required:
        why = why.when(F.col("_raw")[c].isNull(), f"no {c}")
    for c, t in fields.items():
        if not t.upper().startswith(("MAP", "STRING")):
            why = why.when(F.col("_raw")[c].isNotNull() & cast[c].isNull(), f"bad {c}")
    return rows.select("file", "line", why.alias("reason"), *[v.alias(c) for c, v in cast.items()])


def usable(checked: DataFrame) -> DataFrame:
    return checked.where("reason is null").drop("file", "line", "reason")


def line_counts(checked: DataFrame) -> DataFrame:
    """``file, reason, lines``; the reason of usable lines is ``usable``."""
    return checked.groupBy("file", F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("lines"))


def write_quarantine(checked: DataFrame, path: str) -> None:
    """The bad lines as they stand, with file and reason, added to a Parquet table."""
    checked.where("reason is not null").select("file", "reason", "line").write.mode("append").parquet(path)
