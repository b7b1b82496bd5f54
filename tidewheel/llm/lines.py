"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted

#: Boilerplate lines of all hosts together (8 bytes each) up to which their table is broadcast; beyond it pages are dealt by (host, salt).
BROADCAST_LINES = 1_000_000
#: Parts of a host's pages then, and copies of its one row of boilerplate.
SALTS = 64

_MARK = "_line_"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """Lines are compared without the spaces around them; a blank line has no key."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate_lines(docs: DataFrame, ratio: float = 0.02, min_pages: int = 3, host: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines on more than ``ratio`` of their host's pages and on ``min_pages`` at least: ``host, line_hash, pages, host_pages``.

    A page counts once for a line however often it repeats it.  Counts are summed within each task
    before the shuffle, so a hot host costs a row for each task and line.  A null host is a host.
    """
    pages = docs.select(F.col(host).alias("host"), F.array_compact(F.array_distinct(F.transform(_lines(F.col(text)), _key))).alias("keys"))
    totals = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_pages"))
    counts = pages.select("host", F.explode("keys").alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("pages"))
    t = totals.select(F.col("host").alias("h"), "host_pages")
    return (
        counts.where(F.col("pages") >= min_pages)
        .join(t, F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
        .select("host", "line_hash", "pages", "host_pages")
    )


def drop_boilerplate(docs: DataFrame, ratio: float = 0.02, min_pages: int = 3, host: str = "source", id_col: str = "doc_id", text: str = "text", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with its boilerplate lines dropped, and ``n_lines``, ``n_removed`` appended.

    Pages are grouped by ``host``; a line (spaces around it do not count) goes from every page of a
    host where more than ``ratio`` of the pages, and at least ``min_pages``, have it.  Blank lines
    never go.  The lines left keep their order and are joined by newlines.  A null text stays null
    with 0 lines; an empty one has one blank line; a page that loses all lines keeps an empty text.
    Every row stays, repeated rows too; other columns pass through.

    A host's boilerplate is one row of hashes: a page has few lines and each must be on ``ratio`` of the
    pages, so the array is bounded by (mean lines per page) / ``ratio``, whatever the number of pages. The table is
    written and its lines are counted: up to ``broadcast_lines`` it is broadcast and no text is shuffled; beyond that
    pages meet their host's row by (host, salt), so a hot host's pages are in ``SALTS`` parts.
    """
    clash = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    bad = boilerplate_lines(docs, ratio, min_pages, host, id_col, text).groupBy(F.col("host").alias(_MARK + "host")).agg(F.collect_list("line_hash").alias(_MARK + "bad"))
    bad = materialize(bad, "boilerplate")
    n_lines = bad.agg(F.coalesce(F.sum(F.size(_MARK + "bad")), F.lit(0))).first()[0]
    pages, same = docs.drop(*clash), F.col(host).eqNullSafe(F.col(_MARK + "host"))
    if n_lines <= broadcast_lines:
        joined = pages.join(F.broadcast(bad), same, "left")
    else:
        bad = bad.withColumn(_MARK + "part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages = pages.withColumn(_MARK + "salt", salted(SALTS, F.col(id_col), F.length(text)))
        joined = pages.join(bad, same & (F.col(_MARK + "salt") == F.col(_MARK + "part")), "left")
    lines = _lines(F.col(text))
    known = F.array_contains
    stays = F.filter(lines, lambda x: F.coalesce(~known(F.col(_MARK + "bad"), _key(x)), F.lit(True)))
    out = joined.withColumn(_MARK + "kept", F.when(F.col(_MARK + "bad").isNull(), lines).otherwise(stays))
    return out.select(
        *[F.array_join(_MARK + "kept", "\n").alias(c) if c == text else F.col(c) for c in docs.columns if c not in clash],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(_MARK + "kept"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
keyed AS (SELECT doc_id, source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM d),
counts AS (SELECT source, line, count(*) AS pages FROM keyed WHERE line <> '' GROUP BY source, line),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
bad AS (SELECT c.source, list(c.line) AS bad FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
        WHERE c.pages >= 3 AND c.pages > 0.02 * t.host_pages GROUP BY c.source),
kept AS (SELECT d.doc_id, d.lines, list_filter(d.lines, lambda x: NOT coalesce(list_contains(b.bad, trim(x, ' ')), false)) AS kept
         FROM d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN lines IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_removed
FROM kept
"""
