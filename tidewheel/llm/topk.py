"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted, spread

#: Vectors of one index shard and queries of one block; a task holds a score table of both.
SHARD_ROWS, BLOCK_QUERIES = 16384, 2048
#: Vectors whose scores are worked on together.
TILE = 2048
#: Share of a tile that a segment's lists fill, above which they are added as one product.
DENSE = 0.02


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null if the vector is null or holds a null or non-finite one, or one that leaves 64 bits once scaled."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= 2.0**63 / abs(scale)))
    return F.when(F.coalesce(~bad, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale)))


def plain(v: np.ndarray) -> np.ndarray:
    """Rows whose inner products with each other stay below 2**62 at every step, so that doubles bound them and 64-bit integers give them."""
    return (np.abs(v.astype(np.float64)) < 2.0**31 / np.sqrt(v.shape[1]) - 1).all(axis=1)


def large_scores(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact inner products of the rows of ``v`` with ``q``, and which of them fit 64 bits, whatever the components.

    Integer products are exact modulo 2**64; a sum in doubles, with room for its rounding, tells which are exact as they are. Those too near the
    limit to tell are added up as whole numbers of any size.
    """
    x, y = v.astype(np.float64), q.astype(np.float64)
    about = x @ y
    slack = np.abs(x) @ np.abs(y) * (len(q) + 4) * 2.0**-52 + 1
    with np.errstate(over="ignore"):
        score = (v * q).sum(axis=1)
    fits = np.abs(about) + slack < 2.0**63
    for i in np.flatnonzero(~fits & (np.abs(about) - slack < 2.0**63)).tolist():
        exact = sum(a * b for a, b in zip(v[i].tolist(), q.tolist(), strict=True))
        fits[i] = -(2**63) <= exact < 2**63
    return score, fits


class ImpactIndex:
    """Posting lists of a shard by descending impact.

    The impact of a component is the bit length of its absolute value. A posting (vector, component) stands in the list of its impact
    and dimension, in the order of vectors; the lists of one impact are a segment, held one after another. What is left of the vectors after a segment bounds every score by Cauchy-Schwarz:
    |q . rest| <= |q| |rest|, with the norm of each vector's rest kept beside the segment.
    ``touched`` counts postings times queries that were added up, of ``size`` postings a query.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, d = vectors.shape
        level = np.frexp(np.abs(vectors).astype(np.float64))[1]
        level[vectors == 0] = 0
        self.segments, self.size, self.touched = [], int((level > 0).sum()), 0
        rest = (vectors.astype(np.float64) ** 2).sum(axis=1)
        for impact in sorted(set(level[level > 0].tolist()), reverse=True):
            dim, row = np.nonzero(level.T == impact)  # by dimension, vectors ascending
            value = vectors[row, dim].astype(np.float64)
            rest = rest - np.bincount(row, value * value, n)
            # where each list reaches each tile of vectors: a tile's scores stay in the processor's cache while its lists are added
            edge = np.append(np.arange(0, n, TILE), n)
            at = np.searchsorted(dim * n + row, np.arange(d)[:, None] * n + edge)
            self.segments.append((at, row, value, np.sqrt(np.maximum(rest, 0))))

    def search(self, queries: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of every query, row numbers and scores of its ``k`` best (ties to smaller ids); ``own``: the id it must not return.

        A segment's lists are added to the scores of all queries that are still open. Only vectors whose upper bound reaches the
        k-th best lower bound can be among a query's best; it is closed when there are so few that scoring them again costs no more than
        the postings to come. Bounds are in double precision with room for its rounding, and whoever may be a member is scored again in integers.
        """
        n = len(self.vectors)
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        length = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        score = np.zeros((n, len(queries)))
        live = np.arange(len(queries))  # queries of the columns of ``score``
        q = queries.T.astype(np.float64)
        members: list[np.ndarray | None] = [None] * len(queries)
        want = min(k, n)
        to_come = self.size
        for at, row, value, rest in self.segments:
            if not len(live):
                break
            to_come -= len(row)
            for tile in range(at.shape[1] - 1):
                base = tile * TILE
                own_scores = score[base : base + TILE]
                ends = at[:, tile : tile + 2]
                if (ends[:, 1] - ends[:, 0]).sum() > DENSE * len(own_scores) * len(q):
                    # the tile's lists laid out side by side: one product instead of many sums
                    lists = np.zeros((len(own_scores), len(q)))
                    for d, (lo, hi) in enumerate(ends.tolist()):
                        lists[row[lo:hi] - base, d] = value[lo:hi]
                    own_scores += lists @ q
                    continue
                for d, (lo, hi) in enumerate(ends.tolist()):
                    if lo < hi:
                        own_scores[row[lo:hi] - base] += value[lo:hi, None] * q[d]
            self.touched += len(row) * len(live)
            slack = (rest[:, None] * (1 + 1e-9) + length[:, None] * 1e-9) * norm[live]
            mine = ids[:, None] == own[live]
            low = np.where(mine, -np.inf, score - slack)
            floor = np.partition(low, n - want, axis=0)[n - want]
            maybe = (score + slack >= floor) & ~mine
            few = maybe.sum(axis=0) <= max(2 * k, to_come / max(1, len(q)))
            for i in np.flatnonzero(few):
                members[live[i]] = np.flatnonzero(maybe[:, i])
            live, score, q = live[~few], score[:, ~few], q[:, ~few]
        out = []
        for i in range(len(queries)):
            m = np.flatnonzero(ids != own[i]) if members[i] is None else members[i]
            exact = self.vectors[m] @ queries[i]  # integers
            if len(m) > 4 * k:
                cut = np.partition(exact, len(m) - k)[len(m) - k]
                m, exact = m[exact >= cut], exact[exact >= cut]
            best = np.lexsort((ids[m], -exact))[:k]
            out.append((m[best], exact[best]))
        return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every query with all other rows: ``query_id, rank, id_col, score``.

    Components are floor(``scale`` * x). Candidates are dealt by hash into index shards and queries into
    blocks; every (shard, block) pair is one task's work, so its memory is fixed, and a row is copied once for each block of
    ``BLOCK_QUERIES`` queries. Each shard's index is walked
    score-at-a-time, a segment of one impact after another, until for a query it is proved that only few
    vectors can be among the ``k`` best of the shard; those are rescored exactly. The shards' lists then meet in
    one top-k by query.

    Vectors that are null, or hold null or non-finite components, or components that leave 64 bits once scaled, or are empty take no part, nor do null ids.
    Vectors with components so large that sums in doubles could not be trusted stand beside the index and are scored one by one, exactly; a pair whose score leaves 64 bits has no row.
    Ties go to smaller ids. Rows that share the query's id are its own. Repeated query ids count once, with the
    least of their vectors; repeated candidates are ranked each. A query meets vectors of its own length only.
    """
    take = lambda d: d.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v")).where("id is not null and size(v) > 0")
    cand, ask = take(vectors), take(queries).groupBy("id").agg(F.min("v").alias("v"))
    n_shards, n_blocks = spread(vectors.count(), SHARD_ROWS), spread(queries.count(), BLOCK_QUERIES)
    c = cand.withColumn("shard", salted(n_shards, F.col("id"), F.lit("s"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("ask", F.lit(False))
    a = ask.withColumn("block", salted(n_blocks, F.col("id"), F.lit("b"))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).withColumn("ask", F.lit(True))
    both = c.select("shard", "block", "ask", "id", "v").unionByName(a.select("shard", "block", "ask", "id", "v")).withColumn("d", F.size("v"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("ask").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        flat = table.column("v").combine_chunks()
        v = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        pick = lambda m: m[np.argsort(ids[m], kind="stable")]
        c, q = pick(np.flatnonzero(~asks)), pick(np.flatnonzero(asks))
        rows: list = [[], [], []]

        def tell(query: int, found: np.ndarray, score: np.ndarray) -> None:
            best = np.lexsort((found, -score))[:k]
            for column, x in zip(rows, (np.full(len(best), query), found[best], score[best]), strict=True):
                column.append(x)

        if len(c) and len(q):
            few, easy = plain(v[c]), plain(v[q])
            hard = c[~few]
            if few.any() and easy.any():
                index, small, asks = ImpactIndex(v[c[few]]), ids[c[few]], q[easy]
                step = max(1, 2_000_000 // len(small))
                for lo in range(0, len(asks), step):
                    part = asks[lo : lo + step]
                    for i, (m, s) in enumerate(index.search(v[part], k, ids[part], small)):
                        tell(ids[part[i]], small[m], s)
            for i in q[easy] if len(hard) else q[:0]:
                s, fits = large_scores(v[hard], v[i])
                tell(ids[i], ids[hard][fits & (ids[hard] != ids[i])], s[fits & (ids[hard] != ids[i])])
            for i in q[~easy]:
                s, fits = large_scores(v[c], v[i])
                tell(ids[i], ids[c][fits & (ids[c] != ids[i])], s[fits & (ids[c] != ids[i])])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(rows[0]), "id": cat(rows[1]), "score": cat(rows[2])})

    found = both.groupBy("d", "shard", "block").applyInArrow(run, "query_id long, id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
