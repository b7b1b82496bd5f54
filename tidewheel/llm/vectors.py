"""Embedding near-dedup over an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, salted, spread

#: The codebooks and the radius of traversal are fitted on so many vectors at most, those with the least hashes: 16 a centroid, within these bounds.
SAMPLE_VECTORS, MOST_VECTORS = 4096, 16384
#: Centroids of a codebook at most. The grid has their square of cells, so up to about 16 million vectors of a label the cells keep their size; beyond that they grow with the label.
CENTROIDS = 1024
#: Share of the pairs at the threshold itself that the traversal reaches; closer pairs are reached more often.
TARGET_RECALL = 0.9999
#: Vectors wanted in a cell of one label, and the most in a block of postings or probes.
CELL_ROWS, BLOCK_ROWS = 16, 1024
#: Rows of blocks that are verified in one group, about.
GROUP_ROWS = 4096


class MultiIndex:
    """Independent codebooks on the two halves of unit vectors; their product is the grid of cells."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, target: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = [self._means(x, k, rng) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.k = len(self.books[0]), len(self.books[1])
        # neighbours in random directions, just at the threshold: how far must the traversal go to meet their cells?
        gaps, rows = [], np.arange(len(sample))
        for _ in range(4):
            g = rng.standard_normal(sample.shape)
            g -= (g * sample).sum(axis=1, keepdims=True) * sample
            near = threshold * sample + np.sqrt(1 - threshold**2) * g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
            a, b = self.halves(sample), self.halves(near)
            there = sum(x[rows, y.argmin(axis=1)] - x.min(axis=1) for x, y in zip(a, b, strict=True))
            back = sum(y[rows, x.argmin(axis=1)] - y.min(axis=1) for x, y in zip(a, b, strict=True))
            gaps.append(np.minimum(there, back))
        self.radius = float(np.quantile(np.concatenate(gaps), target)) + 1e-9

    @staticmethod
    def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
        x = x[np.sort(rng.permutation(len(x)))]
        c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
        for _ in range(rounds):
            near = (-2 * x @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
            for j in np.unique(near):
                c[j] = x[near == j].mean(axis=0)
        return c

    def halves(self, u: np.ndarray) -> list[np.ndarray]:
        """Squared distances of both halves to their centroids, but for what is the same for all of them."""
        return [-2 * x @ c.T + (c * c).sum(axis=1) for x, c in zip((u[:, : self.half], u[:, self.half :]), self.books, strict=True)]

    def probes(self, u: np.ndarray) -> list[np.ndarray]:
        """The cells that a multi-sequence traversal visits, nearest first, up to ``radius`` beyond the nearest.

        Each half's centroids are sorted by distance. The pair of ranks (0, 0) is the nearest cell; a heap holds the pairs whose
        predecessors (p - 1, q) and (p, q - 1) are both out, and gives the next nearest, until that is beyond the radius. So a vector
        costs two sorts of k numbers and a heap of the cells it visits, and the grid is never laid out.
        """
        ranked = []
        for d in self.halves(u):
            order = np.argsort(d, axis=1, kind="stable")
            ranked.append((order.tolist(), np.take_along_axis(d, order, axis=1).tolist()))
        (left, x), (right, y) = ranked
        return [self._walk(*row) for row in zip(left, x, right, y, strict=True)]

    def _walk(self, left: list[int], x: list[float], right: list[int], y: list[float]) -> np.ndarray:
        limit = x[0] + y[0] + self.radius
        heap, out, width = [(x[0] + y[0], 0, 0)], [], self.k[1]
        reached = [0] * len(x)  # reached[p]: pairs (p, q) with smaller q are out
        while heap and heap[0][0] <= limit:
            _, p, q = heapq.heappop(heap)
            out.append(left[p] * width + right[q])
            reached[p] = q + 1
            if q + 1 < len(y) and (p == 0 or reached[p - 1] > q + 1):
                heapq.heappush(heap, (x[p] + y[q + 1], p, q + 1))
            if p + 1 < len(x) and reached[p + 1] == q:
                heapq.heappush(heap, (x[p + 1] + y[q], p + 1, q))
        return np.array(out, np.int32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def blocks_size(cells: DataFrame) -> int:
    """Rows of all blocks of ``cells(n_post, n_ask, pb, qb)``."""
    return cells.agg(F.coalesce(F.sum(F.col("n_post") * F.col("qb") + F.col("n_ask") * F.col("pb")), F.lit(0))).first()[0]


def vector_links(vectors: DataFrame, threshold: float = 0.98, target_recall: float = TARGET_RECALL, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between distinct vectors of equal labels: ``reps(label, v, rep, weight)``, ``counts(rep, links)``, ``edges(a, b)``.

    Rows with the same label and vector are one representative, the least id, with their number as weight.
    ``links`` sums, over the other representatives with cosine >= ``threshold``, their weights; ``edges`` connect what is
    linked (a spanning forest of each block's links, not all pairs).

    Every vector is posted in its own cell and probes the cells its traversal visits. A pair met in both
    of its cells is counted where the smaller id probes. Postings and probes of a cell are dealt into blocks
    of ``BLOCK_ROWS`` and compared block by block, so a hot cell is many tasks and only counts and forests leave them.
    """
    spark = vectors.sparkSession
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), x.alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists("v", lambda v: v != 0))
    reps = materialize(valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "vectors")
    n, labels, longest = reps.agg(F.count("*"), F.count_distinct("label"), F.max(F.size("v"))).first()
    k = int(np.clip(round(np.sqrt(n / max(1, labels) / CELL_ROWS)), 1, CENTROIDS))
    sample = [r[0] for r in reps.select("v", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(int(np.clip(16 * k, SAMPLE_VECTORS, MOST_VECTORS))).select("v").collect()] if n else []
    empty = spark.createDataFrame([], "rep long, links long"), spark.createDataFrame([], "a long, b long")
    if not sample or longest < 2:
        if longest == 1:  # all cosines are 1 or -1: pad to a half each
            return vector_links(vectors.withColumn(vector, F.concat(x, F.array(F.lit(0).cast(vectors.schema[vector].dataType.elementType)))), threshold, target_recall, id_col, vector, label)
        return reps.select("label", "v", "rep", "weight"), *empty
    index = MultiIndex(_unit(np.array(sample)), k, threshold, target_recall)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                p = index.probes(_unit(_matrix(batch.column("v"))))
                ends = np.cumsum([0, *map(len, p)]).astype(np.int32)
                yield batch.append_column("cell", pa.array([q[0] for q in p], pa.int32())).append_column("probes", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(p))))

    kind = dict(reps.dtypes)
    posted = materialize(reps.mapInArrow(place, f"label {kind['label']}, v {kind['v']}, rep long, weight long, cell int, probes array<int>"), "cells")
    where = ["label", "cell"]
    # a block number for postings and one for probes: as many blocks as the cell needs
    n_post = posted.groupBy(*where).agg(F.count("*").alias("n_post"))
    asked = posted.select("label", F.explode("probes").alias("cell")).groupBy(*where).agg(F.count("*").alias("n_ask"))
    blocks = n_post.join(asked, where).select(*where, F.ceil(F.col("n_post") / BLOCK_ROWS).cast("int").alias("pb"), F.ceil(F.col("n_ask") / BLOCK_ROWS).cast("int").alias("qb"))
    blocks = materialize(blocks, "blocks")
    to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    posts = posted.join(blocks, where).select(*where, salted(F.col("pb"), F.col("rep"), F.lit("p")).alias("p"), F.explode(to("qb")).alias("q"), F.lit(False).alias("ask"), "rep", "weight", "v", "probes", F.col("cell").alias("own"))
    asks = posted.select("label", F.explode("probes").alias("cell"), "rep", "weight", "v", F.col("cell").alias("own")).join(blocks, where)
    asks = asks.select(*where, salted(F.col("qb"), F.col("rep"), F.lit("q")).alias("q"), F.explode(to("pb")).alias("p"), F.lit(True).alias("ask"), "rep", "weight", "v", F.lit(None).cast("array<int>").alias("probes"), "own")
    both = posts.unionByName(asks)
    cells = index.k[0] * index.k[1]

    def verify(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False)
        rep, weight, own = (table.column(c).to_numpy() for c in ("rep", "weight", "own"))
        u = _unit(_matrix(table.column("v")))
        y, q = np.flatnonzero(~ask), np.flatnonzero(ask)
        node, links, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(y) and len(q):
            probes = table.column("probes").combine_chunks().take(pa.array(y))
            visits = np.repeat(np.arange(len(y)), np.diff(probes.offsets.to_numpy())) * cells + probes.flatten().to_numpy()
            hit = u[q] @ u[y].T >= threshold
            hit &= rep[q][:, None] != rep[y][None, :]
            # met in both cells: counted where the smaller id asks
            i, j = np.nonzero(hit)
            both = (rep[q[i]] > rep[y[j]]) & np.isin(j * cells + own[q[i]], visits)
            hit[i[both], j[both]] = False
            if hit.any():
                node += [rep[q], rep[y]]
                links += [hit @ weight[y], hit.T @ weight[q]]
                a = rep[q].copy()  # least id of each probe's reach, and so on until it stays
                b = rep[y].copy()
                i, j = np.nonzero(hit)
                while True:
                    a2, b2 = a.copy(), b.copy()
                    np.minimum.at(a2, i, b[j])
                    np.minimum.at(b2, j, a2[i])
                    # a vector that is both asked and asking has one label
                    least = dict(zip(rep[q].tolist(), a2.tolist(), strict=True))
                    b2 = np.array([min(v, least.get(r, v)) for r, v in zip(rep[y].tolist(), b2.tolist(), strict=True)], np.int64)
                    least.update({r: min(v, least.get(r, v)) for r, v in zip(rep[y].tolist(), b2.tolist(), strict=True)})
                    a2 = np.array([least[r] for r in rep[q].tolist()], np.int64)
                    if (a2 == a).all() and (b2 == b).all():
                        break
                    a, b = a2, b2
                to = [a, b]
                some = [links[1] > 0, links[2] > 0]
                return pa.table({"node": np.concatenate([x[s] for x, s in zip(node[1:], some, strict=True)]), "links": np.concatenate([x[s] for x, s in zip(links[1:], some, strict=True)]).astype(np.int64), "least": np.concatenate([x[s] for x, s in zip(to, some, strict=True)])})
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})

    # many small blocks are one group of about GROUP_ROWS rows: what a task pays for a group does not follow the number of cells
    size = blocks_size(n_post.join(asked, where).join(blocks, where))
    keys = [*where, "p", "q"]

    def several(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in keys]).combine_chunks()
        edge = np.zeros(len(table) + 1, bool)
        edge[[0, -1]] = True
        for c in keys:
            column = table.column(c).dictionary_encode().combine_chunks().indices.to_numpy()
            edge[1:-1] |= column[1:] != column[:-1]
        at = np.flatnonzero(edge)
        return pa.concat_tables([verify(table.slice(lo, hi - lo)) for lo, hi in zip(at[:-1], at[1:], strict=True)])

    dealt = both.withColumn("_group", salted(spread(size, GROUP_ROWS), *keys))
    found = materialize(dealt.groupBy("_group").applyInArrow(several, "node long, links long, least long"), "links")
    counts = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    return reps, counts, found.select(F.col("node").alias("a"), F.col("least").alias("b")).where("a <> b")


def vector_components(vectors: DataFrame, threshold: float = 0.98, target_recall: float = TARGET_RECALL, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each vector: ``id_col, n_links, component_id, kept``.

    ``n_links``: other vectors of the same label with cosine >= ``threshold``, in double precision; ``component_id``: the
    smallest id reachable by links; ``kept``: it is its own component's. Copies are compared once and
    counted by their number. Null labels, ids, vectors, zero vectors and null or non-finite components link
    with nothing and are their own component. All vectors must have the same length. Repeated rows link with each other.
    """
    reps, counts, edges = vector_links(vectors, threshold, target_recall, id_col, vector, label)
    parts = connected_components(edges).withColumnRenamed("node", "rep")
    known = reps.join(counts, "rep", "left").join(parts, "rep", "left")
    known = known.select(F.col("label").alias("_l"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = vectors.select(F.col(id_col), F.col(vector).alias("_vec"), F.col(label).alias("_lab"))
    joined = rows.join(known, (F.col("_lab") == F.col("_l")) & (F.col("_vec") == F.col("_v")) & F.col(id_col).isNotNull(), "left")
    part = F.coalesce("component_id", F.col(id_col)).cast("long")
    return joined.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), (F.col(id_col) == part).alias("kept"))
