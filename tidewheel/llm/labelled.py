"""The bounded training sample of the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import Words, batches, mix, shingles

#: Labelled documents of either class on which a classifier is fitted, at most: those with the least hashes of their ids.
SAMPLE_PER_CLASS = 1400
#: Documents with more characters are scored like any other but not trained on, so that the sample fits one process.
SAMPLE_MAX_CHARS = 20_000
#: Bytes of text of either class, at most: the process that fits holds twice this and small multiples of ``CHUNK_BYTES``.
SAMPLE_BYTES = 4_000_000
#: Bytes of text that a fit looks at together.
CHUNK_BYTES = 250_000


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in pieces of about ``CHUNK_BYTES``."""
    for b in batches(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", CHUNK_BYTES):
        yield b.column(0)


def picked(docs: DataFrame, labels: DataFrame, label: str, use: Column, id_col: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` documents of each class for which ``use`` holds, ``_id, text, _y``, and the classes' numbers of labelled rows in use.

    Which documents: those with the least hashes of their ids, as far as ``SAMPLE_BYTES`` of text go. The ids are picked from ``labels`` and
    broadcast (their number is bounded), so the texts are read without a shuffle. An id with several labels counts with each.
    """
    seen = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & use).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    some = [seen.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    ids = some[0].union(some[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).where(F.length("text") <= SAMPLE_MAX_CHARS)
    by = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.join(F.broadcast(ids), "_id").withColumn("_bytes", F.sum(F.octet_length("text")).over(by)).where(F.col("_bytes") <= SAMPLE_BYTES)
    count = {r["_y"]: r["n"] for r in seen.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    return near.select("_id", "text", "_y"), count


def arranged(got: pa.Table, count: dict[int, int]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, 0/1 labels and weights of what :func:`picked` gives, in the order of class and id.

    The weights restore the classes' shares among all labelled rows in use. Near copies are thinned: of documents that agree in one of three MinHash values of their shingles, the first stays.
    """
    if not got.num_rows:
        return pa.array([], pa.string()), np.zeros(0), np.zeros(0)
    order = pc.sort_indices(got, sort_keys=[("_y", "ascending"), ("_id", "ascending"), ("text", "ascending")])
    texts, y = got.column("text").take(order).combine_chunks(), got.column("_y").take(order).to_numpy()
    del got
    keep, met, d = np.ones(len(y), bool), set(), 0
    for part in chunks(texts):
        h, doc = shingles(Words(part), 5)
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(h) else []
        least = [np.minimum.reduceat(mix(h, 31 + k), at) for k in range(3)] if len(h) else []
        for i, w in enumerate(doc[at].tolist() if len(h) else []):
            mine = {(k, int(least[k][i]), int(y[d + w])) for k in range(3)}
            keep[d + w] = not (mine & met)
            met |= mine
        d += len(part)
    y = y[keep].astype(np.float64)
    share = np.array([count.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
    return texts.take(pa.array(np.flatnonzero(keep))), y, share[y.astype(int)] / max(share.max(), 1e-9)


def sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, id_col: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """:func:`arranged` documents of :func:`picked`, on the driver."""
    near, count = picked(docs, labels, label, use, id_col, text, per_class)
    return arranged(near.toArrow(), count)


def fitted(near: DataFrame, count: dict[int, int], fit: Callable[[pa.Array, np.ndarray, np.ndarray], Any]) -> Any:
    """``fit(texts, y, weight)`` of the bounded sample :func:`picked`, formed in one task: only the model comes to the driver, whose memory the texts and the fit don't take."""
    schema = pa.schema([("_id", pa.int64()), ("text", pa.string()), ("_y", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(it)
        got = pa.Table.from_batches(parts) if parts else schema.empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(*arranged(got, count)))], pa.binary())], names=["model"])

    model = near.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else fit(*arranged(schema.empty_table(), count))
