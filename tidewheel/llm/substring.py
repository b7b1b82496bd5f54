"""Substring dedup: repeated word windows by winnowed anchors, extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fed, join_hot, materialize
from .words import Rolling, Words, batches, mix

#: Words of an anchor. A window of L words holds L - ANCHOR + 1 of them; its least hash is the window's anchor.
ANCHOR = 8


def _window_anchors(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows, runs with the same anchor: anchor hash, first and last window start, hash of what they cover.

    A window's anchor is its least anchor hash, the leftmost of equals, so equal windows have equal anchors at
    the same place. Hashes of ``length`` words depend on the words alone.
    """
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    roll = Rolling(w.hash)
    at = np.arange(n - ANCHOR + 1)
    gram = mix(roll.of(at, at + ANCHOR), 1)
    # 32 bits of hash over 32 bits of place: the minimum also says where it stands
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, have = length - ANCHOR + 1, 1
    while have < span:
        step = min(have, span - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(low))
    ok = start + length <= w.ends()[: len(low)]
    start, low = start[ok], low[ok]
    if not len(start):
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    doc = w.doc()[start]
    new = np.ones(len(start), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    lo = start[new]
    hi = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    mid = low[new]
    covered = mix(roll.of(lo, hi + length) + (mid - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64), 2)
    return gram[mid], lo, hi, covered


def repeated_spans(docs: DataFrame, length: int = 35, text: str = "text", key: str = "_key") -> DataFrame:
    """Word spans ``key, lo, hi`` (hi exclusive) covered by windows of ``length`` words that start elsewhere too.

    Seed: a window of ``length`` words is filed under its anchor, the least hash of its runs of ``ANCHOR`` words. Equal
    windows have equal anchors, so a window without a second occurrence of its anchor is unique; only about 2 / (length - ANCHOR + 2)
    of the words are anchors. Extend: an anchor's windows cover a stretch on both sides of it. Where the whole
    stretch occurs again, all its windows are repeats (the maximal case). Where anchors agree and
    stretches differ, one occurrence of each distinct stretch is reread and its windows are compared one by
    one. Counting is by partial sums, and counts come back to the rows by :func:`common.join_hot`: a passage in a third of all documents is
    never gathered in one task, and no pairs of occurrences are formed.
    """

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            w = Words(batch.column("text"))
            anchor, lo, hi, covered = _window_anchors(w, length)
            doc = w.doc()[lo] if len(lo) else lo
            base = w.first[doc]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(doc)), pa.array(anchor.view(np.int64)), pa.array(covered.view(np.int64)), pa.array((lo - base).astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                names=["key", "anchor", "covered", "lo", "more"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    seeds = materialize(rows.mapInArrow(scan, "key long, anchor long, covered long, lo int, more int"), "anchors")
    again = materialize(seeds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "again")
    total = seeds.count()
    shared = materialize(join_hot(seeds, again, ["anchor"], "n", total).drop("n"), "shared")
    stretches = materialize(shared.groupBy("anchor", "covered").agg(F.count("*").alias("same"), F.min(F.struct("key", "lo")).alias("one")), "stretches")
    kinds = stretches.groupBy("anchor").agg(F.count("*").alias("kinds"))
    told = join_hot(stretches, kinds, ["anchor"], "kinds", total)
    known = join_hot(shared, told, ["anchor", "covered"], "same", total)
    known = materialize(known.select("key", "anchor", "lo", "more", "same", "kinds", ((F.col("one.key") == F.col("key")) & (F.col("one.lo") == F.col("lo"))).alias("first")), "known")
    whole = known.where("same > 1").select("key", "lo", (F.col("lo") + F.col("more") + length).alias("hi"))

    # one occurrence of each stretch, of anchors with several
    parts = known.where("kinds > 1 and (same = 1 or first)").groupBy("key").agg(F.collect_list(F.struct("anchor", "lo", "more", (F.col("same") == 1).alias("open"))).alias("parts"))
    reread = rows.join(parts, "key")

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            w = Words(batch.column("text"))
            roll = Rolling(w.hash)
            parts = batch.column("parts")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            flat = parts.flatten()
            anchor, lo, more = (flat.field(k).to_numpy() for k in range(3))
            left = flat.field(3).to_numpy(zero_copy_only=False)
            each = np.repeat(np.arange(len(lo)), more + 1)
            start = (lo + w.first[doc])[each] + np.arange(len(each)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            inside = start + length <= w.first[doc[each] + 1]  # always, but for two texts with one key
            each, start = each[inside], start[inside]
            hashes = mix(roll.of(start, start + length), 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(doc[each])), pa.array(anchor[each]), pa.array(hashes.view(np.int64)), pa.array((start - w.first[doc[each]]).astype(np.int32)), pa.array(left[each])],
                names=["key", "anchor", "window", "lo", "open"],
            )

    single = materialize(reread.mapInArrow(windows, "key long, anchor long, window long, lo int, open boolean"), "windows")
    twice = single.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1")
    some = join_hot(single.where("open"), twice, ["anchor", "window"], "n", single.count()).select("key", "lo", (F.col("lo") + length).alias("hi"))
    return whole.union(some)


def drop_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words of repeated windows: ``text`` is what is left, ``n_words``, ``n_removed``, ``removed`` are appended.

    Words are maximal runs of anything but ASCII white space, unchanged. A window is ``length`` consecutive words of one
    document; a word goes if a window that covers it has a word sequence that also starts anywhere else, in the same
    document too. Windows are judged on the input. Words left are joined by one space; ``removed`` lists the spans ``lo, hi`` of word
    numbers that went, merged and in order. Null and empty texts have no words and an empty text is left.
    Repeated rows repeat all their windows. Rows are told apart by a 64-bit hash of id and text; other columns pass through.
    """
    clash = [c for c in docs.columns if c.lower() in ("n_words", "n_removed", "removed")]
    keyed = fed(docs.drop(*clash)).withColumn("_key", F.xxhash64(F.col(id_col), F.col(text)))
    spans = repeated_spans(keyed, length, text).groupBy("key").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))).alias("_spans"))
    joined = keyed.join(spans.withColumnRenamed("key", "_key"), "_key", "left").drop("_key").withColumnRenamed(text, "_text_")
    out = joined.drop("_spans", "_text_").schema.add("_left", "string").add("n_words", "long").add("n_removed", "long").add("removed", T.ArrayType(T.StructType().add("lo", T.IntegerType()).add("hi", T.IntegerType())))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "_text_"):
            left, total, gone, spans = [], [], [], []
            found = batch.column("_spans")
            ends, flat = found.offsets.to_numpy(), found.values.to_numpy()
            for i, raw in enumerate(batch.column("_text_")):
                words = (raw.as_py() or "").encode().split()
                merged: list = []
                if ends[i + 1] > ends[i]:
                    own = np.sort(flat[ends[i] : ends[i + 1]])
                    lo, hi = own >> 32, np.maximum.accumulate(own & 0xFFFFFFFF)
                    opens = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
                    merged = np.stack([lo[opens], hi[np.append(opens[1:] - 1, len(lo) - 1)]], axis=1).tolist()
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                left.append(b" ".join(kept))
                total.append(len(words))
                gone.append(len(words) - len(kept))
                spans.append([{"lo": a, "hi": b} for a, b in merged])
            other = [batch.column(c) for c in batch.schema.names if c not in ("_spans", "_text_")]
            yield pa.RecordBatch.from_arrays([*other, pa.array(left, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=out.names)

    done = joined.mapInArrow(cut, out)
    return done.select(*[F.col("_left").alias(c) if c == text else F.col(c) for c in docs.columns if c not in clash], "n_words", "n_removed", "removed")
