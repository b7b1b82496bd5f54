"""Benchmark decontamination: every suffix of the test items is searched in suffix arrays of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fed, materialize
from .words import Rolling, Words, batches

#: Bytes of texts whose suffixes are sorted together, and words at most: a longer text is cut into pieces that overlap by an item.
SHARD_BYTES, SHARD_WORDS = 4_000_000, 1_000_000
#: Bytes of benchmark texts that are broadcast together; a larger benchmark is searched block by block.
BLOCK_BYTES = 32_000_000
#: Pairs of a document and an item that are looked at together.
PAIRS = 2_000_000

#: A word is a run of digits, letters a-z (after lower-casing A-Z) and whatever is beyond ASCII.
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

SPANS = T.ArrayType(T.StructType().add("lo", T.IntegerType()).add("hi", T.IntegerType()))
_NEW = ("n_words", "n_hit", "longest", "items", "spans")


@dataclass
class Items:
    """Words of all items, one after another, and for each word: its item's number (-1 without an id) and hash, one past the item's last word, and
    the words of a window that begins there (0: too few are left)."""

    ids: list[str]
    words: np.ndarray
    item: np.ndarray
    mark: np.ndarray
    end: np.ndarray
    need: np.ndarray

    @classmethod
    def of(cls, ids: list[str | None], texts: pa.Array, window: int) -> Items:
        w = Words(texts, SEPARATORS, lower=True)
        names = sorted({i for i in ids if i is not None})
        number = {x: k for k, x in enumerate(names)}
        length = np.diff(w.first)
        need = np.repeat(np.minimum(length, window), length)
        end = w.ends()
        need[np.arange(len(end)) + need > end] = 0
        item = np.repeat(np.array([number.get(i, -1) for i in ids], np.int64), length)
        mark = np.repeat(Rolling(w.hash).of(w.first[:-1], w.first[1:]).view(np.int64), length)
        return cls(names, w.hash, item, mark, end, need)

    @property
    def longest(self) -> int:
        """Words of the longest item."""
        return int(np.diff(np.flatnonzero(np.append(True, self.end[1:] != self.end[:-1])), append=len(self.end)).max()) if len(self.end) else 0


class SuffixArray:
    """The suffixes of a shard's documents in the order of their first ``depth`` words; a suffix ends with its document.

    Words are numbered in the order of their hashes, as many of them as fit are packed in one integer, and suffixes are sorted by it. Those that
    tie are sorted by the rank of what follows, which doubles the words compared each time, until nothing ties or ``depth`` is reached.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, depth: int):
        n = len(words)
        self.alphabet, ids = np.unique(words, return_inverse=True)
        self.ids, self.ends = np.append(ids + 1, 0), ends  # 0: past the end
        self.bits = len(self.alphabet).bit_length()
        self.pack = max(1, min(depth, 63 // max(1, self.bits)))
        at, key = np.arange(n), np.zeros(n, np.int64)
        for k in range(self.pack):
            key = key << self.bits | np.where(at + k < ends, self.ids[np.minimum(at + k, n)], 0)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        new = np.ones(n + 1, bool)  # a suffix that differs from the one before; the end is one
        new[1:n] = self.keys[1:] != self.keys[:-1]
        rank = np.empty(n, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(new[:n], at, 0))
        reach = self.pack
        while reach < depth:
            tied = np.flatnonzero(~new[:n] | ~new[1:])
            if not len(tied):
                break
            p = self.order[tied]
            then = p + reach
            pair = rank[p] * (n + 1) + np.where(then < ends[p], rank[np.minimum(then, n - 1)] + 1, 0)
            by = np.argsort(pair, kind="stable")
            self.order[tied], pair = p[by], pair[by]
            new[tied[1:]] |= pair[1:] != pair[:-1]
            rank[self.order[tied]] = np.maximum.accumulate(np.where(new[:n], at, 0))[tied]
            reach *= 2

    def _first(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Binary search, of all suffixes at once: the first place in [lo, hi) whose word at ``depth`` is ``word`` or greater."""
        lo, hi, n = lo.copy(), hi.copy(), len(self.order)
        while (go := lo < hi).any():
            mid = (lo + hi) >> 1
            p = self.order[np.minimum(mid, n - 1)]
            less = self.ids[np.where(p + depth < self.ends[p], p + depth, n)] < word
            lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
        return lo

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``t, lo, hi, depth``: the suffix of the items at word t agrees for ``depth`` words with the suffixes at places lo to hi, and with fewer for more.

        A t with a window has its windows' places in its first row, which has the least depth, and its longest match in its last.
        """
        m = len(items.words)
        none = np.zeros(0, np.int64)
        if not m or not len(self.order):
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.alphabet, items.words), len(self.alphabet) - 1)
        ids = np.where(self.alphabet[at] == items.words, at + 1, 0)
        place = np.arange(m)
        # words up to the item's end or the first one that the shard lacks
        room = np.minimum(np.minimum.accumulate(np.where(ids == 0, place, m)[::-1])[::-1], items.end) - place
        t = np.flatnonzero((items.need > 0) & (room >= items.need))
        depth = np.minimum(items.need[t], self.pack)
        low, high = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for k in range(self.pack):
            word, told = ids[np.minimum(t + k, m - 1)], k < depth
            low = low << self.bits | np.where(told, word, 0)
            high = high << self.bits | np.where(told, word, (1 << self.bits) - 1)
        lo, hi = np.searchsorted(self.keys, low), np.searchsorted(self.keys, high, "right")
        keep = lo < hi
        t, lo, hi, depth = t[keep], lo[keep], hi[keep], depth[keep]
        rows = []
        while len(t):
            more = np.flatnonzero(room[t] > depth)
            lo2, hi2 = lo.copy(), lo.copy()
            word = ids[t[more] + depth[more]]
            lo2[more] = self._first(lo[more], hi[more], depth[more], word)
            hi2[more] = self._first(lo2[more], hi[more], depth[more], word + 1)
            told = (depth >= items.need[t]) & ((lo2 != lo) | (hi2 != hi))
            rows.append((t[told], lo[told], hi[told], depth[told]))
            keep = lo2 < hi2
            t, lo, hi, depth = t[keep], lo2[keep], hi2[keep], depth[keep] + 1
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (none, none, none, none)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of all integers in the ranges lo to hi."""
    n = hi - lo
    each = np.repeat(np.arange(len(lo)), n)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + lo[each]


def _shards(w: Words, items: Items) -> Iterator[tuple[int, int, SuffixArray]]:
    """Suffix arrays of a batch: the first word of a shard, the words that begin in it, and the array."""
    n, ends, longest = len(w.hash), w.ends(), max(1, items.longest)
    for lo in range(0, n, SHARD_WORDS):
        hi = min(n, lo + SHARD_WORDS + longest - 1)
        yield lo, min(SHARD_WORDS, n - lo), SuffixArray(w.hash[lo:hi], np.minimum(ends[lo:hi], hi) - lo, longest)


def _hits(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: words inside an occurrence of a window, the longest match that begins at each word, and (document, item) pairs as one number."""
    n, doc = len(w.hash), w.doc()
    edge, best, pairs = np.zeros(n + 1, np.int64), np.zeros(n, np.int64), np.zeros(0, np.int64)
    width = max(1, len(items.ids))
    for base, own, array in _shards(w, items):
        t, lo, hi, depth = array.search(items)
        if not len(t):
            continue
        # equal suffixes of several items have the same places: each is looked at once
        cells = len(array.order) + 1
        same, one = np.unique((lo * cells + hi) * (int(depth.max()) + 1) + depth, return_index=True)
        for part in np.array_split(one, -(-int((hi - lo)[one].sum()) // PAIRS)):
            each, at = _spread(lo[part], hi[part])
            at = array.order[at]
            mine = at < own
            np.maximum.at(best, at[mine] + base, depth[part][each[mine]])
        order = np.lexsort((depth, t))
        order = order[np.append(True, t[order][1:] != t[order][:-1])]  # the windows
        need = items.need[t[order]]
        window, one, kind = np.unique((lo[order] * cells + hi[order]) * (int(need.max()) + 1) + need, return_index=True, return_inverse=True)
        each, at = _spread(lo[order][one], hi[order][one])
        at = array.order[at]
        each, at = each[at < own], at[at < own] + base
        edge += np.bincount(at, minlength=n + 1)
        edge -= np.bincount(at + need[one][each], minlength=n + 1)
        # items of a window, and documents with it
        known = items.item[t[order]] >= 0
        owners = np.unique(kind[known] * width + items.item[t[order]][known])
        begin = np.searchsorted(owners, np.arange(len(window) + 1) * width)
        held = np.unique(each * max(1, w.n_docs) + doc[at])
        kinds, docs = held // max(1, w.n_docs), held % max(1, w.n_docs)
        total = np.cumsum(begin[kinds + 1] - begin[kinds])
        for part in np.split(np.arange(len(held)), np.flatnonzero(np.diff(total // PAIRS)) + 1):
            row, k = _spread(begin[kinds[part]], begin[kinds[part] + 1])
            pairs = np.union1d(pairs, docs[part][row] * width + owners[k] % width)
    return np.cumsum(edge[:n]) > 0, best, pairs


def _runs(hit: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Spans of hit words of each document, counted from its first word."""
    start = np.zeros(len(hit) + 1, bool)
    start[first] = True
    opens = hit & (start[:-1] | ~np.append(False, hit[:-1]))
    closes = hit & (start[1:] | ~np.append(hit[1:], False))
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    at = np.searchsorted(lo, first)
    base = np.repeat(first[:-1], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))], names=["lo", "hi"]))


def _blocks(benchmark: DataFrame, window: int, id_col: str, text: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark's items in blocks of at most ``block_bytes`` of text, or of one item: dealt by hash into as many parts as that takes."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    size = F.octet_length("text")
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
        if n == 1 or not dealt.groupBy("part").agg(F.sum(size).alias("size"), F.count("*").alias("rows")).where(f"size > {block_bytes} and rows > 1").head(1):
            break
        n *= 2
    for k in range(n):
        got = dealt.where(F.col("part") == k).select("id", "text").toArrow()
        if got.num_rows:
            yield Items.of(got.column("id").to_pylist(), got.column("text").combine_chunks(), window)


def _find(docs: DataFrame, items: Items, text: str, keep_text: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kept = [f for f in docs.schema if keep_text or f.name != text]
    out = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("longest", T.IntegerType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        names, width = pa.array(items.ids, pa.string()), max(1, len(items.ids))
        for batch in batches(it, text, SHARD_BYTES):
            w = Words(batch.column(text), SEPARATORS, lower=True)
            hit, best, pairs = _hits(w, items)
            so_far = np.append(0, np.cumsum(hit))
            found = np.searchsorted(pairs, np.arange(w.n_docs + 1) * width).astype(np.int32)
            longest = np.zeros(w.n_docs, np.int64)
            np.maximum.at(longest, w.doc(), best)
            new = [
                pa.array(np.diff(w.first), pa.int64()), pa.array(so_far[w.first[1:]] - so_far[w.first[:-1]], pa.int64()), pa.array(longest.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(found), names.take(pa.array(pairs % width))), _runs(hit, w.first),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *new], names=[f.name for f in out])

    return docs.mapInArrow(scan, out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words, n_hit, longest, items, spans`` appended, without its text unless ``keep_text``.

    Words are runs of digits, a-z (A-Z count as a-z) and whatever is beyond ASCII. A window is ``window`` consecutive words of an item, or the whole
    item if it has fewer; a document word inside an occurrence of a window is hit. ``spans`` are the runs of hit words
    (hi exclusive), ``items`` the ids, as strings in order, of items with a window in the document, ``longest`` the words of the longest verbatim match with an item.

    A task sorts the suffixes of its documents, a shard of about ``SHARD_BYTES`` after another, and searches every suffix of the items in each; a document
    stays in its task, so nothing is shuffled. The items are broadcast: ``block_bytes`` of text at most. A larger benchmark is dealt into such
    blocks, each searched in a pass of its own, and what they find meets by the row's hash.

    Null and empty texts have no words. A repeated item id is one item; an item without an id hits words but is in no list. Without
    items nothing is hit. Repeated documents each have their row. Other columns pass through, but for those named as the new ones.
    """
    docs = fed(docs.drop(*[c for c in docs.columns if c.lower() in _NEW]))
    blocks = _blocks(benchmark, window, item_id, item_text, block_bytes)
    first = next(blocks, Items.of([], pa.array([], pa.string()), window))
    rest = next(blocks, None)
    if rest is None:
        return _find(docs, first, text, keep_text)
    keyed = docs.withColumn("_row", F.xxhash64(*[c for c, kind in docs.dtypes if "map" not in kind]))
    whole, parts = materialize(_find(keyed, first, text, keep_text), "leaks"), []
    hits = lambda d: d.where("n_hit > 0").select("_row", "longest", "items", "spans").distinct()
    while rest is not None:
        parts.append(materialize(hits(_find(keyed.select("_row", text), rest, text, False)), "leaks"))
        rest = next(blocks, None)
    told = hits(whole)
    for p in parts:
        told = told.unionByName(p)
    # ranges by their starts; a span grows the last one if it begins within it
    grown = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))), F.array().cast(SPANS),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["hi"] >= s["lo"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["lo"].alias("lo"), F.greatest(F.element_at(out, -1)["hi"], s["hi"]).alias("hi"))))).otherwise(F.concat(out, F.array(s))),
    )
    met = told.groupBy("_row").agg(F.max("longest").alias("_l"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_i"), grown.alias("_s"))
    joined = whole.join(met, "_row", "left")
    hit = F.aggregate("_s", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return joined.select(
        *[c for c in whole.columns if c not in (*_NEW, "_row")], "n_words", F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_l", F.lit(0)).alias("longest"),
        F.coalesce("_i", F.array().cast("array<string>")).alias("items"), F.coalesce("_s", F.array().cast(SPANS)).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of an item; cases as in :func:`find_leaks`."""
    clash = [c for c in docs.columns if c.lower() in _NEW]
    safe = docs.select(*[F.col(c).alias(f"_doc_{c}") if c in clash else F.col(c) for c in docs.columns])
    left = find_leaks(safe, benchmark, window, text, item_id, item_text, keep_text=True).where("n_hit = 0")
    return left.select(*[F.col(f"_doc_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of every item suffix that has a window in the documents: ``item_id, item_word, length, occurrences, doc_id, doc_word``.

    ``item_word`` is where the suffix begins, ``occurrences`` how often its longest match stands in all shards, ``doc_id`` (as long) and ``doc_word`` the first
    of these places. A shard gives one row a suffix, so what is shuffled does not grow with the occurrences. Items are told apart by id and text;
    nulls as in :func:`find_leaks`.
    """
    rows = fed(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text")))
    found = None
    for items in _blocks(benchmark, window, item_id, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def scan(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            names = pa.array([*items.ids, None], pa.string())
            begin = np.searchsorted(items.end, items.end)  # of each word's item
            for batch in batches(it, "text", SHARD_BYTES):
                w = Words(batch.column("text"), SEPARATORS, lower=True)
                doc, ids = w.doc(), batch.column("doc")
                for base, own, array in _shards(w, items):
                    t, lo, hi, depth = array.search(items)
                    by = np.lexsort((depth, t))
                    last = by[np.append(t[by][1:] != t[by][:-1], True)] if len(by) else by
                    each, at = _spread(lo[last], hi[last])
                    at = array.order[at]
                    each, at = each[at < own], at[at < own] + base
                    if not len(each):
                        continue
                    key = pc.fill_null(ids, -(2**63)).to_numpy()[doc[at]]
                    order = np.lexsort((at, key, each))
                    one = order[np.append(True, each[order][1:] != each[order][:-1])]
                    rows, count = last[each[one]], np.bincount(each, minlength=len(last))[each[one]]
                    suffix = t[rows]
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(np.where(items.item[suffix] < 0, len(items.ids), items.item[suffix]))), pa.array(items.mark[suffix]), pa.array((suffix - begin[suffix]).astype(np.int32)),
                         pa.array(depth[rows].astype(np.int32)), pa.array(count), ids.take(pa.array(doc[at[one]])), pa.array((at[one] - w.first[doc[at[one]]]).astype(np.int32))],
                        names=["item", "mark", "word", "length", "n", "doc", "at"],
                    )

        part = rows.mapInArrow(scan, "item string, mark long, word int, length int, n long, doc long, at int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id string, item_word int, length int, occurrences long, doc_id long, doc_word int")
    best = found.groupBy("item", "mark", "word", "length").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "at")).alias("where"))
    best = best.groupBy("item", "mark", "word").agg(F.max_by(F.struct("length", "n", "where"), "length").alias("best"))
    return best.select(F.col("item").alias("item_id"), F.col("word").alias("item_word"), "best.length", F.col("best.n").alias("occurrences"), F.col("best.where.doc").alias("doc_id"), F.col("best.where.at").alias("doc_word"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
need AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM need)),
places AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS key
           FROM (SELECT d.doc_id, d.w, s.k, unnest(range(1, len(d.w) - s.k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM need) s WHERE len(d.w) >= s.k)),
met AS (SELECT p.doc_id, p.i, p.k, p.key, w.item_id FROM places p JOIN windows w ON w.k = p.k AND w.key = p.key),
hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT doc_id, i, k FROM met)) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN own o ON o.doc_id = d.doc_id
"""
