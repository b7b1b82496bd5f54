"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fed, join_hot, materialize, salted
from .words import BATCH_BYTES, Words, batches, mix, shingles


@dataclass(frozen=True)
class Settings:
    """``bands`` bands of ``rows`` samples find a pair of weighted Jaccard s with probability 1 - (1 - s**rows)**bands: 0.997 at 0.8.

    ``features``: document frequencies are kept for so many hashed shingles, whatever the corpus; shingles
    that share one share its count, as in any hashed TF-IDF. ``idf`` is the strength of the inverse document
    frequency, w = tf * (1 + idf * ln((1 + N) / (1 + df)) / ln(1 + N)). At full strength the edits of a copy, being
    new, would outweigh the text it shares with a thousand others, and large groups of near copies fell apart;
    at 0.25 common shingles still weigh up to a fifth less than rare ones.
    """

    size: int = 5
    threshold: float = 0.8
    bands: int = 11
    rows: int = 4
    features: int = 1 << 20
    idf: float = 0.25


DEFAULT = Settings()
_FEATURE_BLOCKS = 256
_DRAWS = 1 << 16
#: Members verified against their hub, and members in a block of a bucket, by one task.
STAR_ROWS, BLOCK_ROWS = 256, 512
#: Bytes of text in either.
BLOCK_BYTES = 16_000_000
#: Columns of a block's table of shingles that are multiplied out together.
COLUMNS = 2048


@lru_cache(maxsize=2)
def _draws(seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Draws of Gamma(2, 1) twice and Uniform(0, 1), for a shingle to pick by hash: r, 1 / r, beta, ln c - r."""
    rng = np.random.default_rng(seed)
    r, c, beta = rng.gamma(2, 1, _DRAWS), rng.gamma(2, 1, _DRAWS), rng.random(_DRAWS)
    r = np.maximum(r, 1e-3)
    return tuple(x.astype(np.float32) for x in (r, 1 / r, beta, np.log(c) - r))


def weighted_shingles(texts: pa.Array, size: int, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and weight, sorted by both; without ``idf`` the weight is the count."""
    h, doc = shingles(Words(texts), size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h))).astype(np.float32)
    h, doc = h[at], doc[at]
    return doc, h, tf if idf is None else tf * idf[(h & np.uint64(len(idf) - 1)).astype(np.int64)]


def sample_bands(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and their band hashes (texts x bands).

    Improved consistent weighted sampling: with draws r, c ~ Gamma(2, 1), b ~ U(0, 1) of the shingle,
    t = floor(ln w / r + b), ln y = r (t - b), and the sample is the shingle (with t) of least ln c - ln y - r.

    A shingle picks its draws from a table of 2^16 by a hash of the sample. In texts of more shingles than that many share
    draws and weights and are equal; of them the least by the other bits of that hash is taken, so each is as likely.
    """
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(doc)))
    r, inverse, beta, base = _draws()
    ln_w = np.log(weight).astype(np.float32)
    group = np.repeat(np.arange(len(first)), count)
    out = np.zeros((len(first), s.bands), np.uint64)
    for band in range(s.bands):
        total = np.zeros(len(first), np.uint64)
        for row in range(s.rows):
            odd = np.uint64((int(mix(np.array([band * s.rows + row + 1], np.uint64))[0])) | 1)
            z = (h ^ (h >> np.uint64(29))) * odd
            pick = (z >> np.uint64(48)).astype(np.int32)
            b, step = beta[pick], r[pick]
            t = np.floor(ln_w * inverse[pick] + b)
            a = base[pick] - step * (t - b)
            least = np.flatnonzero(a == np.minimum.reduceat(a, first)[group])
            if len(least) > len(first):  # equals: the order of the rest of their hash
                least = least[np.lexsort((z[least], group[least]))]
                least = least[np.append(True, np.diff(group[least]) > 0)]
            one = least
            total = mix(total ^ mix(h[one] + t[one].astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), row + 1), 5)
        out[:, band] = mix(total, band + 100)
    return doc[first], out


def hashed_frequencies(docs: DataFrame, s: Settings, text: str = "text") -> tuple[np.ndarray, int]:
    """Document frequencies of all shingles over all documents, by hashed feature, and the number of documents.

    Each task sums into one array; arrays meet block by block, so the driver gets ``features`` counts whatever the corpus.
    """
    width = s.features // _FEATURE_BLOCKS

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(s.features, np.int64), 0
        for batch in batches(it, "text"):
            n += batch.num_rows
            doc, h, _ = weighted_shingles(batch.column("text"), s.size, None)
            at = (h & np.uint64(s.features - 1)).astype(np.int64)
            pair = np.unique(doc * s.features + at)  # a document counts once for a feature
            total += np.bincount(pair % s.features, minlength=s.features)
        if n:
            blocks = total.astype(np.int32).reshape(_FEATURE_BLOCKS, width)
            some = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array([*(blocks[i].tobytes() for i in some), np.array([n], np.int64).tobytes()], pa.binary())], names=["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        k = table.column("block")[0].as_py()
        total = sum(np.frombuffer(x.as_py(), np.int64 if k < 0 else np.int32).astype(np.int64) for x in table.column("counts"))
        return pa.table({"block": pa.array([k], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "block int, counts binary")
    df, n = np.zeros((_FEATURE_BLOCKS, width), np.int64), 0
    for r in parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect():  # bounded by ``features``
        x = np.frombuffer(bytes(r["counts"]), np.int64)
        if r["block"] < 0:
            n = int(x[0])
        else:
            df[r["block"]] = x
    return df.reshape(-1), n


def idf_weights(df: np.ndarray, n: int, strength: float) -> np.ndarray:
    return (1 + strength * np.log((1 + n) / (1 + np.minimum(df, n))) / max(np.log(1 + n), 1e-9)).astype(np.float32)


def pair_similarity(a: pa.Array, b: pa.Array, s: Settings, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of the texts of ``a`` and ``b``, row by row: sum of least over sum of greatest weights."""
    da, ha, wa = weighted_shingles(a, s.size, idf)
    db, hb, wb = weighted_shingles(b, s.size, idf)
    n = len(a)
    totals = np.bincount(da, wa, n) + np.bincount(db, wb, n)
    doc, h, w = np.concatenate([da, db]), np.concatenate([ha, hb]), np.concatenate([wa, wb]).astype(np.float64)
    order = np.lexsort((h, doc))
    doc, h, w = doc[order], h[order], w[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    both = np.bincount(doc[same], np.minimum(w[same], w[same + 1]), n)
    return np.divide(both, totals - both, out=np.zeros(n), where=totals > 0)


def _linked(overlap: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether overlaps give a weighted Jaccard of ``threshold``, for total weights ``x`` by ``y``; no words link with nothing."""
    return (overlap >= threshold * (x + y - overlap)) & (overlap > 0)


def star_links(texts: pa.Array, s: Settings, idf: np.ndarray) -> np.ndarray:
    """Which texts are linked with the first."""
    doc, h, w = weighted_shingles(texts, s.size, idf)
    w = w.astype(np.float64)
    total = np.bincount(doc, w, len(texts))
    first = doc == 0
    at = np.searchsorted(h[first], h)
    there = at < first.sum()
    there[there] = h[first][at[there]] == h[there]
    overlap = np.bincount(doc[there], np.minimum(w[there], w[first][at[there]]), len(texts))
    return _linked(overlap, total, total[0], s.threshold)


def block_links(texts: pa.Array, left: np.ndarray, right: np.ndarray, part: np.ndarray, s: Settings, idf: np.ndarray) -> np.ndarray:
    """For each text, the number of the least text that links connect it to, over all pairs of ``left`` x ``right`` (masks).

    Weights of a shingle differ by its count only, so a pair's overlap is the product of its rows in a table of
    (shingle, nth occurrence) columns. Only columns that both sides have matter, and rows whose weight in them can
    still reach the threshold. The table is multiplied out in slices of ``COLUMNS``, so memory follows the block.
    """
    doc, h, w = weighted_shingles(texts, s.size, idf)
    w = w.astype(np.float64)
    n = len(texts)
    total = np.bincount(doc, w, n)
    unit = idf[(h & np.uint64(len(idf) - 1)).astype(np.int64)].astype(np.float64)
    count = np.rint(w / unit).astype(np.int64)
    each = np.repeat(np.arange(len(h)), count)  # one entry an occurrence
    nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    row, unit = doc[each], unit[each]
    _, col = np.unique(mix(h[each] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 7), return_inverse=True)
    least = np.arange(n)
    while True:  # leave out columns of one text, then rows that can't reach the threshold by what is left
        shared = (np.bincount(col) > 1)[col]
        row, col, unit = row[shared], col[shared], unit[shared]
        able = np.bincount(row, unit, n) >= s.threshold * total * (1 - 1e-12)
        if able[row].all():
            break
        keep = able[row]
        row, col, unit = row[keep], col[keep], unit[keep]
        if not len(row):
            return least
    if not len(row):
        return least
    _, col = np.unique(col, return_inverse=True)
    x, y = np.flatnonzero(able & left), np.flatnonzero(able & right)
    place_x, place_y = np.full(n, -1), np.full(n, -1)
    place_x[x], place_y[y] = np.arange(len(x)), np.arange(len(y))
    overlap = np.zeros((len(x), len(y)))
    order = np.argsort(col, kind="stable")
    row, col, unit = row[order], col[order], unit[order]
    for lo in range(0, int(col[-1]) + 1, COLUMNS):
        some = slice(np.searchsorted(col, lo), np.searchsorted(col, lo + COLUMNS))
        r, c, u = row[some], col[some] - lo, unit[some]
        a, b = np.zeros((len(x), COLUMNS)), np.zeros((len(y), COLUMNS))
        ax, by = place_x[r] >= 0, place_y[r] >= 0
        a[place_x[r[ax]], c[ax]] = u[ax]
        b[place_y[r[by]], c[by]] = 1
        overlap += a @ b.T
    hit = _linked(overlap, total[x][:, None], total[y][None, :], s.threshold) & (x[:, None] != y[None, :]) & (part[x][:, None] != part[y][None, :])
    i, j = np.nonzero(hit)
    while True:
        new = least.copy()
        np.minimum.at(new, x[i], least[y[j]])
        np.minimum.at(new, y[j], new[x[i]])
        if (new == least).all():
            return least
        least = new


def near_duplicates(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``id_col, class_id, class_size, kept``.

    A class is what links of weighted Jaccard similarity >= ``threshold`` over TF-IDF shingles of ``size`` words connect;
    ``class_id`` is its smallest id and ``kept`` marks that document. Equal texts are one node from the start. Nodes that agree
    in a band meet in its bucket, and all links between the mates of a bucket count:

    1. Each is verified against the bucket's hub, the member with most mates over all bands, which is the common
       original where there is one. A hub's text goes once to each block of ``STAR_ROWS`` members, so rows grow with the members.
    2. Buckets of three and more that are still in several classes are compared whole: members are dealt into blocks of
       ``BLOCK_ROWS``, those of the bucket's main class apart from the rest, and each pair of blocks but those of the
       main class with itself is one product of tables in a task, which gives back at most a row a member.

    Words are runs of anything but ASCII white space. A text of fewer words than ``size`` is one shingle. A text without
    words (null, empty) is a class of its own. Repeated rows and null ids are rows like any other; a class without
    an id has a null class and keeps all. Texts are told apart by a 64-bit hash.
    """
    s = settings
    keyed = fed(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).withColumn("node", F.xxhash64("text"))
    df, n = hashed_frequencies(keyed, s)
    idf = docs.sparkSession.sparkContext.broadcast(idf_weights(df, n, s.idf))  # ``features`` floats

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            doc, h, w = weighted_shingles(batch.column("text"), s.size, idf.value)
            if len(doc):
                who, bands = sample_bands(doc, h, w, s)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * s.bands), pa.array(bands.view(np.int64).reshape(-1)))
                size = pc.binary_length(batch.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(who)), size.take(pa.array(who)), lists], names=["node", "bytes", "bands"])

    signed = keyed.where("text is not null").select("node", "text").mapInArrow(sign, "node long, bytes long, bands array<long>")
    nodes = materialize(signed.groupBy("node").agg(F.first("bytes").alias("bytes"), F.first("bands").alias("bands")), "signatures")
    slots = nodes.select("node", "bytes", F.posexplode("bands").alias("band", "value"))
    total = nodes.count() * s.bands
    full = slots.groupBy("band", "value").agg(F.count("*").alias("n"), F.bit_xor("node").alias("who")).where("n > 1")
    # buckets of the same members are one
    full = full.groupBy("n", "who").agg(F.min(F.struct("band", "value")).alias("at"), F.count("*").alias("bands"))
    full = materialize(full.select("at.*", "n", "bands"), "full")
    buckets = materialize(join_hot(slots, full, ["band", "value"], "n", total), "buckets")
    texts = _texts(buckets.select("node").distinct(), keyed)

    reach = buckets.groupBy("node").agg(F.sum(F.col("n") * F.col("bands")).alias("reach"))
    hub = materialize(buckets.join(reach, "node").groupBy("band", "value").agg(F.max_by("node", F.struct("reach", "node")).alias("hub"), F.count("*").alias("_n")), "hubs")
    classes = connected_components(_stars(join_hot(buckets, hub, ["band", "value"], "_n", total).select("hub", "node", "bytes").where("node <> hub").distinct(), texts, s, idf))
    classes = materialize(classes, "classes")
    more = _blocks(_split(buckets, classes, total), texts, s, idf)
    classes = _joined(classes, more)

    named = keyed.select("id", "node", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("words"))
    named = named.join(classes, "node", "left").withColumn("part", F.coalesce("component", "node"))
    named = named.withColumn("part", F.when(F.coalesce("words", F.lit(False)), F.col("part")))
    named = materialize(named.select("id", "part"), "named")
    sizes = named.where("part is not null").groupBy("part").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    out = join_hot(named, materialize(sizes, "sizes"), ["part"], "class_size", named.count(), "left")
    alone = F.col("part").isNull()
    class_id = F.when(alone, F.col("id")).otherwise(F.col("class_id"))
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"))


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes ``node, component`` after more links: the classes that they connect become one."""
    if links.isEmpty():
        return classes
    a, b = (classes.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab")
    parts = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = materialize(connected_components(parts), "merged").withColumnsRenamed({"node": "old", "component": "new"})
    size = classes.groupBy(F.col("component").alias("old")).agg(F.count("*").alias("_n"))
    known = materialize(merged.join(size, "old"), "moves")
    moved = join_hot(classes.withColumn("old", F.col("component")), known, ["old"], "_n", classes.count(), "left").select("node", F.coalesce("new", "component").alias("component"))
    first = merged.join(classes, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return materialize(moved.union(first), "classes")


def _texts(nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """The text of each node, dealt out once: that of its row with the least id."""
    who = keyed.groupBy("node").agg(F.min(F.struct("id")).alias("one")).join(nodes, "node").select(F.col("node").alias("n"), F.col("one.id").alias("i"))
    texts = keyed.join(who, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("i"))).select("node", "text")
    return materialize(texts.dropDuplicates(["node"]), "texts")


def _stars(pairs: DataFrame, texts: DataFrame, s: Settings, idf) -> DataFrame:
    """Links ``a, b`` among pairs ``hub, node, bytes``."""
    blocks = pairs.groupBy("hub").agg(_needed(F.count("*"), F.sum("bytes"), STAR_ROWS).alias("blocks"))
    dealt = pairs.join(blocks, "hub").select("hub", salted(F.col("blocks"), F.col("node")).alias("block"), "node")
    heads = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"))
    rows = dealt.unionByName(heads).join(texts, "node")

    def verify(table: pa.Table) -> pa.Table:
        hub = table.column("hub")[0].as_py()
        node = table.column("node").to_numpy()
        order = np.argsort(node != hub, kind="stable")  # the hub first
        text, node = table.column("text").take(pa.array(order)), node[order]
        out = [np.zeros(0, np.int64)]
        at = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 1
        while lo < len(node):  # the hub with some members at a time, by bytes
            hi = max(lo + 1, int(np.searchsorted(at, at[lo - 1] + BATCH_BYTES, "right")))
            hit = star_links(pa.concat_arrays(text.take(pa.array([0, *range(lo, hi)])).chunks), s, idf.value)[1:]
            out.append(node[lo:hi][hit])
            lo = hi
        b = np.concatenate(out)
        return pa.table({"a": pa.array(np.full(len(b), hub), pa.int64()), "b": pa.array(b)})

    return rows.groupBy("hub", "block").applyInArrow(verify, "a long, b long")


def _needed(rows: Column, size: Column, per_block: int) -> Column:
    """Blocks for so many rows and bytes of text."""
    return F.ceil(F.greatest(rows / per_block, size / BLOCK_BYTES)).cast("int")


def _split(buckets: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Members of the buckets that are in several classes, but pairs, which the first round has settled, with ``main``: in the bucket's largest class, and the blocks ``p`` it needs and ``q`` of the rest."""
    now = buckets.where("n > 2").join(classes, "node", "left").select("band", "value", "node", "bytes", F.coalesce("component", "node").alias("part"))
    per = now.groupBy("band", "value", "part").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes"))
    top = per.groupBy("band", "value").agg(F.max(F.struct("k", "part", "bytes")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("n"), F.sum("bytes").alias("bytes")).where("parts > 1")
    p, q = _needed(F.col("top.k"), F.col("top.bytes"), BLOCK_ROWS), _needed(F.col("n") - F.col("top.k"), F.col("bytes") - F.col("top.bytes"), BLOCK_ROWS)
    top = materialize(top.select("band", "value", F.col("top.part").alias("top"), p.alias("p"), q.alias("q"), F.col("n").alias("_n")), "split")
    return join_hot(now.drop("bytes"), top, ["band", "value"], "_n", total).drop("_n").withColumn("main", F.col("part") == F.col("top"))


def _blocks(members: DataFrame, texts: DataFrame, s: Settings, idf) -> DataFrame:
    """Links ``a, b`` that connect whatever bucket mates are linked across classes."""
    m = members.withColumn("own", F.when(F.col("main"), salted(F.col("p"), F.col("node"))).otherwise(F.col("p") + salted(F.col("q"), F.col("node"))))
    # blocks 0..p-1 hold the main class, p..p+q-1 the rest; each pair with one of the rest at least meets once
    with_rest = F.sequence(F.col("p"), F.col("p") + F.col("q") - 1)
    mates = F.when(F.col("main"), with_rest).otherwise(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1))
    m = m.select("band", "value", "node", "part", "own", F.explode(mates).alias("mate"))
    m = m.select("band", "value", "node", "part", "own", F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"))
    rows = m.join(texts, "node")

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, part, own = (table.column(c).to_numpy() for c in ("node", "part", "own"))
        left, right = own == table.column("i")[0].as_py(), own == table.column("j")[0].as_py()
        least = block_links(pa.concat_arrays(table.column("text").chunks), left, right, part, s, idf.value)
        some = np.flatnonzero(least != np.arange(len(least)))
        return pa.table({"a": pa.array(node[some]), "b": pa.array(node[least[some]])})

    return materialize(rows.groupBy("band", "value", "i", "j").applyInArrow(verify, "a long, b long").distinct(), "links")


def drop_near_duplicates(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with its smallest id.

    Repeated rows of that id are that document and stay, as do rows without an id.
    """
    classes = near_duplicates(docs, settings, id_col, text).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    kept = docs.join(classes, F.col(id_col).eqNullSafe(F.col("_kept_id"))).drop("_kept_id")
    return kept
