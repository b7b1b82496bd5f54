"""The vectors nearest to many users' mean vectors, with users and what is found kept in place while the vectors pass by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import laid, nine, places
from .sequence import last_events

#: Users of a block, which one task holds with their lists (some 4 KB each for 75 places); with few users, as few as 512 for up to 24 blocks.
BLOCK_USERS, LEAST_USERS, FEW_BLOCKS = 98_304, 512, 24
#: Users whose lists are ordered together, and users multiplied at a time.
CHUNK, TILE = 2048, 64
MEAN, SEEN, VECTOR = 0, 1, 2


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(v), -1)


class _Asks:
    """Users of a block: means of vectors, items that aren't for them, and the first ``k`` of what has passed by."""

    def __init__(self, k: int):
        self.k, self.users, self.sums, self.counts, self.seen = k, [], [], [], []

    def mean(self, user: np.ndarray, v: np.ndarray) -> None:
        """Vectors of users in order; the last user's may go on in the next batch."""
        first = np.flatnonzero(np.r_[True, user[1:] != user[:-1]])
        ids, sums, counts = user[first], np.add.reduceat(v, first, axis=0), np.diff(np.r_[first, len(user)])
        if self.users and self.users[-1][-1] == ids[0]:
            self.sums[-1][-1] += sums[0]
            self.counts[-1][-1] += counts[0]
            ids, sums, counts = ids[1:], sums[1:], counts[1:]
        if len(ids):
            self.users.append(ids)
            self.sums.append(sums)
            self.counts.append(counts)

    def begin(self) -> None:
        self.user = np.concatenate(self.users)
        self.q = np.concatenate(self.sums) / np.concatenate(self.counts)[:, None]
        self.users, self.sums, self.counts = [], [], []
        who, item = np.concatenate([s[0] for s in self.seen]), np.concatenate([s[1] for s in self.seen])
        at = np.minimum(np.searchsorted(self.user, who), len(self.user) - 1)
        own = self.user[at] == who
        order = np.argsort(at[own], kind="stable")
        self.seen_by, self.seen_item = at[own][order], item[own][order]
        self.norm = np.sqrt((self.q * self.q).sum(axis=1))
        big = np.abs(self.q).max(initial=0.0)
        self.q32 = self.q.astype(np.float32) if big < 1e15 else None  # not where it is NaN either
        self.least = np.full(len(self.user), -np.inf)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        chunks = range(0, len(self.user), CHUNK)
        self.held, self.more = [none for _ in chunks], [[] for _ in chunks]

    def order(self, c: int) -> None:
        """The chunk's lists in order of score and item, cut at ``k``."""
        who, item, score = (np.concatenate(x) for x in zip(self.held[c], *self.more[c], strict=True))
        at = np.lexsort((item, -nine(score), who))
        place = places(who[at])
        self.held[c], self.more[c] = (who[at][place <= self.k], item[at][place <= self.k], score[at][place <= self.k]), []
        full = at[place == self.k]
        self.least[who[full]] = score[full]

    def meet(self, item: np.ndarray, v: np.ndarray) -> None:
        """Vectors pass by. Products in single precision leave out what is surely too low, the rest is multiplied again in double precision."""
        whole = np.isfinite(v).all(axis=1)
        item, v = item[whole], v[whole]
        low = self.q32 is not None and np.abs(v).max(initial=0.0) < 1e15
        q, have = (self.q32, v.astype(np.float32)) if low else (self.q, v)
        # twice what a product may be off by, and what may be equal at nine digits
        slack = 2 * (v.shape[1] + 4) * np.finfo(q.dtype).eps * self.norm * np.sqrt((v * v).sum(axis=1).max(initial=0.0)) + 4e-9
        by_item = np.argsort(item, kind="stable")
        left, right = np.searchsorted(item[by_item], self.seen_item), np.searchsorted(item[by_item], self.seen_item, side="right")
        own, at = laid(left, right - left)
        gone_by, gone = self.seen_by[own], by_item[at]
        m, k = len(item), self.k
        for c in range(len(self.held)):
            end = min((c + 1) * CHUNK, len(self.user))
            for a in range(c * CHUNK, end, TILE):
                z = min(a + TILE, end)
                s = q[a:z] @ have.T
                lo, hi = np.searchsorted(gone_by, (a, z))
                s[gone_by[lo:hi] - a, gone[lo:hi]] = -np.inf
                low_score = self.least[a:z] - slack[a:z]
                hits = None
                if np.isfinite(low_score).all():
                    hits = np.flatnonzero(s >= np.nextafter(low_score.astype(s.dtype), s.dtype.type(-np.inf))[:, None])
                if m > k and (hits is None or len(hits) > 4 * k * (z - a)):
                    low_score = np.maximum(low_score, np.partition(s, m - k, axis=1)[:, m - k] - slack[a:z])
                    hits = None
                if hits is None:
                    hits = np.flatnonzero((s >= np.nextafter(low_score.astype(s.dtype), s.dtype.type(-np.inf))[:, None]) & (s > -np.inf))
                who, what = hits // m + a, hits % m
                self.more[c].append((who, item[what], np.einsum("ij,ij->i", self.q[who], v[what])))
            if sum(len(x[0]) for x in self.more[c]) >= k * (end - c * CHUNK):
                self.order(c)

    def lists(self, user_kind: pa.DataType, item_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for c in range(len(self.held)):
            self.order(c)
            who, item, score = self.held[c]
            if len(who):
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                ends = pa.array(np.r_[first, len(who)], pa.int32())
                ids, scores = pa.ListArray.from_arrays(ends, pa.array(item).cast(item_kind)), pa.ListArray.from_arrays(ends, pa.array(score))
                yield pa.RecordBatch.from_arrays([pa.array(self.user[who[first]]).cast(user_kind), ids, scores], ["user_id", "ids", "scores"])


def vector_lists(hist: DataFrame, items: DataFrame, budget: int, parts: int, n: int = 50) -> DataFrame:
    """Of every user the first ``budget`` of ``items(item_id, v)`` by inner product with the mean vector of the last ``n`` events' items, none of ``hist``: ``user_id, ids, scores``, a row a user.

    Users are dealt into blocks that hold whole parts of those by user, and every block gets all vectors one behind the other: a vector is sent once for ``BLOCK_USERS`` users, a user's own vectors once,
    and neither asks nor what is found by the way are sent at all. Users none of whose last items has a vector have no rows; a vector that holds nulls or isn't finite is nobody's.
    """
    users = hist.select("user_id").distinct().count()
    blocks = max(1, -(-users // BLOCK_USERS), min(FEW_BLOCKS, -(-users // LEAST_USERS), parts))
    if blocks > parts:
        blocks = -(-blocks // parts) * parts
    # as buckets are numbered
    part = F.pmod(F.hash("user_id"), F.lit(max(parts, blocks)))
    items = items.where("v is not null")
    late = last_events(hist.select("user_id", "item_id", "ts"), 1 << 30).select("user_id", "item_id", (F.col("back") <= n).alias("late"))
    own = late.join(items, "item_id").select((part % blocks).cast("int").alias("block"), F.when(F.col("late"), MEAN).otherwise(SEEN).alias("kind"), "user_id", "item_id", F.when(F.col("late"), F.col("v")).alias("v"))
    all_ = items.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(VECTOR).alias("kind"), F.lit(None).cast(dict(hist.dtypes)["user_id"]).alias("user_id"), "item_id", "v")
    rows = own.unionByName(all_).repartitionById(blocks, F.col("block")).sortWithinPartitions("kind", "user_id").select("kind", "user_id", "item_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, begun, kinds = _Asks(budget), False, None
        for batch in batches:
            kinds = batch.schema.field("user_id").type, batch.schema.field("item_id").type
            kind = batch.column("kind").to_numpy()
            ends = np.searchsorted(kind, [SEEN, VECTOR])
            for what, a, z in zip((MEAN, SEEN, VECTOR), np.r_[0, ends], np.r_[ends, len(kind)], strict=True):
                rows = batch.slice(a, z - a)
                if z == a:
                    continue
                item = rows.column("item_id").to_numpy(zero_copy_only=False)
                if what != VECTOR:
                    user = rows.column("user_id").to_numpy(zero_copy_only=False)
                    asks.seen.append((user, item))
                    if what == MEAN:
                        asks.mean(user, matrix(rows))
                elif asks.users or begun:
                    if not begun:
                        asks.begin()
                        begun = True
                    asks.meet(item, matrix(rows))
        if begun:
            yield from asks.lists(*kinds)

    return rows.mapInArrow(run, f"user_id {dict(hist.dtypes)['user_id']}, ids array<{dict(items.dtypes)['item_id']}>, scores array<double>")
