"""Vector best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fed, materialize, salted, spread
from .words import batches

CAP = 2048
#: Pieces packed together. A block leaves about one sequence part full, of a few thousand.
BLOCK_PIECES = 8192


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, with its own handling of the special tokens that a text spells out.

    A byte-level BPE file without a normalizer is also loaded into ``tiktoken``, which gives the same ids of the same
    vocabulary at a fifth of the cost. It splits texts by Unicode classes of its own release, so only texts
    whose characters have had the same classes in every release go there; any other, and any that holds an added token's string, goes to ``tokenizers``.
    """

    #: Latin, general punctuation and the euro sign.
    _OTHER = "[^\x00-\u024f\u2010-\u2027\u20ac]"
    #: The fixed pattern of byte-level BPE as its files imply it (``use_regex``).
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or () if t["content"]]
        self.slow = re.compile("|".join([self._OTHER, *added]))
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges")
        if not plain or odd:
            return None
        import tiktoken

        special = {t["content"] for t in spec.get("added_tokens", ())}
        # printable bytes stand for themselves, the others for the characters from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        if order != sorted(order):  # ranks must say which merge comes first
            return None
        return tiktoken.Encoding("file", pat_str=self._PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        if self.fast:
            for i, x in enumerate(texts):
                if not self.slow.search(x):
                    out[i] = self.fast.encode_ordinary(x)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.exact.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, cap: int = CAP, end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``cap`` ids: ``id_col, piece, start, length, ids_crc32`` and, unless ``keep_ids`` is false, ``ids``.

    A document is the ids of its whole text, without special tokens, then ``end_id`` (null or empty text: that id alone). Only
    a longer one is cut: all pieces are full but the first, which takes the rest. ``ids_crc32``
    is the unsigned CRC-32 of the ids as little-endian 32-bit integers. ``tokenizer_path`` is a file
    on each executor. Repeated rows are pieces of their own.
    """
    id_type = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if keep_ids:
        out.add("ids", T.ArrayType(T.IntegerType()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches(it, "text"):
            where, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, e in enumerate(encode([x or "" for x in batch.column("text").to_pylist()])):
                e.append(end_id)
                ids = np.array(e, "<u4")
                first = len(ids) % cap or cap
                cuts = [0, *range(first, len(ids) + 1, cap)] if len(ids) > cap else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    where.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int32))
            columns = [batch.column("id").take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                ends = np.cumsum([0, *length]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return fed(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).mapInArrow(run, out)


def best_fit(sizes: np.ndarray, caps: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and order of placement of every item; ``sizes`` is items x dimensions, none above ``caps``.

    Items go from the largest weighted size down. Of the bins with room in every dimension one is
    chosen: ``norm``, the least weighted norm of what would be left; ``dot``, the greatest
    weighted dot product of the item with what is left now. Without room anywhere, a bin opens.
    """
    n, d = sizes.shape
    need = sizes / caps
    order = np.lexsort((np.arange(n), -(need @ weights)))
    left = np.empty((d, max(16, n)))
    ids = np.empty(max(16, n), np.int64)
    smallest = need.min(axis=0) if n else np.zeros(d)
    live, opened = 0, 0
    place = np.empty(n, np.int64)
    for i in order:
        x = need[i]
        fits = np.ones(live, bool)
        for k in range(d):
            fits &= left[k, :live] >= x[k] - 1e-12
        at = np.flatnonzero(fits)
        if len(at):
            rest = left[:, at]
            score = (weights * x) @ rest if rule == "dot" else -(weights @ (rest - x[:, None]) ** 2)
            j = at[np.argmax(score)]
        else:
            j, live = live, live + 1
            left[:, j], ids[j] = 1.0, opened
            opened += 1
        left[:, j] -= x
        place[i] = ids[j]
        if (left[:, j] < smallest - 1e-12).any():  # full: nothing fits any more
            live -= 1
            left[:, j], ids[j] = left[:, live], ids[live]
    return place, order


def pack_pieces(pieces: DataFrame, cap: int = CAP, max_docs: int | None = None, attention_cap: float | None = None, weights: Sequence[float] = (1.0, 0.1, 0.1), rule: str = "norm", block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences within three capacities.

    A sequence holds at most ``cap`` ids, ``max_docs`` pieces (default: ``cap``, which cannot bind) and
    an attention cost, the sum of the squared piece lengths, of ``attention_cap`` (default: ``cap`` squared, which
    cannot bind). ``weights`` weigh the residuals of tokens, count and cost in :func:`best_fit`, where all three choose the
    bin whether or not they bind; the defaults need no more sequences than tokens alone (3508 of 8192 pieces either way, 3508 being the floor). Pieces are dealt
    by hash into blocks of about ``block_pieces``, each packed in one task; offsets run
    gapless from 0 in order of placement. A piece above a capacity by itself raises an error.
    """
    max_docs, attention_cap = max_docs or cap, attention_cap or float(cap) ** 2
    caps, w = np.array([cap, max_docs, attention_cap], float), np.array(weights, float)
    n_blocks = spread(pieces.count(), block_pieces)
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        # a fixed order whatever the order of arrival
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("_key", "ascending")])
        length = table.column("length").to_numpy().astype(float)
        sizes = np.stack([length, np.ones(len(length)), length**2], axis=1)
        if (sizes > caps).any():
            raise ValueError("a piece exceeds a capacity of its own")
        place, order = best_fit(sizes, caps, w, rule)
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order))
        by = np.lexsort((nth, place))
        ends = np.cumsum(length[by])
        first = np.searchsorted(place[by], place[by])
        offset = np.empty(len(by), np.int64)
        offset[by] = ends - length[by] - np.where(first > 0, ends[first - 1], 0)
        out_table = table.drop_columns(["_block", "_key"])
        return out_table.append_column("sequence_id", pa.array((np.int64(block) << 32) + place)).append_column("offset", pa.array(offset))

    key = pieces.columns[0]
    keyed = pieces.withColumn("_key", F.xxhash64(key, "piece")).withColumn("_block", salted(n_blocks, F.col(key), F.col("piece"), F.col("ids_crc32")))
    return keyed.groupBy("_block").applyInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, cap: int = CAP, keep_ids: bool = True, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Tokenise whole documents and pack their pieces; see :func:`tokenize_pieces` and :func:`pack_pieces`.

    Tokenised once: the pieces are written to the shared folder and packed from there. Null and empty texts are
    one end id each; an empty table gives no rows.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, cap, keep_ids=keep_ids, id_col=id_col, text=text), "pieces")
    return pack_pieces(pieces, cap, **options)
