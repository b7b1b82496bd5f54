"""Quality classifier: a conditional random field over the lines of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from . import crf
from .common import fed
from .labelled import chunks, sample
from .words import Rolling, Words, batches, mix

_BLOCK = 8


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL = _table("#$%&*|<>{}[]\\^~_=+@/`")
_STOP = _table(".,;:!?")
_DIGIT = _table("0123456789")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and ``first``: lines ``first[d]:first[d+1]`` are text d's. Each text has a line."""
    w = Words(texts)
    b = w.bytes
    n = len(b)
    at = np.flatnonzero(b == 10)
    doc_of_break = np.searchsorted(w.at, at, "right") - 1
    count = np.bincount(doc_of_break, minlength=w.n_docs) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    # lines begin at each text's start and after each break; both in the order of texts
    doc = np.repeat(np.arange(w.n_docs), count)
    nth = np.arange(first[-1]) - first[:-1][doc]
    begin = np.empty(first[-1], np.int64)
    begin[nth == 0] = w.at[:-1]
    begin[nth > 0] = at + 1
    end = np.empty(first[-1], np.int64)
    last = np.append(nth[1:] == 0, True) if len(nth) else np.zeros(0, bool)
    end[last] = w.at[1:]
    end[~last] = at
    size = end - begin

    def in_bytes(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[end] - c[begin]

    lo, hi = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    words = hi - lo

    def in_words(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[hi] - c[lo]

    line = np.repeat(np.arange(len(size)), words)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((w.hash, line))
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[order][1:] == w.hash[order][:-1]) & (line[order][1:] == line[order][:-1])
    repeats = np.bincount(line[order][again], minlength=len(size))
    length = w.end - w.start
    lone = _SYMBOL[b[w.start]] & (length == 1) if n else np.zeros(0, bool)
    tail = b[w.end - 1] if n else np.zeros(0, np.uint8)
    whole = mix(Rolling(b.astype(np.uint64) + np.uint64(1)).of(begin, end) + size.astype(np.uint64))
    by = np.lexsort((whole, doc))
    copy = np.zeros(len(size), bool)
    if len(by) > 1:
        copy[by[1:]] = (whole[by][1:] == whole[by][:-1]) & (doc[by][1:] == doc[by][:-1]) & (size[by][1:] > 0)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    x = np.stack([
        np.log1p(size), np.log1p(words), in_bytes(_SYMBOL[b]) / per_byte, in_bytes(_DIGIT[b]) / per_byte, in_bytes(_UPPER[b]) / per_byte, in_bytes(_STOP[b]) / per_byte,
        in_words(same) / per_word, repeats / per_word, in_words(lone) / per_word, in_words(_STOP[tail]) / per_word, in_words(_SYMBOL[tail] & (length > 1)) / per_word,
        in_words(length <= 3) / per_word, np.minimum(in_words(length) / per_word, 40), copy.astype(float), (words == 0).astype(float),
    ], axis=1)
    return x, size, first


def _with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of the line before, the line and the line after; at the ends of a text, zeros and a mark."""
    n = len(x)
    start, stop = np.zeros(n, bool), np.zeros(n, bool)
    start[first[:-1]] = True
    stop[first[1:] - 1] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1]
    after[:-1] = x[1:]
    before[start], after[stop] = 0, 0
    return np.column_stack([before, x, after, start, stop, np.ones(n)])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    link: np.ndarray
    prior: float

    def lines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, lines' lengths and ``first``."""
        x, size, first = line_features(texts)
        z = _with_neighbours((x - self.mean) / self.scale, first)
        p, _ = crf.marginals(z @ self.weights, self.trans, first, _BLOCK)
        return p, size, first

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, through a logistic link to the documents' labels; without characters, the prior."""
        p, size, first = self.lines(texts)
        return self.score(*_mean(p, size, first))

    def score(self, mean: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(total > 0, crf.logistic(_logit(mean)[:, None], self.link), self.prior)


def _mean(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.bincount(doc, size, len(first) - 1)
    return np.divide(np.bincount(doc, p * size, len(first) - 1), total, out=np.zeros(len(total)), where=total > 0), total


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", id_col: str = "doc_id", text: str = "text") -> QualityModel:
    """Fit on the bounded sample of :mod:`labelled`: every line is labelled as its document. Without labels of both kinds every score is the prior."""
    texts, y, weight = sample(docs, labels, label, use, id_col, text)
    prior = float(((y * weight).sum() + 1) / (weight.sum() + 2))
    if not len(y) or y.min() == y.max():
        k = line_features(pa.array([""]))[0].shape[1]
        return QualityModel(np.zeros(k), np.ones(k), np.zeros(3 * k + 3), np.zeros((2, 2)), np.array([0.0, np.log(prior / (1 - prior))]), prior)
    parts = [line_features(t) for t in chunks(texts)]
    del texts
    x, size = np.concatenate([x for x, _, _ in parts]), np.concatenate([s for _, s, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, _, f in parts]))])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _with_neighbours((x - mean) / scale, first)
    lines_y = np.repeat(y, np.diff(first))
    params = {"w": np.zeros(z.shape[1]), "trans": np.zeros((2, 2))}
    crf.train(lambda q: z @ q["w"], lambda g: {"w": z.T @ g}, params, lines_y, first, steps=150, rate=0.05, l2=1.0, block=_BLOCK)
    model = QualityModel(mean, scale, params["w"], params["trans"], np.zeros(2), prior)
    p, _ = crf.marginals(z @ params["w"], params["trans"], first, _BLOCK)
    s, total = _mean(p, size, first)
    model.link = crf.calibrate(_logit(s)[total > 0][:, None], y[total > 0], weight[total > 0])
    return model


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1, and ``bad_lines``, the numbers of lines that are more likely bad.

    Every whole text is scored; a null text counts as empty, and texts without characters get the
    prior. Nothing but the text is read. Columns named ``score`` or ``bad_lines`` are replaced.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "bad_lines")])
    out = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("bad_lines", T.ArrayType(T.IntegerType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, text):
            p, size, first = model.lines(batch.column(text))
            score = model.score(*_mean(p, size, first))
            bad = np.flatnonzero((p < 0.5) & (size > 0))
            ends = np.searchsorted(bad, first).astype(np.int32)
            nth = bad - first[np.searchsorted(first, bad, "right") - 1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(nth.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), lists], names=out.names)

    return fed(kept).mapInArrow(run, out)
