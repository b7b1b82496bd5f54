"""Toxicity: a conditional random field tags toxic words; marginals give documents' scores and offending offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from . import crf
from .common import fed
from .labelled import chunks, fitted, picked
from .words import PUNCT, Words, batches

_BLOCK = 32
#: Bytes of the prefixes that stand for a word's stem, beside the word itself.
_STEMS = (4, 5, 6, 7)


def _hashes(w: Words) -> list[np.ndarray]:
    """Word and stems, in hash spaces of their own."""
    return [w.hash, *(h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for k, h in zip(_STEMS, w.prefixes(_STEMS), strict=True))]


@dataclass
class ToxicityModel:
    keys: np.ndarray  # sorted hashes of known words and stems
    own: np.ndarray  # weight of a word or stem for the word that has it
    before: np.ndarray  # weight of a word for the next one
    after: np.ndarray  # and for the one before
    bias: float
    trans: np.ndarray
    link: np.ndarray

    def __post_init__(self):
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places among ``keys``, their number where unknown."""
        out = np.full(len(h), len(self.keys), np.int32)
        some = np.flatnonzero(self.known[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.keys, h[some])
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == h[some][hit]
        out[some[hit]] = at[hit]
        return out

    def unary(self, w: Words) -> np.ndarray:
        found = [self.find(h) for h in _hashes(w)]
        pad = lambda x: np.append(x, 0.0)
        return self.bias + sum(pad(self.own)[f] for f in found) + pad(self.before)[_shift(found[0], w, 1, len(self.keys))] + pad(self.after)[_shift(found[0], w, -1, len(self.keys))]

    def words(self, w: Words) -> np.ndarray:
        return crf.marginals(self.unary(w), self.trans, w.first, _BLOCK)[0]

    def documents(self, w: Words, p: np.ndarray) -> np.ndarray:
        return crf.logistic(_summary(w, p), self.link)


def _shift(found: np.ndarray, w: Words, by: int, none: int) -> np.ndarray:
    """The neighbour's place: of the word before (1) or after (-1) in the same text."""
    out = np.full(len(found), none, np.int32)
    doc = w.doc()
    if by == 1:
        out[1:] = np.where(doc[1:] == doc[:-1], found[:-1], none)
    else:
        out[:-1] = np.where(doc[1:] == doc[:-1], found[1:], none)
    return out


def _summary(w: Words, p: np.ndarray) -> np.ndarray:
    """Of the expected number s of toxic words: its logarithm, the chance of two or more (as Poisson has it), and the logarithm of its share of the words."""
    s = np.bincount(w.doc(), p, w.n_docs)
    return np.stack([np.log(s + 1e-3), 1 - np.exp(-s) * (1 + s), np.log((s + 1e-3) / (np.diff(w.first) + 10))], axis=1)


@dataclass
class _Sample:
    """Words of the training texts as numbers of distinct words, whose hashes are kept once."""

    hashes: np.ndarray  # word and stems x distinct words
    word: np.ndarray  # distinct word of each place
    first: np.ndarray  # places first[d]:first[d+1] are text d's

    @classmethod
    def of(cls, texts: pa.Array) -> _Sample:
        tables, codes, counts, base = [], [], [], 0
        for part in chunks(texts):
            w = Words(part, PUNCT, lower=True)
            _, at, code = np.unique(w.hash, return_index=True, return_inverse=True)
            tables.append(np.stack([h[at] for h in _hashes(w)]))
            codes.append(code.astype(np.int32) + np.int32(base))
            counts.append(np.diff(w.first))
            base += len(at)
        if not tables:
            return cls(np.zeros((1 + len(_STEMS), 0), np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64))
        all_, word = np.concatenate(tables, axis=1), np.concatenate(codes)
        _, at, code = np.unique(all_[0], return_index=True, return_inverse=True)
        return cls(all_[:, at], code.astype(np.int32)[word], np.concatenate([[0], np.cumsum(np.concatenate(counts))]))

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))

    def only(self, keep: np.ndarray) -> _Sample:
        """The texts of the mask ``keep``."""
        count = np.diff(self.first)
        return _Sample(self.hashes, self.word[np.repeat(keep, count)], np.concatenate([[0], np.cumsum(count[keep])]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", id_col: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on the bounded sample of :mod:`labelled`, in one task.

    Labels are of documents; the words' labels follow from them: a word of a toxic document is toxic if it, or one of its
    stems, stands in toxic documents only (at least 30 times likelier there, after smoothing) and in enough of
    them (2, and 15 in a thousand). Toxic documents without such a word teach the link only. Without labels of both kinds nothing is toxic.
    """
    return fitted(*picked(docs, labels, label, use, id_col, text), fit_texts)


def fit_texts(texts: pa.Array, y: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """The model of :func:`fit_toxicity` from its sample: texts, 0/1 labels, weights."""
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0), -10.0, np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, -4.0]))
    if not len(y) or y.min() == y.max():
        return none
    s = _Sample.of(texts)
    doc = s.docs()
    n1, n0 = y.sum(), len(y) - y.sum()
    enough = max(2.0, 0.015 * n1)
    toxic_word, known = np.zeros(s.hashes.shape[1], bool), []
    for h in s.hashes:
        keys, code = np.unique(h, return_inverse=True)
        pair = np.unique(code.astype(np.int64)[s.word] * len(y) + doc)  # a document counts once for a word
        key, label_ = pair // len(y), y[pair % len(y)]
        c1, c0 = np.bincount(key, label_, len(keys)), np.bincount(key, 1 - label_, len(keys))
        odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
        toxic_word |= ((odds >= np.log(30)) & (c1 >= enough))[code]
        known.append(keys[(c1 >= enough) | (c1 + c0 >= max(5, 0.02 * len(y)))])
    label_of = toxic_word[s.word] & (y[doc] > 0)
    if not label_of.any():
        return none
    vocabulary = np.unique(np.concatenate(known))
    model = ToxicityModel(vocabulary, np.zeros(len(vocabulary)), np.zeros(len(vocabulary)), np.zeros(len(vocabulary)), 0.0, np.zeros((2, 2)), np.zeros(4))
    teach = (np.bincount(doc, label_of, len(y)) > 0) | (y == 0)
    label_of = label_of[teach[doc]].astype(np.float32)
    t = s.only(teach)
    found = [model.find(h) for h in s.hashes]  # of distinct words
    inner = np.ones(len(t.word), bool)
    inner[t.first[:-1][np.diff(t.first) > 0]] = False
    later = np.flatnonzero(inner)  # places with a word before
    size, n_words = len(vocabulary) + 1, s.hashes.shape[1]
    params = {"own": np.zeros(size), "before": np.zeros(size), "after": np.zeros(size), "bias": np.array([-3.0]), "trans": np.zeros((2, 2))}

    def unary(q: dict) -> np.ndarray:
        out = (q["bias"] + sum(q["own"][f] for f in found))[t.word]
        out[later] += q["before"][found[0]][t.word[later - 1]]
        out[later - 1] += q["after"][found[0]][t.word[later]]
        return out

    def pull(g: np.ndarray) -> dict:
        own = np.bincount(t.word, g, n_words)
        before, after = np.bincount(t.word[later - 1], g[later], n_words), np.bincount(t.word[later], g[later - 1], n_words)
        out = {"own": sum(np.bincount(f, own, size) for f in found), "before": np.bincount(found[0], before, size), "after": np.bincount(found[0], after, size), "bias": np.array([g.sum()])}
        for k in ("own", "before", "after"):
            out[k][-1] = 0  # unknown words weigh nothing
        return out

    crf.train(unary, pull, params, label_of, t.first, steps=40, rate=0.3, l2=0.05, block=_BLOCK)
    model = ToxicityModel(vocabulary, params["own"][:-1], params["before"][:-1], params["after"][:-1], float(params["bias"][0]), params["trans"], np.zeros(2))
    del found, t, later, inner, s, doc
    summary = []
    for part in chunks(texts):
        w = Words(part, PUNCT, lower=True)
        summary.append(_summary(w, model.words(w)))
    model.link = crf.calibrate(np.concatenate(summary), y, weight)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1, and ``spans``: character offsets ``start, end`` (exclusive) of runs of words tagged toxic.

    Every whole text is scored; null and empty texts have no words, the lowest score and no spans. Nothing but the
    text is read. Columns named ``score`` or ``spans`` are replaced.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "spans")])
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    out = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, text):
            w = Words(batch.column(text), PUNCT, lower=True)
            p = model.words(w)
            doc = w.doc()
            bad = np.flatnonzero(p >= 0.5)
            opens = np.ones(len(bad), bool)
            opens[1:] = (bad[1:] != bad[:-1] + 1) | (doc[bad[1:]] != doc[bad[:-1]])
            one = np.flatnonzero(opens)
            lo, hi = w.start[bad[one]], w.end[bad[np.append(one[1:] - 1, len(bad) - 1)]] if len(bad) else w.end[bad]
            chars = np.concatenate([[0], np.cumsum((w.bytes & 0xC0) != 0x80)])
            where = doc[bad[one]]
            base = chars[w.at[where]]
            pairs = pa.StructArray.from_arrays([pa.array((chars[lo] - base).astype(np.int32)), pa.array((chars[hi] - base).astype(np.int32))], names=["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(batch.num_rows + 1)).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.documents(w, p)), lists], names=out.names)

    return fed(kept).mapInArrow(run, out)
