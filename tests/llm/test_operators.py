"""Edge cases and brute force for the training-data operators."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import crf, licenses, quality, toxicity
from tidewheel.llm.common import connected_components
from tidewheel.llm.labelled import remainder, sample
from tidewheel.llm.lines import drop_boilerplate
from tidewheel.llm.minhash import Settings, block_links, drop_near_duplicates, idf_weights, near_duplicates, pair_similarity, star_links
from tidewheel.llm.mixing import apply_mix, mix_sources
from tidewheel.llm.packing import best_fit, pack_documents, pack_pieces, tokenize_pieces
from tidewheel.llm.quality import fit_quality, score_quality
from tidewheel.llm.queries import tokenizer_path
from tidewheel.llm.substring import drop_repeats
from tidewheel.llm.topk import ImpactIndex, top_k
from tidewheel.llm.toxicity import fit_toxicity, score_toxicity
from tidewheel.llm.vectors import MultiIndex, vector_components
from tidewheel.llm.words import PUNCT, Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, key int, n_words int, copies int, node int, n_lines string"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def odd_docs(spark, more=()):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows, and columns that clash."""
    long = " ".join(words(60_000, 1))
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", "s"), (4, " \t\n ", None), (5, long, "t"), (6, "a b c", "t"), (6, "a b c", "t"), (None, "a b c d e f", None), (None, None, None), *more]
    return spark.createDataFrame([(i, x, None, s, None, "clash", 1, 2, 3, 4, 5, "x") for i, x, s in rows], DOCS)


def near(a, n_edits, seed):
    r, a = random.Random(seed), list(a)
    for _ in range(n_edits):
        a[r.randrange(len(a))] = f"e{r.randrange(10**9)}"
    return a


# 1
def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(8) * rng.choice([0.01, 1])).astype(float).tolist(), "x") for i in range(300)]
    rows += [(300, None, "x"), (301, [None] * 8, "x"), (302, [math.inf] * 8, "x"), (303, [math.nan] * 8, "x"), (304, [0.0] * 8, "x"), (306, [1e300] * 8, "x"), (305, rows[7][1], "x"), (None, rows[3][1], "x")]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = sorted(map(tuple, top_k(e, e.where("vec_id % 20 = 0"), 20).collect()))
    v = {i: np.floor(64 * np.array(x)).astype(int) for i, x, _ in rows if i is not None and i not in (300, 301, 302, 303, 306)}
    want = []
    for q in sorted(v):
        if q % 20 == 0:
            best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want
    assert top_k(e.where("false"), e, 3).count() == 0
    assert top_k(e.where("vec_id < 3"), e.where("vec_id = 0"), 20).count() == 2


def test_top_k_of_large_and_unequal_vectors(spark):
    """Components up to 64 bits are scored as whole numbers; pairs that leave 64 bits have no row; other lengths are other spaces."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.choice([1.0, 5e6, -1e9, 1e15, 3e8], 6).tolist()) for i in range(60)] + [(i, rng.standard_normal(6).tolist()) for i in range(60, 130)] + [(i, [1.0, float(i)]) for i in range(130, 150)]
    rows += [(200, [1.0] * 64), (201, [5e6] + [0.0] * 63), (202, [2.0**56] + [0.0] * 63), (203, [2.0**57] * 64)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(e, e.where("vec_id % 20 = 0"), 20).collect()))
    v = {i: [math.floor(64 * x) for x in v] for i, v in rows if max(map(abs, v)) < 2.0**57}
    want = []
    for q in v:
        if q % 20 == 0:
            scores = {c: sum(a * b for a, b in zip(v[q], x, strict=True)) for c, x in v.items() if c != q and len(x) == len(v[q])}
            best = sorted((-s, c) for c, s in scores.items() if -(2**63) <= s < 2**63)[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want) and (200, 1, 201, 64 * 64 * 5_000_000) in got and not any(c == 202 for _, _, c, _ in got)


def test_impact_index_touches_fewer_postings_and_bounds_hold():
    rng = np.random.default_rng(11)
    v = np.floor(64 * (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((6000, 64)) * rng.choice([0.2, 1, 3], 64))).astype(np.int64)
    v[100:140] = v[:40]  # ties
    index, ids = ImpactIndex(v), rng.permutation(6000)
    got = index.search(v[:60], 20, ids[:60], ids)
    for i, (rows, scores) in enumerate(got):
        s = (v @ v[i]).astype(float)
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        assert rows.tolist() == best.tolist() and scores.tolist() == s[best].tolist()
    assert index.touched < 0.9 * index.size * 60


def test_impact_index_with_huge_and_zero_components():
    v = np.array([[2**28, -(2**28), 0], [2**28, 2**28 - 1, 1], [0, 0, 0], [1, 2, 3]], np.int64)
    rows, scores = ImpactIndex(v).search(v[:1], 3, np.array([0]), np.arange(4))[0]
    assert rows.tolist() == [1, 2, 3] and scores.tolist() == [2**28, 0, -(2**28)]


def test_impact_index_stops_on_proof():
    rng = np.random.default_rng(1)
    v = rng.integers(-30, 30, (500, 16))
    q = v[:5]
    for i, (rows, scores) in enumerate(ImpactIndex(v).search(q, 7, np.arange(5), np.arange(500))):
        s = v @ q[i]
        s[i] = -(10**9)
        best = np.lexsort((np.arange(500), -s))[:7]
        assert rows.tolist() == best.tolist() and scores.tolist() == s[best].tolist()


# 2
def test_packing_is_whole_and_gapless(spark):
    docs = odd_docs(spark, [(100 + i, " ".join(words(30 + 37 * i % 900, i)), "s") for i in range(60)])
    rows = pack_documents(docs, tokenizer_path(), cap=512, keep_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter((r["doc_id"], tuple([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    by = collections.defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 512 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    tokens = sum(len(k[1]) * n for k, n in want.items())
    assert sum(r["length"] for r in rows) == tokens
    assert len(by) <= math.ceil(tokens / 512) + 2
    unique = {k[0] for k in want if list(want).count(k) == 1 and k[0] not in (None, 6)}
    for d in unique:
        mine = sorted((r["piece"], r["start"], r["ids"]) for r in rows if r["doc_id"] == d)
        assert tuple(sum((x[2] for x in mine), [])) in {k[1] for k in want if k[0] == d}
        assert all(len(x[2]) == 512 for x in mine[1:])
    assert pack_documents(docs.where("false"), tokenizer_path()).count() == 0


def test_packing_obeys_every_capacity(spark):
    pieces = tokenize_pieces(odd_docs(spark, [(i, " ".join(words(5 + i % 40, i)), "s") for i in range(50, 150)]).where("doc_id <> 5"), tokenizer_path(), cap=512, keep_ids=False)
    for rule in ("norm", "dot"):
        rows = pack_pieces(pieces, 512, max_docs=3, attention_cap=512.0**2 / 4 + 512**2 / 2, weights=(1, 0.5, 0.5), rule=rule).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append(r["length"])
        assert all(len(x) <= 3 and sum(x) <= 512 and sum(v * v for v in x) <= 512.0**2 * 0.75 for x in by.values())
    place, _ = best_fit(np.array([[6.0], [5], [4], [3], [2]]), np.array([10.0]), np.array([1.0]))
    assert len(set(place.tolist())) == 2


def test_fast_ids_are_the_tokenizers_ids():
    from tokenizers import Tokenizer

    from tidewheel.llm.packing import Encoder

    e, plain, r = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), random.Random(5)
    texts = ["", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "漢字 text’s", "a\u0085b c  d\n\n e"] + ["".join(chr(r.choice([r.randrange(0x250), r.randrange(32, 127), 32, 10, 0x2019])) for _ in range(80)) for _ in range(500)]
    texts += [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert e.fast is not None
    assert e(texts) == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert 50256 in e(["a <|endoftext|> b"])[0]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_matches_brute_force(rule):
    """Every item, all bins looked at: the rule's best bin of those with room in every dimension."""
    rng = np.random.default_rng(8)
    for caps, weights in (((100, 100, 10_000), (1, 0.1, 0.1)), ((100, 4, 4_000), (1, 0.5, 2.0)), ((100, 3, 10_000), (0.2, 1, 0))):
        length = np.minimum(rng.integers(1, 64, 90), math.isqrt(caps[2]))
        sizes = np.stack([length, np.ones(90), length**2], axis=1).astype(float)
        caps, w = np.array(caps, float), np.array(weights, float)
        place, order = best_fit(sizes, caps, w, rule)
        need, bins, want = sizes / caps, [], {}
        assert order.tolist() == sorted(range(90), key=lambda i: (-float(need[i] @ w), i))
        for i in order:
            able = [k for k, left in enumerate(bins) if (left >= need[i] - 1e-12).all()]
            value = lambda k: float((w * need[i]) @ bins[k]) if rule == "dot" else -float(w @ (bins[k] - need[i]) ** 2)  # noqa: B023, E731
            if not able:
                bins.append(np.ones(3))
                able = [len(bins) - 1]
            top = max(map(value, able))
            assert place[i] in able and value(place[i]) >= top - 1e-12
            bins[place[i]] = bins[place[i]] - need[i]
            want[int(i)] = int(place[i])
        for k in set(place.tolist()):
            assert (sizes[place == k].sum(axis=0) <= caps + 1e-9).all()


# 3
def test_vector_components_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, v.tolist(), int(i % 3)))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], None), (403, [0.0] * 16, 0), (404, None, 0), (405, [math.nan] * 16, 0), (406, [None] * 16, 1), (407, [1e200] * 16, 1), (408, [2e200] * 16, 1)]
    e = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_components(e).collect()}
    ok = [r for r in rows if r[2] is not None and r[0] not in (403, 404, 405, 406)]
    x = np.array([r[1] for r in ok])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None, :])
    np.fill_diagonal(link, False)
    ids = np.array([r[0] for r in ok])
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 10**9).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    want = {r[0]: (0, r[0], True) for r in rows} | {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), comp, strict=True)}
    assert got == want
    assert vector_components(e.where("false")).count() == 0


def test_multi_sequence_walk_is_in_order_and_whole():
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    u = unit(rng.standard_normal((600, 16)))
    index = MultiIndex(u, 12, 0.98, 0.999)
    a, b = index.halves(u[:200])
    for i, got in enumerate(index.probes(u[:200])):
        d = (a[i][:, None] + b[i][None, :]).reshape(-1)
        assert (np.diff(d[got]) >= -1e-12).all() and len(set(got.tolist())) == len(got)
        assert set(got.tolist()) == set(np.flatnonzero(d <= d.min() + index.radius).tolist())


def test_vector_index_finds_planted_links(spark, tmp_path):
    """Thousands of pairs just above the threshold over a grid of many cells: recall against brute force, and the oracle's SQL on a planted table."""
    rng = np.random.default_rng(13)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((3000, 32)))
    g = rng.standard_normal(base.shape)
    g = unit(g - (g * base).sum(axis=1, keepdims=True) * base)
    both = np.concatenate([base, 0.9805 * base + math.sqrt(1 - 0.9805**2) * g])
    e = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    want = (both @ both.T >= 0.98).sum() - len(both)
    found = sum(r["n_links"] for r in vector_components(e).collect())
    assert want >= 6000 and 0.98 * want <= found <= want  # k is 19 here
    import duckdb

    from tidewheel.llm.queries import OP3

    planted = [(i, (v if i % 3 else both[i // 2] * 2).tolist(), i % 2 if i % 7 else None) for i, v in enumerate(both[:300])] + [(3000 + i, (0.99 * base[i] + math.sqrt(1 - 0.99**2) * g[i]).tolist(), i % 2) for i in range(300)]
    small = spark.createDataFrame(planted, "vec_id long, embedding array<double>, label int")
    small.write.parquet(str(tmp_path / "e"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    names = ["vec_id", "n_links", "component_id", "kept"]
    rows = sorted(db.sql(f"SELECT {', '.join(names)} FROM ({OP3})").fetchall())
    assert rows == sorted(map(tuple, vector_components(small).select(*names).collect()))
    assert sum(r[1] for r in rows) > 200


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(30)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4, 5
def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    first = np.array([0, 3, 3, 4, 13, 15])
    u, t = rng.standard_normal(15) * 3, rng.standard_normal((2, 2))
    p, joint = crf.marginals(u, t, first, 4)
    want, pairs = np.zeros(15), np.zeros((2, 2))
    for a, b in zip(first, first[1:], strict=False):
        n, total, one, two = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2**n if n else 0):
            s = [(code >> i) & 1 for i in range(n)]
            w = math.exp(sum(u[a + i] for i in range(n) if s[i]) + sum(t[x, y] for x, y in zip(s, s[1:], strict=False)))
            total += w
            one += w * np.array(s)
            for x, y in zip(s, s[1:], strict=False):
                two[x, y] += w
        if n:
            want[a:b] = one / total
            pairs += two / total
    assert np.allclose(p, want) and np.allclose(joint, pairs)


def labelled(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(" ".join(words(12, r.random())) + "." for _ in range(4))
        good, toxic = i % 4 != 0, i % 5 == 0
        if not good:
            text = text.split("\n")[0] + "\n" + "\n".join(" | ".join(words(9, r.random())) + " |" for _ in range(4))
        if toxic:
            text = text.replace("w1", "vilest w1", 3) + " vilest dregs"
        rows.append((i, text, "s"))
        labels.append((i, int(good), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_documents_and_odd_ones(spark):
    rows, labels = labelled(spark)
    docs = odd_docs(spark, [(i + 1000, x, s) for i, x, s in rows])
    labels = labels.withColumn("doc_id", F.col("doc_id") + 1000)
    use = remainder("doc_id", 3) != 1
    y = {r["doc_id"]: r for r in labels.collect()}
    for fit, score, name in ((fit_quality, score_quality, "quality"), (fit_toxicity, score_toxicity, "toxic")):
        out = score(docs, fit(docs, labels, use)).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
        held = [r for r in out if r["doc_id"] in y and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
        assert len(held) > 40 and sum((r["score"] >= 0.5) == bool(y[r["doc_id"]][name]) for r in held) >= 0.97 * len(held)
        flat = score(docs, fit(docs.where("false"), labels, use)).collect()  # nothing to learn from
        assert len({r["score"] for r in flat}) == 1
        assert score(docs.where("false"), fit(docs, labels.where("false"), use)).count() == 0
    tagged = score_toxicity(docs, fit_toxicity(docs, labels, use)).where("doc_id = 1000").first()
    assert {tagged["text"][a:b] for a, b in tagged["spans"]} <= {"vilest", "vilest dregs", "dregs"} and tagged["spans"]


def enumerated(unary, trans):
    """P(state 1) of every place of one chain, over all labellings."""
    n, total, one = len(unary), 0.0, np.zeros(len(unary))
    for code in range(2**n):
        s = [(code >> i) & 1 for i in range(n)]
        w = math.exp(sum(u for u, x in zip(unary, s, strict=True) if x) + sum(trans[x, y] for x, y in zip(s, s[1:], strict=False)))
        total += w
        one += w * np.array(s)
    return one / total


def test_scores_and_spans_match_enumeration(spark):
    """Document scores, bad lines and spans of the fitted fields, recomputed from all labellings of short texts."""
    rows, labels = labelled(spark)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    short = [(i, "\n".join(x.split("\n")[:3])) for i, x, _ in rows[:12]] + [(100, ""), (101, None), (102, "one\n\ntwo | |")]
    frame = spark.createDataFrame(short, "doc_id long, text string")
    q = fit_quality(docs, labels, F.lit(True))
    got = {r["doc_id"]: r for r in score_quality(frame, q).collect()}
    for i, text in short:
        x, size, first = quality.line_features(pa.array([text or ""]))
        p = enumerated(quality._with_neighbours((x - q.mean) / q.scale, first) @ q.weights, q.trans)
        want = q.prior
        if size.sum():
            m = min(max(float(p @ size) / size.sum(), 1e-4), 1 - 1e-4)
            want = sigmoid(math.log(m / (1 - m)) * q.link[0] + q.link[1])
        assert math.isclose(got[i]["score"], want, rel_tol=1e-6) and got[i]["bad_lines"] == [k for k in range(len(p)) if p[k] < 0.5 and size[k]]
    t = fit_toxicity(docs, labels, F.lit(True))
    tiny = [(i, " ".join(x.split()[:4] + x.split()[-4:])) for i, x, _ in rows[:12]] + [(100, ""), (101, None), (102, "vilest, dregs vilest é dregs")]
    got = {r["doc_id"]: r for r in score_toxicity(spark.createDataFrame(tiny, "doc_id long, text string"), t).collect()}
    for i, text in tiny:
        w = Words(pa.array([text or ""]), PUNCT, lower=True)
        p = enumerated(t.unary(w), t.trans) if len(w.start) else np.zeros(0)
        e = p.sum()
        z = [math.log(e + 1e-3), 1 - math.exp(-e) * (1 + e), math.log((e + 1e-3) / (len(p) + 10)), 1]
        assert math.isclose(got[i]["score"], sigmoid(float(np.dot(z, t.link))), rel_tol=1e-6)
        raw, spans = (text or "").encode(), []
        for k in np.flatnonzero(p >= 0.5).tolist():
            a, b = (len(raw[: int(x[k])].decode()) for x in (w.start, w.end))
            if spans and k - 1 == last:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
            last = k
        assert [tuple(x) for x in got[i]["spans"]] == spans
    assert any(r["spans"] for r in got.values())


def test_texts_beyond_a_segment_and_repeated_labels(spark, monkeypatch):
    """A text of many segments gives what smaller segments give; an id with both labels counts with each."""
    from tidewheel.llm import words as module

    text = " ".join(words(3000, 3)) + "\n" + "x" * 5000
    whole = Words(pa.array([text, None, "", text]))
    monkeypatch.setattr(module, "SEGMENT", 999)
    cut = Words(pa.array([text, None, "", text]))
    assert (whole.hash == cut.hash).all() and (whole.start == cut.start).all() and (whole.end == cut.end).all()
    monkeypatch.setattr(crf, "PLACES", 50)
    rng = np.random.default_rng(5)
    u, trans, first = rng.standard_normal(400) * 3, rng.standard_normal((2, 2)), np.array([0, 10, 390, 400])
    some = crf.marginals(u, trans, first, 8)[0]
    monkeypatch.setattr(crf, "PLACES", 1 << 17)
    assert np.allclose(some, crf.marginals(u, trans, first, 8)[0])
    rows, labels = labelled(spark)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    twice = labels.union(labels.where("doc_id < 20").selectExpr("doc_id", "1 - quality", "1 - toxic")).union(labels)
    for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        assert all(0 <= r["score"] <= 1 for r in score(docs, fit(docs, twice, F.lit(True))).collect())


# 6
def test_drop_repeats_matches_brute_force(spark):
    r = random.Random(7)
    shared = words(90, 70)
    texts = [words(20 + i * 3, i) for i in range(20)]
    texts += [words(40, 100 + i) + shared[i % 5 : 60 + i] + words(30, 200 + i) for i in range(12)]
    texts += [texts[3] * 2, ["x"] * 300, near(shared, 3, 1), shared[:35], shared[:34], shared[10:45] + ["z"]]
    docs = odd_docs(spark, [(100 + i, r.choice([" ", "\n"]).join(t), "s") for i, t in enumerate(texts)])
    got = sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["text"], tuple(map(tuple, x["removed"]))) for x in drop_repeats(docs, 35).collect())
    split = [(x["doc_id"], WORD.findall(x["text"] or "")) for x in docs.collect()]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        spans, at = [], None
        for k, g in enumerate([*gone, False]):
            if g and at is None:
                at = k
            if not g and at is not None:
                spans.append((at, k))
                at = None
        want.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), tuple(spans)))
    assert got == sorted(want)
    assert drop_repeats(docs.where("false")).count() == 0
    assert {"score", "lang", "key"} <= set(drop_repeats(docs).columns)
    assert hashlib.sha256(b"").hexdigest() == drop_repeats(docs.where("doc_id = 2")).select(F.sha2("text", 256)).first()[0]


# 7
def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in open_})
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    rows = [(1000 + 100 * k + i, " ".join(["w"] * (1 + (i * 7 + k) % 40)), s) for k, s in enumerate(["b", "a", "ç", "Z", None, "tiny"]) for i in range(3 if s == "tiny" else 90)]
    docs = odd_docs(spark, rows).where("doc_id is null or doc_id <> 5")
    out = mix_sources(docs).collect()
    assert len(out) == docs.count()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want, taken = brute_targets(sizes), collections.Counter()
    for r in out:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t), (s, taken[s], t)
    tilt = {}
    for r in out:  # rates are the exponential tilt of one multiplier a source, and meet the target by themselves
        if r["size"] and 1e-9 < r["rate"] < 3 - 1e-9:
            t = math.log(r["rate"]) / r["size"]
            assert math.isclose(tilt.setdefault(r["source"], t), t, rel_tol=1e-6, abs_tol=1e-12)
    for s, t in want.items():
        assert math.isclose(sum(r["rate"] * r["size"] for r in out if r["source"] == s), t, rel_tol=1e-6)
    key = lambda rows: sorted(map(str, rows))
    assert key(out) == key(mix_sources(docs.repartition(7)).collect())
    assert mix_sources(docs.where("false")).count() == 0
    copies = apply_mix(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in out)


# 8
def test_near_duplicates_match_brute_force(spark):
    texts, families = [], 12
    for f in range(families):
        a = words(120, f)
        texts += [a, near(a, 1, f), near(a, 2, f + 50), near(a, 3, f + 90), a]
    hot = words(150, 999)
    texts += [near(hot, 2, i) for i in range(60)] + [words(80, 5000 + i) for i in range(30)] + [hot[:3], hot[:3]]
    docs = odd_docs(spark, [(100 + i, " ".join(t), "s") for i, t in enumerate(texts)]).where("doc_id is not null")
    got = {}
    for r in near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], (r["class_id"], r["kept"]))
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=lambda x: x[0])
    sets = {i: collections.Counter(zip(*[WORD.findall(t or "")[k:] for k in range(5)], strict=False)) or collections.Counter([tuple(WORD.findall(t or ""))]) for i, t in rows}
    df = collections.Counter(g for s in sets.values() for g in s)
    n = len(rows)
    weight = lambda g: 1 + 0.25 * math.log((1 + n) / (1 + df[g])) / math.log(1 + n)
    comp = {i: i for i, _ in rows}
    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            if WORD.search(a or "") and WORD.search(b or "") and (inter := sets[i].keys() & sets[j].keys()):
                low = sum(min(sets[i][g], sets[j][g]) * weight(g) for g in inter)
                s = low / (sum(k * weight(g) for g, k in sets[i].items()) + sum(k * weight(g) for g, k in sets[j].items()) - low)
                if s >= 0.8:
                    u, v = comp[i], comp[j]
                    comp = {k: min(u, v) if c in (u, v) else c for k, c in comp.items()}
    assert {i: c for i, (c, _) in got.items()} == comp
    assert all(k == (i == c) for i, (c, k) in got.items())
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(comp.values())
    assert near_duplicates(docs.where("false")).count() == 0
    odd = near_duplicates(odd_docs(spark)).collect()
    assert len(odd) == 9 and all(r["kept"] for r in odd if r["doc_id"] is None and r["class_id"] is None)


def test_pair_similarity():
    a, b = pa.array(["a b c d e f", "x", None]), pa.array(["a b c d e g", "x", "y"])
    flat = idf_weights(np.zeros(4, np.int64), 10, 0.0)
    assert np.allclose(pair_similarity(a, b, Settings(), flat), [1 / 3, 1, 0])


# 9
def test_license_scan(spark):
    notices = [t for _, t in licenses.TEMPLATES]
    rows = [(100 + i, " ".join(words(17 * i, i)) + " \n" + t.upper() + "\n " + " ".join(words(40, i + 50)), "s") for i, t in enumerate(notices)]
    cut = notices[3].split()
    rows += [(200, " ".join(cut[:-4]), "s"), (201, " ".join(cut[: len(cut) // 2]), "s"), (202, " ".join(words(500, 9)), "s")]
    docs = odd_docs(spark, rows)
    got = {(r["doc_id"], r["template_id"]): r for r in licenses.scan_licenses(docs).collect()}
    for i in range(len(notices)):
        r = got[(100 + i, i)]
        assert r["containment"] == 1.0 and r["word_end"] - r["word_start"] == len(re.findall(r"[^\W_]+", notices[i])) and r["word_start"] == 17 * i
    assert (200, 3) in got and (201, 3) not in got and not any(k[0] in (202, 1, 2, 3, None) for k in got)
    assert licenses.scan_licenses(docs.where("false")).count() == 0
    none = spark.createDataFrame([], "template_id int, license string, template string")
    assert licenses.scan_licenses(docs, none).count() == 0
    assert licenses.bands_for(10) >= math.log(1e-4) / math.log(1 - 0.8 / 2.2) - 1


def test_license_scan_of_a_very_long_text(spark, monkeypatch):
    """A notice at any place of a text of many slices, across their edges too, is found as in a short one."""
    notices = dict(enumerate(t for _, t in licenses.TEMPLATES))
    filler = words(1_000_000, 3)
    at = [(0, 3), (licenses.SLICE - 60, 3), (5 * licenses.SLICE - 5, 10), (9 * licenses.SLICE - 130, 12), (700_001, 13), (999_990, 9)]
    out, last = [], 0
    for place, i in at:
        out += filler[last:place] + notices[i].split()
        last = place
    out += filler[last:]
    text = " ".join(out)
    assert len(text) > 5_000_000
    got = {(r["template_id"], r["word_start"], r["containment"]) for r in licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    plain = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    for i in (3, 10, 12, 13, 9):
        own = re.sub(r"[^a-z0-9]+", " ", notices[i].lower()).split()
        first = next(k for k in range(len(plain)) if plain[k] == own[0] and plain[k : k + len(own)] == own)
        assert (i, first, 1.0) in got


def test_license_scan_matches_every_window(spark):
    """Templates of 1 to 8 shingles, whole or cut by a word, at any offset among other words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    templates = [(i, "x", [word() for _ in range(i % 8 + 5)]) for i in range(160)]
    docs = []
    for i, _, t in templates:
        part = t[: len(t) - (i % 5 == 0)]
        docs.append((i, [word() for _ in range(rng.randrange(40))] + part + [word() for _ in range(rng.randrange(40))]))
    grams = lambda w: [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    want = set()
    for d, w in docs:
        g = grams(w)
        for i, _, t in templates:
            ts, hits = set(grams(t)), []
            for k in range(0, len(g), len(ts)):
                at = [j for j in range(k, min(k + 2 * len(ts), len(g))) if g[j] in ts]
                c = len({g[j] for j in at}) / len(ts)
                if at and c >= licenses.CONTAINMENT:
                    hits.append((-c, at[0], -(at[-1] + 5)))
            if hits:
                c, a, b = min(hits)
                want.add((d, i, -c, a, -b))
    frame = spark.createDataFrame([(i, a, " ".join(t)) for i, a, t in templates], "template_id int, license string, template string")
    out = licenses.scan_licenses(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), frame)
    assert len(want) > 130
    assert {(r["doc_id"], r["template_id"], r["containment"], r["word_start"], r["word_end"]) for r in out.collect()} == want


# 10
def test_line_dedup(spark):
    rows = [(100 + i, f"menu\n own line {i} \n\n menu \nlast {i % 30}", "s") for i in range(60)] + [(300 + i, "menu\nx", "u") for i in range(2)]
    out = {r["doc_id"]: r for r in drop_boilerplate(odd_docs(spark, rows), ratio=0.5, min_pages=3).collect()}
    assert out[100]["text"] == " own line 0 \n\nlast 0" and (out[100]["n_lines"], out[100]["n_removed"]) == (5, 2)
    assert out[300]["text"] == "menu\nx" and out[2]["text"] is None and out[3]["text"] == "" and out[2]["n_lines"] == 0
    assert drop_boilerplate(odd_docs(spark, rows)).count() == 9 + 62
    assert drop_boilerplate(odd_docs(spark).where("false")).count() == 0
    salted = {r["doc_id"]: r for r in drop_boilerplate(odd_docs(spark, rows), ratio=0.5, min_pages=3, broadcast_lines=0).collect()}
    assert salted == out


def test_block_links_match_all_pairs():
    rng = random.Random(9)
    base = words(60, 1)
    texts = [" ".join(near(base, rng.randrange(0, 9), i) + base[:6] * rng.randrange(3)) for i in range(40)] + [" ".join(words(30, 500 + i)) for i in range(5)] + ["a b"]
    idf = idf_weights(np.random.default_rng(1).integers(0, 30, 1 << 10), 46, 1.0)
    s, n = Settings(), len(texts)
    left, part = np.arange(n) % 3 == 0, np.arange(n) // 2
    for right in (~left, left, np.ones(n, bool)):
        want = list(range(n))
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j and left[i] and right[j] and part[i] != part[j]]
        sim = pair_similarity(pa.array([texts[i] for i, _ in pairs]), pa.array([texts[j] for _, j in pairs]), s, idf)
        links = [p for p, v in zip(pairs, sim, strict=True) if v >= 0.8]
        for _ in range(n):
            for i, j in links:
                want[i] = want[j] = min(want[i], want[j])
        assert block_links(pa.array(texts), left, right, part, s, idf).tolist() == want and links
    hit = star_links(pa.array(texts), s, idf)
    sim = pair_similarity(pa.array(texts[:1] * n), pa.array(texts), s, idf)
    assert hit.tolist() == (sim >= 0.8).tolist()


def test_pipeline_end_to_end(spark, tmp_path):
    """On odd and planted documents, and on none: what each stage must do is seen in the packed ids."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, labels = labelled(spark)
    plain = [(1000 + i, " ".join(words(60, 900 + i)) + "\nmenu", "s") for i in range(60)]
    base = words(80, 77)
    copies = [(2000 + i, " ".join(near(base, i % 2, i)), f"u{i}") for i in range(6)]
    docs = odd_docs(spark, [*rows, *plain, *copies]).select(*corpus_pipeline.COLUMNS)
    for name, d in (("odd", docs), ("none", docs.where("false"))):
        (tmp_path / name).mkdir()
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    t, text = Tokenizer.from_file(tokenizer_path()), {}
    for r in sorted(out, key=lambda r: (str(r["doc_id"]), r["piece"])):
        assert r["length"] == len(r["ids"]) <= 2048
        text[r["doc_id"]] = (text.get(r["doc_id"], "") + t.decode(r["ids"], skip_special_tokens=False)) if r["piece"] else t.decode(r["ids"], skip_special_tokens=False)
    assert not any("vilest" in x for x in text.values()) and not any("menu" in x.split() for x in text.values())
    assert len({d for d in text if d in range(2000, 2006)}) <= 1
    assert 5 not in {r["doc_id"] for r in out if r["length"] > 2048}


@pytest.mark.parametrize("name", ["toxicity", "line dedup", "minhash near-dedup", "source mixing", "best-fit packing"])
def test_pipeline_stages_take_odd_documents(spark, name):
    import corpus_pipeline

    docs = odd_docs(spark, [(100 + i, " ".join(words(40, i)), "s") for i in range(10)])
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
    if name != "best-fit packing":
        assert out.columns == corpus_pipeline.COLUMNS
    assert out.count() >= 1
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The sample's texts and the fit take no memory of the driver; the model is that of a fit on the spot."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    use = F.coalesce(remainder("doc_id", 3) != 1, F.lit(True))
    here = toxicity.fit_texts(*sample(docs, labels, "toxic", use))

    def never(*_, **__):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(toxicity.crf, "train", never)
    there = toxicity.fit_toxicity(docs, labels, use)
    assert len(here.keys) and all(np.array_equal(getattr(here, k), getattr(there, k)) for k in ("keys", "own", "before", "after", "bias", "trans", "link", "known"))
    assert not len(toxicity.fit_toxicity(docs.limit(0), labels, use).keys)
