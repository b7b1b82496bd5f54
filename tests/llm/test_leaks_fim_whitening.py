"""Decontamination, fill-in-middle and whitening against brute force, exact round trips and a dense decomposition."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewheel.llm import decontaminate
from tidewheel.llm.decontaminate import Items, SuffixArray, drop_contaminated, find_leaks, longest_matches
from tidewheel.llm.fim import draws, fill_in_middle, restore, restore_text, rotate, transform
from tidewheel.llm.whitening import components, intervals, negative, whiten

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_hit string, items int, spans string, form int, longest int"


def tokens(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def some_words(n, r, size=9):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def leak_case(seed):
    """Documents over few words, so that windows repeat, and items of all lengths."""
    r = random.Random(seed)
    items = [(i, " ".join(some_words(r.choice([0, 1, 3, 9, 10, 11, 40]), r, 3 if i % 2 else 10**6))) for i in range(12)]
    items += [(None, " ".join(some_words(12, r, 10**6))), (3, items[5][1]), (50, None), (51, "...!"), (7, items[7][1])]
    docs = []
    for d in range(40):
        w = some_words(r.randrange(60), r, 3 if d % 2 else 10**6)
        for _ in range(r.randrange(3)):
            own = (r.choice(items)[1] or "").split()
            lo = r.randrange(len(own) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = own[lo : lo + r.randrange(25)]
        docs.append((d, r.choice([" ", "-", "\n\x00"]).join(x.upper() if r.random() < 0.2 else x for x in w)))
    docs += [(100, None), (101, ""), (102, " ..\t"), (None, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (103, "é" + (items[4][1] or "x") + "ß 日本"), (104, " ".join(some_words(60_000, r, 10**6)) + " " + items[-5][1])]
    return docs, items


def brute_leaks(text, items, window=10):
    w, hit, met, longest = tokens(text), set(), set(), 0
    for i, t in items:
        own = tokens(t)
        k = min(window, len(own))
        if not k:
            continue
        windows = {tuple(own[a : a + k]) for a in range(len(own) - k + 1)}
        for at in range(len(w) - k + 1):
            if tuple(w[at : at + k]) in windows:
                hit |= set(range(at, at + k))
                met |= {str(i)} - {"None"}
                longest = max(longest, *(next((n for n in range(len(own) - a + 1) if own[a : a + n] != w[at : at + n] or at + n > len(w)), len(own) - a + 1) - 1 for a in range(len(own) - k + 1) if tuple(own[a : a + k]) == tuple(w[at : at + k])))
    return len(w), len(hit), sorted(met), longest


# 11
@pytest.mark.parametrize(("seed", "block", "shard"), [(1, 10**6, 10**6), (2, 300, 10**6), (3, 10**6, 37)])
def test_find_leaks_matches_brute_force(spark, monkeypatch, seed, block, shard):
    docs, items = leak_case(seed)
    if shard < 100:  # a text is cut into pieces; the workers get the setting with the closure's module only where they are forked
        docs = docs[:-1]
        found = []
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        own = Items.of([None if i is None else str(i) for i, t in items if t is not None], pa.array([t for _, t in items if t is not None]), 10)
        w = decontaminate.Words(pa.array([t for _, t in docs]), decontaminate.SEPARATORS, lower=True)
        hit, best, pairs = decontaminate._hits(w, own)
        for d, (_, text) in enumerate(docs):
            lo, hi = w.first[d : d + 2]
            names = [own.ids[p % len(own.ids)] for p in pairs if p // len(own.ids) == d]
            found.append((hi - lo, int(hit[lo:hi].sum()), names, int(max([0, *best[lo:hi]]))))
            assert found[-1] == brute_leaks(text, items)
        return
    rows = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    key = lambda x: (x[0] is None, *map(str, x))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["longest"], sum(s["hi"] - s["lo"] for s in r["spans"])) for r in find_leaks(rows, bench, block_bytes=block).collect()]
    want = [(i, n, h, m, longest, h) for i, t in docs for n, h, m, longest in [brute_leaks(t, items)]]
    assert sorted(got, key=key) == sorted(want, key=key)
    left = drop_contaminated(rows, bench)
    assert left.columns == rows.columns and sorted(map(key, left.select("doc_id", "text").collect())) == sorted(key((i, t)) for i, t in docs if not brute_leaks(t, items)[1])


def test_find_leaks_without_items_or_documents(spark):
    docs, items = leak_case(4)
    rows = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in docs[:9]], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    none = find_leaks(rows, bench.where("false"))
    assert none.count() == 9 and none.where("n_hit > 0 or size(items) > 0 or longest > 0").count() == 0
    assert find_leaks(rows.where("false"), bench).count() == 0
    assert longest_matches(rows, bench.where("false")).count() == 0


def test_longest_matches(spark):
    r = random.Random(8)
    item = some_words(40, r, 10**6)
    docs = [(1, " ".join([*some_words(5, r), *item[3:20], *some_words(4, r)])), (2, " ".join([*item[5:30], "x", *item[5:30]])), (3, " ".join(item[:9])), (None, " ".join(item[25:40]))]
    got = {x["item_word"]: x for x in longest_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([("a", " ".join(item)), (None, None)], "item_id string, text string")).collect()}
    assert sorted(got) == [*range(3, 21), *range(25, 31)]
    assert (got[3]["length"], got[3]["doc_id"], got[3]["doc_word"], got[3]["occurrences"]) == (17, 1, 5, 1)
    assert (got[5]["length"], got[5]["doc_id"], got[5]["doc_word"], got[5]["occurrences"]) == (25, 2, 0, 2)
    assert (got[25]["length"], got[25]["doc_id"]) == (15, None)


def test_suffix_array_is_in_order():
    r = np.random.default_rng(5)
    for n, kinds in ((1, 1), (50, 1), (300, 2), (400, 1000)):
        words = r.integers(0, kinds, n).astype(np.uint64)
        cuts = np.unique(np.append(r.integers(1, n + 1, 4), n))
        ends = cuts[np.searchsorted(cuts, np.arange(n), "right")]
        for depth in (1, 7, n):
            array = SuffixArray(words, ends, depth)
            seen = [words[p : min(ends[p], p + max(depth, array.pack))].tolist() for p in array.order]
            assert sorted(array.order.tolist()) == list(range(n)) and all(a[:depth] <= b[:depth] for a, b in zip(seen, seen[1:], strict=False))


# 12
def test_rotation_exchanges_blocks(monkeypatch):
    monkeypatch.setattr("tidewheel.llm.fim.SWAP", 3)
    for n in range(9):
        for a in range(n + 1):
            for b in range(a, n + 1):
                for m in range(a, b + 1):
                    x = np.arange(n, dtype=np.uint8)
                    rotate(x, a, m, b)
                    want = list(range(n))
                    assert x.tolist() == want[:a] + want[m:b] + want[a:m] + want[b:]


def fim_by_slices(doc_id, text, rate, spm):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return text, "plain", n, None, None
    return (f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)) if h[3] % 100 < spm else (f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m))


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (100, 100)])
def test_fill_in_middle_matches_slices_and_restores(spark, rate, spm):
    r = random.Random(rate + spm)
    texts = ["", None, "\n", "\n\n", "a", "a\n", "<P>", "x<M>\ny", "ab<\n<\nP>\n>", "<S\n<P\n", "é\n日本\n\U0001f600x\r\ny", "\x00\n\x00", "".join(r.choice("ab\n<PSM>é") for _ in range(300_000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")]
    docs = [(i, t) for i, t in enumerate(texts * 6)] + [(None, "p\nq\nr\n"), (5, "k\n"), (5, "k\n")] + [(1000 + i, "".join(r.choice("ab\n<>PSMé日") for _ in range(r.randrange(40)))) for i in range(300)]
    rows = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in docs], DOCS)
    made = fill_in_middle(rows, rate, spm)
    key = lambda x: (x[0] is None, *map(str, x))
    got = [(x["doc_id"], x["fim_text"], x["form"], x["n_units"], x["prefix_chars"], x["middle_chars"]) for x in made.collect()]
    assert sorted(got, key=key) == sorted(((i, *fim_by_slices(i, t, rate, spm)) for i, t in docs), key=key)
    back = [(x["doc_id"], x["restored"], x["n_hit"]) for x in restore_text(made).collect()]
    assert sorted(back, key=key) == sorted(((i, t or "", "x") for i, t in docs), key=key)
    assert fill_in_middle(rows.where("false")).count() == 0
    assert fill_in_middle(rows, keep_text=True).columns == ["doc_id", "text", "n_hit", "items", "spans", "longest", "fim_text", "form", "n_units", "prefix_chars", "middle_chars"]


def test_fill_in_middle_of_a_very_long_text():
    text = b"0123456789 line\n" * 4_000_000  # 64 MB
    out, form, n, prefix, middle = transform(text, draws(11, 7), 100, 50)
    assert n == 4_000_000 and form != "plain" and prefix % 16 == middle % 16 == 0 and len(out) == len(text) + 9 and restore(out, form) == text


# 13
def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    v = (q * values) @ q.T
    return (v + v.T) / 2


SPECTRA = {
    "flat": np.ones(40), "falling": np.exp(-np.arange(40) / 3.0), "clusters": np.repeat([5.0, 5.0 - 1e-9, 3.0, 1.0], 10), "rank three": np.append([4.0, 2.0, 1.0], np.zeros(37)),
    "even": np.linspace(1, 2, 40), "wide": 10.0 ** -np.linspace(0, 12, 40), "small": np.array([2.0, 1.0]), "one": np.array([3.0]), "zero": np.zeros(5), "pairs": np.repeat(np.arange(1.0, 33.0), 2),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_match_dense_decomposition(name):
    values = SPECTRA[name]
    v = spectrum(values)
    got, vectors = components(v, 8)
    k, top = min(8, len(values)), np.abs(values).max()
    assert np.allclose(got, np.sort(values)[::-1][:k], atol=1e-13 * max(top, 1e-300) * 10)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-13) and np.abs(v @ vectors - vectors * got).max() <= 1e-13 * 10 * max(top, 1e-300)
    again = components(v, 8)
    assert (again[0] == got).all() and (again[1] == vectors).all()


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(3)
    for n in range(1, 12):
        for _ in range(20):
            a = rng.standard_normal((n, n))
            a = a + a.T
            if rng.random() < 0.4:
                np.fill_diagonal(a, 0)  # no pivot of its own
            assert negative(a) == (np.linalg.eigvalsh(a) < 0).sum()
    v = spectrum(SPECTRA["falling"])
    cut = intervals(v, 8)
    assert sum(n for *_, n in cut) >= 8 and all(((SPECTRA["falling"] > lo) & (SPECTRA["falling"] <= hi)).sum() == n for lo, hi, n in cut)


def test_whiten_matches_dense_decomposition(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))
    rows = [(i, x.tolist(), "x") for i, x in enumerate(base)]
    rows += [(1000, None, "x"), (1001, [], "x"), (1002, [None] * 12, "x"), (1003, [math.nan] * 12, "x"), (1004, [math.inf] * 12, "x"), (1005, [1.0] * 5, "x"), (1006, [1e300] * 12, "x")]
    rows += [(7, base[7].tolist(), "x"), (None, base[9].tolist(), "x"), (1007, [0.0] * 12, "x")]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(5)
    got = whiten(e).collect()
    kept = [(i, np.floor(1024 * np.array(v)).astype(np.int64) + 100_000) for i, v, _ in rows if i is None or i < 1000 or i == 1007]
    x = np.array([v for _, v in kept])
    n, total = len(x), x.sum(axis=0)
    cov = np.cov(x.T, bias=True)
    value, vec = np.linalg.eigh(cov)
    value, vec = value[::-1][:8], vec[:, ::-1][:, :8]
    white = (x - total / n) @ vec / np.sqrt(value)
    away = [sum((n * a - s) ** 2 for a, s in zip(r, total.tolist(), strict=True)) for r in x.tolist()]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-10
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    sign = None
    for (i, _), w, d in zip(kept, white, away, strict=True):
        mine = by[i, d]
        own = np.array([mine[c]["whitened"] for c in range(1, 9)])
        sign = np.sign(own * w) if sign is None else sign
        assert np.allclose(own, sign * w, atol=1e-9) and np.allclose([mine[c]["explained"] for c in range(1, 9)], value / np.trace(cov), rtol=1e-10)


def test_whiten_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    assert whiten(frame([])).count() == 0 and whiten(frame([(1, None, 1)])).count() == 0
    assert whiten(frame([(1, [1.0, 2.0], 1)])).count() == 0  # no variance
    assert whiten(frame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0
    two = whiten(frame([(1, [1.0, 2.0], 1), (2, [1.0, 3.0], 1)])).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9)), r["explained"], r["deviation"]) for r in two) == [(1, 1, 1.0, 1.0, 1024**2), (2, 1, 1.0, 1.0, 1024**2)]
    big = whiten(frame([(1, [1e12, 1.0], 1), (2, [-1e12, 1.0], 1), (3, [0.0, 1.0], 1)]), k=1).collect()
    assert all(r["deviation"] is None for r in big if r["vec_id"] < 3) and [r["deviation"] for r in big if r["vec_id"] == 3] == [0]
    assert np.allclose(sorted(r["whitened"] for r in big), [-(1.5**0.5), 0, 1.5**0.5])
