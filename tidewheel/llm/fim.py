"""Fill-in-middle: segments of a text exchanged in place by block rotations, which inverted give the text back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fed
from .words import batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that a reversal swaps at a time, all that it needs beside the text.
SWAP = 1 << 16
_NEW = ("fim_text", "form", "n_units", "prefix_chars", "middle_chars")


def _reverse(x: np.ndarray, a: int, b: int) -> None:
    """Bytes a to b of ``x`` reversed in place."""
    while a < b - 1:
        n = min(SWAP, (b - a) // 2)
        head = x[a : a + n][::-1].copy()
        x[a : a + n] = x[b - n : b][::-1]
        x[b - n : b] = head
        a, b = a + n, b - n


def rotate(x: np.ndarray, a: int, m: int, b: int) -> None:
    """Blocks a to m and m to b of ``x`` exchanged in place: each is reversed, then both together."""
    _reverse(x, a, m)
    _reverse(x, m, b)
    _reverse(x, a, b)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four integers of 32 bits from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def _chars(x: np.ndarray) -> int:
    return int(np.count_nonzero((x & 0xC0) != 0x80))


def transform(text: bytes, h: list[int], rate: int, spm: int) -> tuple[bytes, str, int, int | None, int | None]:
    """Output, form, number of lines, and code points of prefix and middle (None if plain)."""
    raw = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero(raw == 10)
    n = len(breaks) + bool(text and text[-1] != 10)
    if not text or h[2] % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return text, "plain", n, None, None
    cut = [0 if k == 0 else len(text) if k == n else int(breaks[k - 1]) + 1 for k in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
    prefix, middle = _chars(raw[: cut[0]]), _chars(raw[cut[0] : cut[1]])
    buffer = bytearray(text)
    # the sentinels stand before their segments, the last first so that the cuts stay
    buffer[cut[1] : cut[1]] = SUFFIX
    buffer[cut[0] : cut[0]] = MIDDLE
    buffer[0:0] = PREFIX
    m, s = cut[0] + len(PREFIX), cut[1] + len(PREFIX) + len(MIDDLE)
    form = "spm" if h[3] % 100 < spm else "psm"
    rotate(np.frombuffer(buffer, np.uint8), 0 if form == "spm" else m, s, len(buffer))
    return bytes(buffer), form, n, prefix, middle


def restore(output: bytes, form: str) -> bytes:
    """The text from which :func:`transform` made ``output``: its rotation inverted and the sentinels taken out.

    A text with a sentinel stays plain, and no sentinel begins inside another or across its edge, so each is found where it was put.
    """
    if form == "plain":
        return output
    buffer = bytearray(output)
    s, m = buffer.find(SUFFIX), buffer.find(MIDDLE)
    if form == "psm":
        rotate(np.frombuffer(buffer, np.uint8), s, m, len(buffer))
    else:
        rotate(np.frombuffer(buffer, np.uint8), 0, buffer.find(PREFIX), len(buffer))
    m, s = buffer.find(MIDDLE), buffer.find(SUFFIX)
    del buffer[s : s + len(SUFFIX)]
    del buffer[m : m + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return bytes(buffer)


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, id_col: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``fim_text, form, n_units, prefix_chars, middle_chars`` appended, without its text unless ``keep_text``.

    A text is cut at two of its line ends (or its begin), drawn from the hash of ``seed`` and id, into prefix, middle and suffix. ``rate`` in 100 are transformed, ``spm`` in 100 of
    these to ``<S>suffix<P>prefix<M>middle``, the others to ``<P>prefix<S>suffix<M>middle``. The sentinels are put into a byte array of the text and two neighbouring
    blocks are exchanged by three reversals; ``prefix_chars`` and ``middle_chars`` count code points.

    Null and empty texts, and texts that hold a sentinel, stay as they are (null: empty), in form ``plain``. A null id draws like an empty one; repeated rows give the
    same. Texts are worked on one by one and whole: a task holds a batch and twice its longest text. Other columns pass through, but for those named as the new ones.
    """
    docs = fed(docs.drop(*[c for c in docs.columns if c.lower() in _NEW]))
    kept = [f for f in docs.schema if keep_text or f.name != text]
    new = [("fim_text", T.StringType()), ("form", T.StringType()), ("n_units", T.LongType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    out = T.StructType([*kept, *(T.StructField(n, t) for n, t in new)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, text):
            rows = [transform(x.as_py() or b"", draws(i, seed), rate, spm) for x, i in zip(batch.column(text).cast(pa.binary()), batch.column(id_col).to_pylist(), strict=True)]
            made = list(zip(*rows, strict=True))
            columns = [pa.array(made[0], pa.binary()).cast(pa.string()), pa.array(made[1], pa.string()), *(pa.array(made[k], pa.int64()) for k in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[f.name for f in out])

    return docs.mapInArrow(run, out)


def restore_text(made: DataFrame, name: str = "restored") -> DataFrame:
    """``made`` of :func:`fill_in_middle` with the text restored from ``fim_text`` and ``form`` alone, in column ``name`` instead of ``fim_text``. A null output stays null."""
    made = made.drop(name)
    kept = [f for f in made.schema if f.name != "fim_text"]
    out = T.StructType([*kept, T.StructField(name, T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "fim_text"):
            both = zip(batch.column("fim_text").cast(pa.binary()), batch.column("form").to_pylist(), strict=True)
            back = [None if x.as_py() is None else restore(x.as_py(), form) for x, form in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(back, pa.binary()).cast(pa.string())], names=[f.name for f in out])

    return made.mapInArrow(run, out)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
             CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, len(l) AS n, CAST(least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS BIGINT) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:n], '') AS x FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""
