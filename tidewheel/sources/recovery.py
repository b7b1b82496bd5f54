"""Ids of users that earlier runs have evaluated, recovered from their prediction files in JSON, CSV and NPZ.

Each file is streamed by one task in chunks, so memory doesn't grow with a file; a file counts whole or not at all. Opened by ``pyarrow.fs``: local paths and the stores whose URIs it knows.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidewheel.operators.shared import stored

# Names of files and keys that earlier runs wrote.
RESERVED = ("__PAD__", "__UNKNOWN__")
NO_USERS_BELOW = ("labels", "targets", "metrics", "y_true", "ground_truth")
INPUT_FOLDERS = ("raw", "raw_data", "source_data", "amazon_data", "amazon_reviews", "5core", "rating_only")
OUTPUT_WORDS = ("prediction", "result", "recommendation")
MANIFEST = "suite_manifest.json"

CHUNK, LONGEST_TOKEN, DEEPEST, BATCH = 1 << 16, 8 << 20, 100, 1 << 14
READ = pa.schema([(c, pa.int64() if c == "uid" else pa.string()) for c in ("path", "mode", "user_id", "data_id", "uid", "status", "reason", "sha256")])
TOKEN = re.compile(r'[ \t\r\n]*+(?:([{}\[\]:,])|("[^"\\\x00-\x1f]*+(?:\\["\\/bfnrtu][^"\\\x00-\x1f]*+)*+")|([^ \t\r\n{}\[\]:,"]++))')
WORD = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


class RecoveryError(ValueError):
    """A file that can't be trusted; none of its users count."""


class NoUserColumn(Exception):
    """A CSV without a column ``user_id``: passed over."""


def tokens(stream: io.TextIOBase) -> Iterator[str]:
    """Marks, quoted strings and bare words of a JSON text, read by chunks; a longer token than ``LONGEST_TOKEN`` raises."""
    text, at, ended = "", 0, False
    while True:
        m = TOKEN.match(text, at)
        if m and (ended or not m[3] or m.end() < len(text)):  # a bare word may go on in the next chunk
            yield m[m.lastindex]
            at = m.end()
            continue
        if ended:
            if text[at:].strip(" \t\r\n"):
                raise RecoveryError("not JSON")
            return
        if len(text) - at > LONGEST_TOKEN:
            raise RecoveryError("a token is too long")
        more = stream.read(max(CHUNK, len(text) - at))
        text, at, ended = text[at:] + more, 0, not more


def json_users(stream: io.TextIOBase) -> Iterator[str]:
    """Values of the keys ``user_id`` at any depth, but below ``NO_USERS_BELOW``. One that isn't a text, or is empty, and anything that isn't one JSON value raises."""
    within: list[tuple[str, bool]] = []  # open brackets, each with whether users inside count
    state, counts, wanted = "value", True, False
    for token in tokens(stream):
        quoted = token[0] == '"'
        if (state, token) in (("first value", "]"), ("first key", "}")) or (state == "next" and within and token == {"[": "]", "{": "}"}[within[-1][0]]):
            within.pop()
            state = "next"
        elif state in ("value", "first value"):
            if wanted and not (quoted and token != '""'):
                raise RecoveryError("a user_id is not a text")
            if token in "{[":
                within.append((token, counts))
                if len(within) > DEEPEST:
                    raise RecoveryError("nested too deep")
                state = "first key" if token == "{" else "first value"
            elif quoted or WORD.fullmatch(token):
                if wanted:
                    yield json.loads(token)
                state = "next"
            else:
                raise RecoveryError("a value is missing")
            wanted = False
        elif state in ("key", "first key") and quoted:
            key = json.loads(token)
            counts = within[-1][1] and key not in NO_USERS_BELOW
            wanted = counts and key == "user_id"
            state = ":"
        elif state == ":" and token == ":":
            state = "value"
        elif state == "next" and within and token == ",":
            state, counts = ("key" if within[-1][0] == "{" else "value"), within[-1][1]
        else:
            raise RecoveryError("not JSON")
    if state != "next" or within:
        raise RecoveryError("truncated JSON")


def csv_users(stream: io.TextIOBase) -> Iterator[str]:
    rows = csv.reader(stream)
    header = next(rows, [])
    if "user_id" not in header:
        raise NoUserColumn
    if header.count("user_id") > 1:
        raise RecoveryError("two columns user_id")
    at = header.index("user_id")
    for row in rows:
        if len(row) != len(header) or not row[at]:
            raise RecoveryError("a row without a user")
        yield row[at]


def npz_uids(file: io.IOBase) -> Iterator[np.ndarray]:
    """The one-dimensional integers ``uid`` of an archive, by chunks; other arrays aren't read and nothing is unpickled."""
    with zipfile.ZipFile(file) as archive:
        if "uid.npy" not in archive.namelist():
            raise RecoveryError("no uid")
        with archive.open("uid.npy") as f:
            version = np.lib.format.read_magic(f)
            shape, _, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
            if len(shape) != 1 or kind.kind not in "iu":
                raise RecoveryError("uid is not a list of whole numbers")
            for start in range(0, shape[0], BATCH):
                n = min(BATCH, shape[0] - start)
                raw = f.read(n * kind.itemsize)
                if len(raw) < n * kind.itemsize:
                    raise RecoveryError("truncated uid")
                yield np.frombuffer(raw, kind).astype("int64")


def manifest_id(store: fs.FileSystem, path: str) -> str:
    """``data_id`` in the nearest manifest above a file."""
    for folder in PurePosixPath(path).parents:
        at = str(folder / MANIFEST)
        if store.get_file_info(at).type == fs.FileType.File:
            with store.open_input_stream(at) as f:
                value = json.loads(f.read())
            inner, outer = (value.get("source") or {}).get("data_id"), value.get("data_id")
            if inner and outer and inner != outer:
                raise RecoveryError("the manifest names two data_ids")
            if not (inner or outer):
                raise RecoveryError("the manifest names no data_id")
            return inner or outer
    raise RecoveryError("no manifest")


def _digest(store: fs.FileSystem, path: str) -> str:
    out = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while block := f.read(1 << 20):
            out.update(block)
    return out.hexdigest()


def _rows(n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of ``READ``: lists as they are, single values repeated, the rest null."""
    return pa.RecordBatch.from_arrays([pa.array(v if isinstance(v := columns.get(f.name), list | np.ndarray) else [v] * n, f.type) for f in READ], schema=READ)


def _asset(path: str, mode: str) -> Iterator[pa.RecordBatch]:
    """Batches of a file's users or uids, then one row with its status."""
    status, reason, digest = "recovered", None, None
    try:
        store, at = fs.FileSystem.from_uri(path)
        digest = _digest(store, at)
        with store.open_input_file(at) as file:
            if mode == "npz":
                data_id = manifest_id(store, at)
                for uids in npz_uids(file):
                    yield _rows(len(uids), path=path, mode=mode, data_id=data_id, uid=uids)
            else:
                stream = io.TextIOWrapper(file, encoding="utf-8-sig", newline="")
                for batch in itertools.batched((json_users if mode == "json" else csv_users)(stream), BATCH):
                    users = list(dict.fromkeys(batch))
                    yield _rows(len(users), path=path, mode=mode, user_id=users)
    except NoUserColumn:
        status = "skipped"
    except RecoveryError as e:
        status, reason = "unresolved", str(e)
    except (OSError, ValueError, KeyError, TypeError, AttributeError, csv.Error, zipfile.BadZipFile) as e:
        status, reason = "unresolved", type(e).__name__
    yield _rows(1, path=path, mode=mode, status=status, reason=reason, sha256=digest)


def _assets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield from _asset(row["path"], row["mode"])


def asset_mode(path: str) -> Column:
    """``json``, ``npz`` or ``csv`` for the output files of earlier runs; null for anything else, source data among it."""
    name = F.substring_index(path, "/", -1)
    low = F.lower(name)
    words = F.lit(False)
    for w in OUTPUT_WORDS:
        words = words | low.contains(w)
    source = F.arrays_overlap(F.split(F.lower(F.col(path)), "/"), F.array(*map(F.lit, INPUT_FOLDERS)))
    return F.when(name.endswith(".json") & low.contains("predictions"), "json").when(name.endswith("_users.npz"), "npz").when(low.endswith(".csv") & ~source & (low.startswith("preds_") | words), "csv")


def read_identities(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``data_id, uid, user_id`` from encoder files (JSON with ``data_id``, ordered ``users`` and ``source_sha256``); raises unless each is whole, its users are distinct texts, and files of one ``data_id`` agree.

    A file is one record; an encoder too large for that comes to :func:`recover` as a table.
    """
    files = spark.read.schema("data_id STRING, users ARRAY<STRING>, source_sha256 STRING").option("multiLine", True).json(paths).withColumn("_file", F.col("_metadata.file_path"))
    heads = files.where("data_id is null or users is null or size(users) = 0 or source_sha256 is null or not source_sha256 rlike '^[0-9a-f]{64}$'")
    rows = files.select("_file", "data_id", F.posexplode("users").alias("uid", "user_id"))
    repeated = rows.groupBy("_file", "user_id").count().where("user_id is null or user_id = '' or count > 1")
    split = rows.groupBy("data_id", "uid").agg(F.min("user_id").alias("a"), F.max("user_id").alias("b"), F.count("*").alias("n"))
    uneven = split.join(files.groupBy("data_id").agg(F.count("*").alias("files")), "data_id").where("a <> b or n <> files")
    if not (heads.isEmpty() and repeated.isEmpty() and uneven.isEmpty()):
        raise RecoveryError("an encoder file is not whole, repeats a user or disagrees with another of its data_id")
    return rows.select("data_id", F.col("uid").cast("bigint"), "user_id").distinct()


@dataclass(frozen=True)
class Recovery:
    """``users``: ``user_id``. ``registry``: one row a source with ``path, mode, status, n_users, reason, sha256``. ``encoders``: ``data_id, n_users, n_outside`` (users not recovered). Never proof that all users were found."""

    users: DataFrame
    registry: DataFrame
    encoders: DataFrame

    def write(self, path: str) -> None:
        """Three Parquet tables in a new folder; one that holds a recovery already raises."""
        for name in ("users", "registry", "encoders"):
            getattr(self, name).write.mode("error").parquet(f"{path}/{name}")


def recover(inventory: DataFrame, identities: DataFrame, listed: DataFrame | None = None) -> Recovery:
    """Users in the files that ``inventory.path`` lists (repeats and null count once or not at all; what :func:`asset_mode` doesn't know is left out).

    ``identities`` (``data_id, uid, user_id``) turns the uids of NPZ files into users; a file with a uid outside it, a reserved one or an unknown ``data_id`` is unresolved. ``listed`` (``path, mode, user_id``)
    adds users known from elsewhere, such as a whole encoder; reserved names don't count.
    """
    spark = inventory.sparkSession
    paths = stored(inventory.select("path").where("path is not null").distinct().withColumn("mode", asset_mode("path")).where("mode is not null"), "assets")
    # a row is a file: as many parts as files, up to a few for each core
    parts = max(1, min(paths.count(), 4 * spark.sparkContext.defaultParallelism))
    read = stored(paths.repartition(parts, "path").mapInArrow(_assets, from_arrow_schema(READ)), "asset-users")
    known = identities.groupBy("data_id").agg(F.lit(True).alias("_known"))
    uids = read.where("uid is not null").select("path", "data_id", "uid").distinct()
    named = uids.join(identities.select("data_id", "uid", "user_id"), ["data_id", "uid"], "left").join(known, "data_id", "left")
    fault = F.when(F.col("_known").isNull(), "no identity of its data_id").when(F.col("user_id").isNull(), "a uid outside the identity").when(F.col("user_id").isin(*RESERVED), "a reserved uid")
    named = stored(named.select("path", "user_id", fault.alias("fault")), "asset-names")
    faults = named.where("fault is not null").groupBy("path").agg(F.min("fault").alias("fault"))
    ends = read.where("status is not null").select("path", "mode", "status", "reason", "sha256").join(faults, "path", "left")
    ends = ends.select("path", "mode", F.when(F.col("fault").isNotNull(), "unresolved").otherwise(F.col("status")).alias("status"), F.coalesce("reason", "fault").alias("reason"), "sha256")
    found = read.where("user_id is not null").select("path", "user_id").union(named.where("fault is null").select("path", "user_id"))
    found = found.join(ends.where("status = 'recovered'").select("path"), "path", "left_semi").distinct()
    if listed is not None:
        more = listed.where(F.col("user_id").isNotNull() & (F.col("user_id") != "") & ~F.col("user_id").isin(*RESERVED))
        found = found.union(more.select("path", "user_id").distinct())
        ends = ends.union(listed.select("path", "mode").distinct().selectExpr("path", "mode", "'recovered'", "cast(null as string)", "cast(null as string)"))
    found = stored(found, "recovered")
    registry = ends.join(found.groupBy("path").agg(F.count("*").alias("n_users")), "path", "left").select("path", "mode", "status", F.coalesce("n_users", F.lit(0)).alias("n_users"), "reason", "sha256")
    users = found.select("user_id").distinct()
    inside = users.withColumn("_in", F.lit(1))
    encoders = identities.where(~F.col("user_id").isin(*RESERVED)).join(inside, "user_id", "left").groupBy("data_id").agg(F.count("*").alias("n_users"), F.count_if(F.col("_in").isNull()).alias("n_outside"))
    return Recovery(users, registry, encoders)
