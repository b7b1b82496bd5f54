"""Files of earlier runs and JSON lines with faults."""

import io
import json

import numpy as np
import pytest

from tidewheel.sources import interactions as src
from tidewheel.sources import recovery
from tidewheel.sources.quarantine import checked_lines, line_counts, usable, write_quarantine


def put(root, name, value):
    at = root / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(at)


def encoder(root, name, users):
    return put(root, f"{name}.encoder.json", {"data_id": name, "users": [*recovery.RESERVED, *users], "source_sha256": "a" * 64})


def paths(spark, found):
    return spark.createDataFrame([(p,) for p in found], "path string")


NO_IDENTITY = "data_id string, uid bigint, user_id string"


def test_three_formats_make_one_set_of_users(spark, tmp_path):
    ids = recovery.read_identities(spark, [encoder(tmp_path, "first", ["alice", "bob"]), encoder(tmp_path, "second", ["charlie", "alice"])])
    assets = []
    for name in ("first", "second"):
        put(tmp_path, f"{name}/{recovery.MANIFEST}", {"source": {"data_id": name}})
        assets.append(str(tmp_path / name / "deep_users.npz"))
        np.savez(assets[-1], uid=np.array([2]), labels=np.array([object()], dtype=object))
    assets.append(put(tmp_path, "old_predictions.json", [{"user_id": "diana", "labels": [1, 2]}, {"user_id": "alice", "metrics": {"a": 1}}]))
    assets.append(put(tmp_path, "test_recommendations.csv", "user_id,item\nerin,item1\n"))
    assets.append(put(tmp_path, "source.csv", "user_id,item\nnot evaluated,item1\n"))
    listed = ids.where("data_id = 'first'").selectExpr("'first.encoder' as path", "'whole encoder' as mode", "user_id")
    got = recovery.recover(paths(spark, [*assets, assets[0], None]), ids, listed)
    assert {r[0] for r in got.users.collect()} == {"alice", "bob", "charlie", "diana", "erin"}
    rows = {r["path"]: r for r in got.registry.collect()}
    assert set(rows) == {*assets[:4], "first.encoder"} and all(r["status"] == "recovered" for r in rows.values())
    assert rows["first.encoder"]["n_users"] == 2 and rows[assets[2]]["n_users"] == 2 and len(rows[assets[2]]["sha256"]) == 64
    assert {r["data_id"]: (r["n_users"], r["n_outside"]) for r in got.encoders.collect()} == {"first": (2, 0), "second": (2, 0)}
    got.write(str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        got.write(str(tmp_path / "out"))


def test_only_output_files_count(spark, tmp_path):
    row = "user_id,item\n{},item1\n"
    assets = [put(tmp_path, "preds_legacy.csv", row.format("legacy")), put(tmp_path, "PREDS_SECOND.CSV", row.format("second")), put(tmp_path, "other_preds_x.csv", row.format("none"))]
    assets += [put(tmp_path, f"{d}/preds_source.csv", row.format("input")) for d in recovery.INPUT_FOLDERS]
    headless = put(tmp_path, "results.csv", "item\na\n")
    got = recovery.recover(paths(spark, [*assets, headless]), spark.createDataFrame([], NO_IDENTITY))
    assert sorted(r[0] for r in got.users.collect()) == ["legacy", "second"]
    assert {(r["path"], r["status"], r["n_users"]) for r in got.registry.collect()} == {(assets[0], "recovered", 1), (assets[1], "recovered", 1), (headless, "skipped", 0)}


def test_faulty_files_give_no_user(spark, tmp_path):
    ids = recovery.read_identities(spark, [encoder(tmp_path, "first", ["alice"])])
    assets = {}
    for name, uid, manifest in (("over", [2, 3], "first"), ("under", [2, -1], "first"), ("pad", [2, 0], "first"), ("other", [2], "wrong"), ("table", [[2]], "first"), ("real", [2.0], "first")):
        put(tmp_path, f"{name}/{recovery.MANIFEST}", {"data_id": manifest})
        assets[name] = str(tmp_path / name / "x_users.npz")
        np.savez(assets[name], uid=np.array(uid))
    put(tmp_path, f"torn/{recovery.MANIFEST}", {"data_id": "first", "source": {"data_id": "second"}})
    assets["torn"] = str(tmp_path / "torn" / "x_users.npz")
    np.savez(assets["torn"], uid=np.array([2]))
    assets["broken"] = put(tmp_path, "over/broken_users.npz", "no archive")
    assets["gone"] = str(tmp_path / "gone_predictions.json")
    assets["cut"] = put(tmp_path, "cut_predictions.json", '[{"user_id": "u"}')
    assets["ragged"] = put(tmp_path, "preds_ragged.csv", "user_id,item\nu,1\nv\n")
    assets["twice"] = put(tmp_path, "preds_twice.csv", "user_id,user_id\nu,1\n")
    got = recovery.recover(paths(spark, assets.values()), ids)
    rows = {r["path"]: r for r in got.registry.collect()}
    assert got.users.isEmpty() and set(rows) == set(assets.values())
    assert all(r["status"] == "unresolved" and r["reason"] and r["n_users"] == 0 for r in rows.values())
    assert rows[assets["other"]]["reason"] == "no identity of its data_id" and rows[assets["gone"]]["reason"] == "FileNotFoundError"
    assert recovery.recover(paths(spark, []), ids).users.isEmpty()


def test_identities_must_be_whole(spark, tmp_path):
    good = encoder(tmp_path, "a", ["u", "v"])
    for name, value in (("twice", {"data_id": "b", "users": ["u", "u"], "source_sha256": "a" * 64}), ("empty", {"data_id": "b", "users": [], "source_sha256": "a" * 64}), ("hash", {"data_id": "b", "users": ["u"], "source_sha256": "A"}), ("other", {"data_id": "a", "users": [*recovery.RESERVED, "v", "u"], "source_sha256": "a" * 64})):
        with pytest.raises(recovery.RecoveryError):
            recovery.read_identities(spark, [good, put(tmp_path, f"{name}.json", value)])
    assert recovery.read_identities(spark, [good]).count() == 4


def users_of(text):
    return list(recovery.json_users(io.StringIO(text)))


def test_json_by_chunks(monkeypatch):
    value = [{"ignored": "x\\\"y" * 30000, "user_id": "用户\n\"q\"", "metrics": {"user_id": "no"}, "labels": [{"user_id": "no"}], "n": [1, -2.5e-3, True, None, {}, []]}, {"deep": [{"user_id": "other"}]}]
    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1)):
        for chunk in (1, 7, 1 << 16):
            monkeypatch.setattr(recovery, "CHUNK", chunk)
            assert users_of(text) == ["用户\n\"q\"", "other"]
    monkeypatch.setattr(recovery, "CHUNK", 1 << 16)
    for bad in ("", " ", "[", '[{"user_id": 2}]', '[{"user_id": ""}]', '[{"user_id": ["u"]}]', '[{"user_id": "u"}', "[1,]", '{"a" 1}', '{"a": 1,}', "{1: 2}", "[1] 2", "[1}", "]", "[tru]", "[01]", '["a\nb"]', '["\\q"]', "[" * 101 + "]" * 101):
        with pytest.raises(recovery.RecoveryError):
            users_of(bad)
    for good in ("1", '"a"', "null", "{}", "[]", "[[],{}]", "[" * 100 + "]" * 100):
        assert users_of(good) == []
    monkeypatch.setattr(recovery, "LONGEST_TOKEN", 1000)
    with pytest.raises(recovery.RecoveryError):
        users_of('["' + "x" * 200000 + '"]')


def test_bad_lines_are_kept_with_their_reason(spark, tmp_path):
    ok = '{"user_id":"u","parent_asin":"p","rating":"4.5","timestamp":7,"verified_purchase":true,"extra":{"a":1}}'
    bad = {"not json": "{oops", "blank": "  ", "not an object": "[1]", "no user_id": ok.replace('"u"', "null"), "bad rating": ok.replace("4.5", "good"), "bad timestamp": ok.replace("7", '"x"')}
    path = put(tmp_path, "r.jsonl", "\n".join([ok, *bad.values(), '"text"', "null", ok, ""]))
    rows = src.checked_reviews(spark, path)
    more = [ok + "}", ok + "x", ok + "," + ok, ok + "]", ok + '] "a"', ok + "],[{}", "{'user_id':'u'}"]
    assert [r["reason"] for r in src.checked_reviews(spark, put(tmp_path, "s.jsonl", "\n".join(more) + "\n")).collect()] == ["not json"] * len(more)
    nested = ok.replace('{"a":1}', '[{"a":1}, {"a":[{}]}]')
    assert usable(src.checked_reviews(spark, put(tmp_path, "n.jsonl", nested + " \r\n  " + nested))).count() == 2
    assert {r["reason"]: r["lines"] for r in line_counts(rows).collect()} == {**dict.fromkeys(bad, 1), "not an object": 3, "usable": 2}
    got = usable(rows).collect()
    assert len(got) == 2 and got[0]["rating"] == 4.5 and got[0]["verified_purchase"] is True and got[0]["asin"] is None
    write_quarantine(rows, str(tmp_path / "bad"))
    kept = {r["reason"]: r["line"] for r in spark.read.parquet(str(tmp_path / "bad")).where("reason <> 'not an object'").collect()}
    assert kept == {k: v for k, v in bad.items() if k != "not an object"}
    long = put(tmp_path, "long.jsonl", ok.replace('"u"', '"' + "u" * 3_000_000 + '"') + "\n")
    assert len(usable(src.checked_reviews(spark, long)).first()["user_id"]) == 3_000_000
    assert checked_lines(spark, put(tmp_path, "none.jsonl", ""), {"a": "INT"}, ["a"]).count() == 0
    meta = put(tmp_path, "m.jsonl", '{"parent_asin":"p","store":"S","details":{"Brand":"B"}}\n{"parent_asin":"q","details":"none"}\n{"parent_asin":"r","store":" ","details":{"Brand":"B"}}\n')
    assert {r["item_id"]: r["brand"] for r in src.read_meta_jsonl(spark, meta).collect()} == {"p": "S", "q": "Unknown", "r": "B"}


def test_milliseconds_are_rounded_away_from_1970(spark):
    rows = spark.sql("select cast(c1 as timestamp_ntz) as ts, c2 as want from values ('1970-01-01 00:00:00.001499', 1), ('1970-01-01 00:00:00.0015', 2), ('1969-12-31 23:59:59.9986', -1), ('1969-12-31 23:59:59.9985', -2), ('1970-01-01 00:00:00', 0), ('2024-01-10 21:15:40.290500', 1704921340291) as t(c1, c2)")
    assert all(r["got"] == r["want"] for r in rows.select(src.epoch_ms("ts").alias("got"), "want").collect())
