"""Stores of buckets and segments: order, costs, failures, conflicts and round trips."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.sources import readers, store, writers

EVENTS = "seq long, ts string, identity string, type string"


def rows_of(spark, path):
    good, bad = readers.read_events(spark, path)
    assert bad.count() == 0
    return [(r["seq"], r["identity"], r["type"]) for r in good.orderBy("seq").collect()]


def test_order_survives_single_appends(spark, tmp_path):
    path, told = str(tmp_path / "log"), ["changed", "deleted", "added", "deleted", "deleted", "changed"]
    n = [writers.append_changes(spark.createDataFrame([(0, f"t{i}", "a", kind)], EVENTS), path, ["type"]) for i, kind in enumerate(told)]
    assert n == [1, 1, 1, 1, 0, 1]
    assert rows_of(spark, path) == [(i, "a", kind) for i, kind in enumerate(["changed", "deleted", "added", "deleted", "changed"])]


def test_many_appends_read_the_index_only(spark, tmp_path):
    path, expected = str(tmp_path / "log"), []
    log = store.EventLog(spark, path, ["type"], buckets=4)
    for i in range(12):
        rows = [(k, "t", f"i{(i + k) % 5}", "added" if (i + k) % 2 else "changed") for k in range(6)]
        before = {}
        for _, identity, kind in expected:
            before[identity] = kind
        for _, _, identity, kind in rows:
            if before.get(identity) != kind:
                before[identity] = kind
                expected.append((len(expected), identity, kind))
        if i == 11:  # the log itself is not needed for an append
            os.rename(f"{path}/segments", f"{path}/away")
        log.append(spark.createDataFrame(rows, EVENTS))
    for name in os.listdir(f"{path}/away"):
        os.rename(f"{path}/away/{name}", f"{path}/segments/{name}")
    assert rows_of(spark, path) == expected
    assert len(os.listdir(f"{path}/index/manifests")) <= 2 * store.KEPT  # with checksum files


def test_plain_log_is_taken_in(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"ts":"t","identity":"a","type":"added"}\n{"ts":"t","identity":"b","type":"added"}\n')
    assert writers.append_changes(spark.createDataFrame([(0, "u", "a", "added"), (1, "u", "b", "deleted")], EVENTS), str(folder), ["type"]) == 1
    assert rows_of(spark, str(folder)) == [(0, "a", "added"), (1, "b", "added"), (2, "b", "deleted")]


def test_initial_events_and_markers(spark, tmp_path):
    path = str(tmp_path / "log")
    none = spark.createDataFrame([], EVENTS)
    assert writers.append_initial(spark.createDataFrame([("b",), ("a",)], "identity string"), none, path, "t")
    writers.append_marker(spark, path, "session_started", "s1", "u")
    assert writers.append_changes(spark.createDataFrame([(5, "v", "a", "added"), (6, "v", "b", "changed")], EVENTS), path, ["type"]) == 1
    assert rows_of(spark, path) == [(0, "a", "added"), (1, "b", "added"), (2, None, "session_started"), (3, "b", "changed")]


def test_update_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "plan")
    assert store.read_rows(spark, path) is None
    every = spark.range(2000).selectExpr("id", "cast(id % 7 as int) as v")
    assert len(store.update_rows(every, path, buckets=64)) == 64
    ten = spark.createDataFrame([(i * 191, -1) for i in range(9)] + [(5000, -1)], "id long, v int")
    assert len(store.update_rows(ten, path)) <= 10
    got = {r["id"]: r["v"] for r in store.read_rows(spark, path).collect()}
    assert got == {i: i % 7 for i in range(2000)} | {i * 191: -1 for i in range(9)} | {5000: -1}
    assert {r["id"] for r in readers.read_evolution(spark, path).collect()} == set(got)


def test_failed_and_doubled_writes_leave_the_version_before(spark, tmp_path):
    path = str(tmp_path / "plan")
    one = store.BucketStore(spark, path, "id", 4)
    one.upsert(spark.range(10).selectExpr("id", "'x' as v"))
    with pytest.raises(Exception, match="broken"):
        one.upsert(spark.range(10).select("id", F.when(F.col("id") < 20, F.raise_error(F.lit("broken"))).cast("string").alias("v")))
    assert {r["v"] for r in one.read().collect()} == {"x"}
    with pytest.raises(ValueError, match="repeated"):
        one.upsert(spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string"))
    seen = one.state()
    one.upsert(spark.createDataFrame([(1, "first")], "id long, v string"), state=seen)
    with pytest.raises(store.Conflict):
        one.upsert(spark.createDataFrame([(1, "second")], "id long, v string"), state=seen)
    assert one.read().where("id = 1").first()["v"] == "first" and one.read().count() == 10
    with open(f"{path}/manifests/99999999.json", "w") as cut:
        cut.write('{"version": 99')
    assert one.read().count() == 10
    os.remove(f"{path}/manifests/99999999.json")
    assert len(one.vacuum()) == 1 and one.read().count() == 10  # the bucket of the write that came second


def test_sessions_and_history_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 3, ["a"], (1, "x")), ("s2", None, [], (2, None))], "id string, n long, names array<string>, d struct<k:long,v:string>")
    writers.write_sessions(rows, str(tmp_path / "s"))
    assert sorted(map(str, readers.read_sessions(spark, str(tmp_path / "s"), "id string, n long, names array<string>, d struct<k:long,v:string>").collect())) == sorted(map(str, rows.collect()))
    told = {r["id"]: (r["n"], r["names"], r["d"]["k"]) for r in readers.read_sessions(spark, str(tmp_path / "s")).collect()}
    assert told == {"s1": (3, ["a"], 1), "s2": (None, [], 2)}
    history = spark.createDataFrame([(2, "b"), (1, "a")], "seq long, id string")
    writers.write_evolution(history, str(tmp_path / "e"))
    assert sorted((r["seq"], r["id"]) for r in readers.read_evolution(spark, str(tmp_path / "e")).collect()) == [(1, "a"), (2, "b")]
    assert readers.read_sessions(spark, str(tmp_path / "none")) is None and readers.read_evolution(spark, str(tmp_path / "none")) is None
    (tmp_path / "odd").write_text('{"id": "a"}\n{"id": \n')
    assert [r["id"] for r in readers.read_sessions(spark, str(tmp_path / "odd")).collect()] == ["a"]
    with pytest.raises(ValueError):
        readers.read_evolution(spark, str(tmp_path / "odd"))
