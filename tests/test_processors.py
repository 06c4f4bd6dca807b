"""Stateful processors against their batch counterparts: shuffled arrival, idle seals, controls, batches, removals, late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import events
from factloom.streaming import processors

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def run(spark, folder, rows, schema, job, name, size=60):
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.json(str(folder / "in" / f"b{k:05d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(folder / "in"))
    query = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    query.stop()
    return spark.table(name).collect()


def shuffled(rows, r, reach):
    """The rows in an order in which none comes ``reach`` places too late."""
    return [x for _, x in sorted((i + r.random() * reach, x) for i, x in enumerate(rows))]


SESSIONS = "key string, seq long, ts timestamp, who string, kind string, batch string"


def test_sessions_equal_batch_and_idle_ones_end(rocks, tmp_path):
    r, now, rows = random.Random(3), START, []
    for i in range(300):
        now += dt.timedelta(minutes=r.choice([0, 1, 1, 2, 31]) if i % 25 == 0 else r.choice([0, 1]))
        kind = r.choice([None] * 70 + ["commit", "manual", "branch-switch"])
        rows.append((r.choice("ab"), None if kind else i, now, None if kind else f"i{r.randrange(60)}", kind, None))
    end = now + dt.timedelta(days=1)
    rows.append(("clock", 10**6, end, "x", None, None))  # another key's event moves the watermark
    given = shuffled(rows[:-1], r, 25) + rows[-1:]
    got = {(x["key"], x["seq"]): (x["session"], x["sealed_by"]) for x in run(rocks, tmp_path, given, SESSIONS, lambda s: processors.watched_sessions(s.withWatermark("ts", "3 hours"), "key", "who"), "live_sessions")}
    frame = rocks.createDataFrame(rows, SESSIONS)
    expected = {(x["key"], x["seq"]): (x["session"], x["sealed_by"]) for x in events.watched_sessions(frame.where("kind is null").drop("kind"), frame.where("kind is not null"), "key", "who").collect()}
    last = {k: v for k, v in expected.items() if v[1] == "open"}
    assert {k for k, _ in last} == {"a", "b", "clock"} or {k for k, _ in last} >= {"clock"}
    assert got == {k: (n, "idle" if by == "open" else by) for k, (n, by) in expected.items() if k[0] != "clock"}
    assert {by for _, by in got.values()} >= {"cap", "idle", "git", "manual"}


def test_a_batch_is_atomic(rocks, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [("a", i, at(0), f"i{i}", None, "one") for i in range(25)] + [("a", 30, at(1), "x", None, None), ("a", None, at(2), None, "commit", None), ("z", 99, at(2000), "x", None, None)]
    got = {x["seq"]: (x["session"], x["sealed_by"]) for x in run(rocks, tmp_path, rows, SESSIONS, lambda s: processors.watched_sessions(s.withWatermark("ts", "1 minute"), "key", "who", "batch"), "atomic_sessions")}
    assert got == {i: (1, "cap") for i in range(25)} | {30: (2, "git")}


FEED = "file string, seq long, ts timestamp, op string, facts map<string,string>"


def test_file_changes_equal_batch(rocks, tmp_path):
    r, now, rows = random.Random(8), START, []
    for i in range(260):
        now += dt.timedelta(seconds=r.choice([0, 1, 5, 40]))
        op = r.choice(["add", "change", "change", "unlink"])
        facts = {x: str(r.randrange(2)) for x in "pqr" if r.random() < 0.7}
        rows.append((f"f{r.randrange(5)}", i, now, op, None if op == "unlink" else facts))
    rows.append(("clock", 10**6, now + dt.timedelta(hours=5), "add", {}))
    baseline = rocks.createDataFrame([("f0", {"p": "0", "q": "1"}), ("f1", {}), ("f2", {"p": "1"}), ("f9", {"z": "0"})], "file string, facts map<string,string>")
    job = lambda s: processors.file_changes(s.withWatermark("ts", "30 minutes"), baseline, 10)
    got = sorted((x["file"], x["seq"], x["ts"], x["identity"], x["type"]) for x in run(rocks, tmp_path, shuffled(rows[:-1], r, 20) + rows[-1:], FEED, job, "live_files"))
    batch = events.file_changes(rocks.createDataFrame(rows, FEED), baseline, 10)
    assert got == sorted((x["file"], x["seq"], x["ts"], x["identity"], x["type"]) for x in batch.collect()) and {x[4] for x in got} == {"added", "deleted", "changed"}


def test_file_change_rules(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("f", 1, at(0), "change", {"p": "1"}), ("f", 2, at(1), "change", {"p": "2"}), ("f", 3, at(20), "change", {"p": "3"}), ("f", 4, at(21), "unlink", None), ("f", 5, at(40), "unlink", None), ("f", 6, at(60), "add", {"p": "2", "q": "0"}), ("new", 7, at(0), "add", {"x": "1"}), ("new", 8, at(30), "unlink", None), ("new", 9, at(60), "add", {"x": "1"})]
    baseline = spark.createDataFrame([("f", {"p": "0", "b": "0"})], "file string, facts map<string,string>")
    got = sorted((x["file"], x["seq"], x["identity"], x["type"]) for x in events.file_changes(spark.createDataFrame(rows, FEED), baseline, 10).collect())
    # 1 and 3 never count; 4 deletes what the baseline has; 5 changes nothing; 6 is compared with what 2 showed; 8 has no baseline.
    assert got == [("f", 2, "b", "deleted"), ("f", 2, "p", "changed"), ("f", 4, "b", "deleted"), ("f", 4, "p", "deleted"), ("f", 6, "q", "added"), ("new", 7, "x", "added")]


def test_time_groups_with_late_rows(rocks, tmp_path):
    r, now, rows = random.Random(11), START, []
    for i in range(240):
        now += dt.timedelta(minutes=r.choice([0, 1, 3, 12]))
        rows.append((r.choice("ab"), i, now))
    late = [(k, 1000 + i, START - dt.timedelta(days=1)) for i, k in enumerate("ab")]
    ends = [(k, 2000 + i, now + dt.timedelta(days=9)) for i, k in enumerate("ab")]
    given = shuffled(rows, r, 15)
    given = given[:150] + given[145:150] + given[150:] + late + ends  # five rows come twice while they wait
    schema = "key string, seq long, ts timestamp"
    for k in range(0, len(given), 50):
        rocks.createDataFrame(given[k : k + 50], schema).coalesce(1).write.json(str(tmp_path / "in" / f"b{k:05d}"))
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    query = processors.split_late(processors.time_groups(stream, 10, "key", 4 * 3600), str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "ck"))
    query.awaitTermination(200)
    got = sorted((x["key"], x["seq"], x["grp"]) for x in rocks.read.parquet(str(tmp_path / "out")).collect())
    batch = events.time_groups(rocks.createDataFrame(rows, schema), 10, "key")
    assert got == sorted((x["key"], x["seq"], x["grp"]) for x in batch.collect())
    assert sorted(x["seq"] for x in rocks.read.parquet(str(tmp_path / "late")).where(F.col("seq") >= 1000).collect()) == [1000, 1001]
    assert rocks.read.parquet(str(tmp_path / "late")).count() == 2
