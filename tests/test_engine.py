"""Operators on hand-written rows, readers and extraction."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import extract
from factloom.operators import diff, events, graph, rules
from factloom.sources import readers, writers


def test_diff_last_wins_and_missing_sides(spark):
    before = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("gone", 1, 3), ("same", 5, 4)], "identity string, x int, seq int")
    after = spark.createDataFrame([("a", 3, 1), ("new", 1, 2), ("same", 5, 3)], "identity string, x int, seq int")
    got = {r["identity"]: (r["change_type"], [tuple(c) for c in r["changes"]]) for r in diff.diff_snapshots(before, after, {"x": F.col("x")}).collect()}
    assert got == {"a": ("changed", [("x", "2", "3")]), "gone": ("deleted", []), "new": ("added", []), "same": ("unchanged", [])}


def test_noise_and_significance(spark):
    rows = [("calls", "console.a,f", "logger.b,f", False), ("calls", "console.a", "save", True), ("throws", "0", "1", True), ("numbers", "1", "2", True), ("shape", "a", "b", False), ("calls", "a,b", "b,a", False)]
    df = spark.createDataFrame(rows, "p string, b string, a string, expected boolean")
    assert all(r[0] == r[1] for r in df.select("expected", diff.is_property_significant(F.col("p"), F.col("b"), F.col("a"))).collect())


def test_static_check_agrees_with_evaluation(spark):
    facts = "struct<throws:int,params:int,calls:array<string>,numbers:array<int>>"
    rows = [((1, 2, ["f"], [3]), None, (f, o, 1.0, "f")) for f in (*rules.NUMERIC_FIELDS, *rules.LIST_FIELDS, "odd") for o in (*rules.NUMERIC_OPERATORS, *rules.LIST_OPERATORS, "unchanged", "odd")]
    df = spark.createDataFrame(rows, f"facts {facts}, approved {facts}, clause struct<field:string,op:string,value_num:double,value_str:string>")
    for r in rules.evaluate(df).withColumn("problem", rules.clause_problem(F.col("clause.field"), F.col("clause.op"))).collect():
        if r["clause"]["field"] not in ("throws", "params", "calls", "numbers"):
            assert r["error"] == "field absent"
        elif r["clause"]["op"] == "unchanged":
            assert r["error"] == "no snapshot"
        else:
            assert r["error"] == r["problem"] and (r["pass"] is None) == (r["error"] is not None)


def test_impact(spark):
    edges = spark.createDataFrame([("b", "a", "call", "certain"), ("c", "b", "call", "certain"), ("d", "c", "call", "certain"), ("a", "d", "call", "certain"), ("x", None, "call", "unresolved")], "`from` string, `to` string, kind string, confidence string")
    assert {tuple(r) for r in graph.impact_levels(edges, "a").collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert {tuple(r) for r in graph.impact_levels(edges, "a", 2).collect()} == {("b", 1), ("c", 2)}
    one = graph.impact_capped(edges, "a", max_results=1).collect()
    assert [(r["id"], r["truncated"]) for r in one] == [("b", True)]
    assert [r["truncated"] for r in graph.impact_capped(edges, "a").collect()] == [False] * 3
    assert graph.impact_levels(edges, "nobody").count() == 0


def test_calls_resolve_by_uniqueness_and_file(spark):
    rows = [("f::go", "f", "go", ["svc.run", "missing.x", "go", "twice"]), ("f::run", "f", "run", []), ("f::twice", "f", "twice", []), ("g::twice", "g", "twice", []), ("g::other", "g", "other", ["console.log", "a.b.run"]), ("h::lone", "h", "lone", ["twice"])]
    got = {tuple(r) for r in graph.resolve_calls(spark.createDataFrame(rows, "identity string, file string, name string, calls array<string>")).collect()}
    assert got == {("f::go", "f::run"), ("f::go", "f::twice"), ("g::other", "f::run")}


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_log_operators(spark):
    log = spark.createDataFrame([(1, "a", "A", at(0)), (2, "a", "A", at(1)), (3, "b", "A", at(2)), (4, "a", "B", at(6)), (5, "a", "A", at(20))], "seq long, identity string, delta string, ts timestamp")
    assert [r[0] for r in events.dedupe_consecutive(log, ["delta"]).orderBy("seq").collect()] == [1, 3, 4, 5]
    groups = {r["seq"]: r["grp"] for r in events.time_groups(log.where("identity = 'a'"), 5, "identity").collect()}
    assert groups == {1: 1, 2: 1, 4: 2, 5: 3}
    deltas = spark.createDataFrame([(1, "x", 200, 201), (2, "x", 201, 203), (3, "y", 1, 2), (4, "y", 2, 1)], "seq long, identity string, before int, after int")
    assert [tuple(r) for r in events.net_delta(deltas, ["identity"]).collect()] == [("x", 200, 203, 2)]


def test_sessions_seal_by_cap_and_idle(spark):
    rows = [("p", i, at(0), f"i{i}") for i in range(25)] + [("p", 25, at(29), "z"), ("p", 26, at(59), "z"), ("q", 1, at(0), "i")]
    got = {(r["key"], r["seq"]): r["session"] for r in events.capped_sessions(spark.createDataFrame(rows, "key string, seq long, ts timestamp, identity string"), "key", "identity").collect()}
    assert [got["p", i] for i in (0, 19, 20, 24, 25, 26)] == [1, 1, 2, 2, 2, 3] and got["q", 1] == 1


PYTHON = '''
class Box:
    async def get(self, a, *, b=1):
        if a: raise KeyError("x")
        try:
            return await self.load(a)
        except Exception:
            pass
        return None
    @classmethod
    def make(cls, x): return Box(1.5)
def outer():
    def inner():
        return 7
    return inner()
'''

SCRIPT = """
// limit
const LIMIT = 5;
class Store extends Base {
  constructor(a, b) { this.a = a; }
  async save(item, opts = {x: 1}) {
    if (!item) { throw new errors.Missing("no item"); }
    try { await this.db.put(item, 3600); } catch (e) {}
    return null;
  }
}
export function load(id: string): Promise<number> { const f = (x) => { return x * 2; }; return api.get(id) }
const pick = async (a, b) => { return undefined; };
"""


def test_extraction():
    rows = {r[1]: dict(zip([c.split(" ")[0] for c in extract.SCHEMA.split(", ")], r, strict=True)) for r in extract.declarations_of("m.py", PYTHON)}
    get = rows["m.py::Box.get:method"]
    assert (get["throws"], get["throw_types"], get["returns"], get["returns_nullish"], get["awaits"], get["catches"], get["empty_catches"], get["params"]) == (1, ["KeyError"], 2, 1, 1, 1, 1, 2)
    assert get["calls"] == ["KeyError", "self.load"] and rows["m.py::Box.make:method"]["params"] == 1 and rows["m.py::Box.make:method"]["numbers"] == [1.5]
    assert rows["m.py::outer.inner:function"]["numbers"] == [7.0] and rows["m.py::outer:function"]["numbers"] == []
    js = {r[1]: dict(zip([c.split(" ")[0] for c in extract.SCHEMA.split(", ")], r, strict=True)) for r in extract.declarations_of("s.ts", SCRIPT)}
    save = js["s.ts::Store.save:method"]
    assert (save["throws"], save["throw_types"], save["returns"], save["returns_nullish"], save["awaits"], save["catches"], save["empty_catches"], save["params"]) == (1, ["errors.Missing"], 1, 1, 1, 1, 1, 2)
    assert 3600.0 in save["numbers"] and js["s.ts::load:function"]["calls"] == ["api.get"] and js["s.ts::pick:function"]["params"] == 2 and "s.ts::load.f:function" in js
    twice = extract.declarations_of("d.py", "def a(): pass\ndef a(): return 1\n")
    assert [r[1] for r in twice] == ["d.py::a:function", "d.py::a:function#2"]
    assert extract.declarations_of("bad.py", "def (")[0][-1] and extract.declarations_of("bad.js", "function f( {")[0][-1]
    with pytest.raises(ValueError):
        extract.declarations_of("x.rb", "")


def test_readers(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name, text in (("src/a.py", "def f(): return None\n"), ("src/b.d.ts", "x"), ("src/node_modules/c.js", "x"), ("src/broken.js", "function ("), ("src/e.JS", "function g() { return 1; }")):
        (tmp_path / name).write_text(text)
    files = readers.source_files(spark, str(tmp_path))
    assert {r["path"] for r in files.collect()} == {"src/a.py", "src/broken.js", "src/e.JS"}
    rows = extract.extract_declarations(files).collect()
    assert {r["identity"] for r in rows if not r["failed"]} == {"src/a.py::f:function", "src/e.JS::g:function"} and [r["file"] for r in rows if r["failed"]] == ["src/broken.js"]
    log = tmp_path / "log.jsonl"
    log.write_text('{"ts":"t","identity":"a","type":"added"}\n\n{oops\n{"ts":"u","identity":"b","type":"changed","delta":{"x":["1","2"]}}\n')
    good, bad = readers.read_events(spark, str(log))
    assert {r["identity"] for r in good.collect()} == {"a", "b"} and bad.count() == 1
    snap = tmp_path / "snap.json"
    snap.write_text(json.dumps({"version": 2, "declarations": [{"identity": "a", "file": "f", "kind": "function", "properties": {"throws": 1}}]}))
    assert readers.read_snapshot(spark, str(snap)).count() == 1
    snap.write_text(json.dumps({"version": 1, "declarations": []}))
    with pytest.raises(ValueError):
        readers.read_snapshot(spark, str(snap))
    assert readers.read_document(spark, str(tmp_path / "none.json"), {}) == {}
    assert readers.merged_config({"significance": {"noise": ["x"]}}, {"significance": {"noise": [], "k": 1}}) == {"significance": {"noise": ["x"], "k": 1}}
    assert writers.append_initial(spark.createDataFrame([("a",)], "identity string"), good, str(tmp_path / "out"), "t") is False


def test_reports(spark):
    rows = spark.createDataFrame([("a", "added", True), ("b", "changed", False), ("c", "unchanged", False)], "identity string, change_type string, significant boolean")
    report = writers.check_report(rows).first()
    assert json.loads(report["report"]) == {"total": 2, "significant": 1, "insignificant": 1, "added": 1, "deleted": 0, "changed": 1} and report["exit_code"] == 1
    lines = [r["line"] for r in writers.verify_markdown(spark.createDataFrame([(i, "drifted", 2) for i in range(1500)] + [(7, "error", 0)], "node_id long, status string, n_violations long")).collect()]
    assert lines[:3] == ["# Verification", "## drifted", "- 0: 2 violations"] and lines[-2:] == ["## error", "- 7: 0 violations"] and len(lines) == 1504


def test_numbers_contain_numbers(spark):
    facts = "struct<throws:int,params:int,calls:array<string>,numbers:array<double>>"
    clauses = [("numbers", "contains", 3.0, None), ("numbers", "notContains", 3.0, None), ("numbers", "contains", None, "3"), ("calls", "contains", None, "f"), ("calls", "contains", 1.0, None)]
    df = spark.createDataFrame([((1, 2, ["f"], [3.0]), None, c) for c in clauses], f"facts {facts}, approved {facts}, clause struct<field:string,op:string,value_num:double,value_str:string>")
    assert [(r["error"], r["pass"]) for r in rules.evaluate(df).collect()] == [(None, True), (None, False), ("type mismatch", None), (None, True), ("type mismatch", None)]


def test_noise_is_a_prefix(spark):
    df = spark.createDataFrame([("console",), ("console.",), ("console.log",), ("log.x",), ("debug.a",)], "c string")
    assert [r[0] for r in df.select(diff.is_noise_call(F.col("c"))).collect()] == [False, True, True, False, True]
    assert [r[0] for r in df.select(diff.is_noise_call(F.col("c"), ["log."])).collect()] == [False, False, False, True, False]
    assert [r[0] for r in df.select(diff.is_noise_call(F.col("c"), [])).collect()] == [False, True, True, False, True]


def test_ids_do_not_collide(spark):
    ids = spark.createDataFrame([(1,), (9999,), (10000,), (100000000,), (1000000001,)], "n long").select(events.numbered_id("n_", F.col("n"))).collect()
    assert [r[0] for r in ids] == ["n_0001", "n_9999", "n_10000", "n_100000000", "n_1000000001"]
