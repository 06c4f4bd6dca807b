"""Whole reports: JSON entries, the order of the text, scopes; hot names and paths with an apostrophe."""

import datetime as dt
import json

from pyspark.sql import functions as F

from factloom.operators import documents, graph, impact, skew
from factloom.sources import readers

EDGES = "`from` string, `to` string, kind string, confidence string"


def test_check_document(spark):
    changes = spark.createDataFrame([("a", "changed", True, [("throws", "0", "1")]), ("b", "changed", False, [("calls", None, "x")]), ("c", "added", True, []), ("d", "unchanged", False, [])], "identity string, change_type string, significant boolean, changes array<struct<property:string,before:string,after:string>>")
    edges = spark.createDataFrame([("u", "a", "call", "certain"), ("v", None, "call", "unresolved")], EDGES)
    head, entries = documents.check_document(changes, edges, "proj", "now")
    assert json.loads(head.first()["report"]) == {"schema": 1, "generatedAt": "now", "project": "proj", "summary": {"changes": 3, "significant": 2, "insignificant": 1, "added": 1, "deleted": 0}}
    told = {r["identity"]: json.loads(r["entry"]) for r in entries.collect()}
    assert told["a"] == {"identity": "a", "type": "changed", "significant": True, "delta": {"throws": {"before": "0", "after": "1"}}, "impact": {"affected": [{"identity": "u", "depth": 1, "kind": "call", "confidence": "certain"}], "unresolved": 1, "truncated": False}}
    assert set(told) == {"a", "b", "c"} and "impact" not in told["b"] and told["c"]["impact"]["affected"] == []


def test_verify_document_and_lines(spark):
    rows = [(2, "b", "drifted", "x|y", None, dt.datetime(2024, 1, 1), ["w\nz"], [], ["layer"]), (1, "a", "drifted", "i", "me", None, [], [], []), (3, "c", "error", None, None, None, [], ["gone"], []), (4, "d", "implemented", None, None, None, [], [], [])]
    results = spark.createDataFrame(rows, "seq long, identity string, status string, intent string, approved_by string, approved_at timestamp, violations array<string>, errors array<string>, unsupported array<string>")
    edges = spark.createDataFrame([("u", "b", "call", "certain"), ("t", "u", "call", "inferred")], EDGES)
    head, entries = documents.verify_document(results, edges, "proj", "now")
    assert json.loads(head.first()["report"])["summary"] == {"approved": 4, "verified": 1, "drifted": 2, "errors": 1, "unsupported": 1}
    assert [e["identity"] for e in json.loads(entries.where("identity = 'b'").first()["entry"])["impact"]] == ["u", "t"]
    lines = documents.verify_report_lines(impact.impact_of_results(results, edges), "proj", "now", F.lit("2024-01-03 00:00:00").cast("timestamp"))
    text = "\n".join(r["line"] for r in lines.orderBy("section", "seq", "place").collect()).rstrip()
    assert text == """# Verify

Project: `proj`
Generated: `now`

## Summary

| Status | Count |
|---|---:|
| Approved | 4 |
| Verified | 1 |
| Drifted | 2 |
| Errors | 1 |
| Unsupported | 1 |

## Drifted

### `a`

**Intent:** i
**Approver:** me
**Approved:** unknown date

### `b`

**Intent:** x\\|y
**Approver:** unknown
**Approved:** 2 days ago

| Violation |
|---|
| w z |

| Impact | Confidence |
|---|---|
| u | certain |
| t | inferred |

## Errors

### `c`

- gone

## Unsupported

- `b`: layer"""


def test_a_name_that_everything_calls(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 10)
    calls = spark.range(500).selectExpr("'get' as callee", "'c' || id as caller").unionByName(spark.createDataFrame([("run", "x"), ("none", "x")], "callee string, caller string"))
    declared = spark.createDataFrame([("f::get", "get"), ("f::run", "run"), ("g::run", "run")], "identity string, name string")
    got = graph.resolve_names(calls, declared)
    assert {tuple(r) for r in got.where("caller = 'x'").collect()} == {("x", "run", "ambiguous"), ("x", "none", "unresolved")} and got.where("to = 'f::get' and confidence = 'certain'").count() == 500
    gone = spark.createDataFrame([("old::get", "get", 1)], "identity string, name string, seq long")
    edges = calls.select(F.col("caller").alias("from"), F.col("callee").alias("to"))
    assert graph.reanchor_deleted(edges, gone).where("to = 'old::get'").count() == 500 and graph.reanchor_deleted(edges, gone).count() == 502
    many = spark.range(300).selectExpr("'m::f' || id as identity", "'m' as file", "'f' || id as name", "array('get', 'f' || (id + 1)) as calls").unionByName(spark.createDataFrame([("m::get", "m", "get", [])], "identity string, file string, name string, calls array<string>"))
    assert graph.resolve_calls(many).count() == 300 + 299


def test_a_root_with_an_apostrophe(spark, tmp_path):
    root = tmp_path / "it's"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("x = 1\n")
    assert [r["path"] for r in readers.source_files(spark, str(root)).collect()] == ["src/a.py"]
