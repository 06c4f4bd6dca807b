"""Plan edits, validation, sinks and watched logs on hand-written rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import authoring, events, evolution, planning, reports, rules, trees, validation, views
from factloom.sources import readers, writers


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


PLAN = {"version": 1, "lenses": [{"id": "a", "label": "b"}], "features": [{"id": "f", "name": "n"}], "nodes": [{"id": "plan_0001", "title": "t", "intent": "i", "identity": "x", "identities": ["x", "y"], "merge": "family"}]}


def test_plan_documents(spark):
    node = {
        "id": "a", "title": "t", "intent": "i", "version": 0, "identities": ["x", "y"], "identity": "z", "merge": "odd", "summaryOf": [{"identities": ["q"], "title": ""}, 3], "step": 1.5, "path": ["a", 2],
        "rules": [{"kind": "behaviour", "target": "x", "assert": {"throws": {"op": "like"}, "odd": {}, "calls": {"op": "unchanged"}, "params": 3}}, {"kind": "structure", "target": "x", "assert": {"mustImport": 3, "zzz": "a"}}],
        "approvedFactsByIdentity": {"n": {}, "x": 4}, "status": "bad", "origin": None,
    }
    documents = [json.dumps(PLAN), json.dumps({"version": 2, "lenses": {}, "nodes": [{"id": "", "title": "t", "intent": " "}]}), "5", "no json", json.dumps({"version": 1, "lenses": [{"id": "a", "label": "b", "source": "x"}], "features": [7], "nodes": [node]})]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in documents], "d string").select(validation.plan_problems(F.col("d"))).collect()]
    assert got[0] == [] and got[2] == got[3] == ["plan must be an object"]
    assert got[1] == ["version must be 1", "lenses must be an array", "features must be an array", "nodes[0].id must be a non-empty string", "nodes[0].intent must be a non-empty string"]
    assert got[4] == [
        "lenses[0].source must be derived or human_added", "features[0] must be an object", "nodes[0].version must be a positive integer", "nodes[0].identities[0] must be the node's own identity", "nodes[0].merge must be family or summary",
        "nodes[0].summaryOf[0].identities includes q, which the node does not stand for", "nodes[0].summaryOf[0].title must be a non-empty string", "nodes[0].summaryOf[1] must be an object", "nodes[0].step must be a positive integer",
        "nodes[0].path must be an array of strings", "nodes[0].rules[0].assert.odd is not a supported fact field", "nodes[0].rules[0].assert.params must be an object", "nodes[0].rules[0].assert.throws.op is not supported",
        "nodes[0].rules[0].assert.throws.value is required", "nodes[0].rules[1].assert.mustImport must be a string or array", "nodes[0].rules[1].assert.zzz is not a supported structure assertion", "nodes[0].status is invalid",
        "nodes[0].origin is invalid", "nodes[0].approvedFactsByIdentity has n, which the node does not stand for", "nodes[0].approvedFactsByIdentity.x must be an object",
    ]


def test_sinks_round_trip(spark, tmp_path):
    declared = spark.createDataFrame([("b", "f", "function", (1, ["X"], 0, 0, [], [1.5], 0, 0, 0, 2)), ("a", "f", "function", (0, [], 0, 0, ["c"], [], 0, 0, 0, 0))], f"identity string, file string, kind string, properties {readers.SNAPSHOT_LINE.split('properties ')[1]}")
    for _ in range(2):
        writers.write_snapshot(declared, str(tmp_path / "snap"))
    back = readers.read_snapshot(spark, str(tmp_path / "snap"))
    assert sorted(map(str, back.collect())) == sorted(map(str, declared.collect()))
    log, path = spark.createDataFrame([(0, "t", "a", "added"), (1, "t", "a", "added"), (2, "u", "b", "changed")], "seq long, ts string, identity string, type string"), str(tmp_path / "log")
    assert writers.append_changes(log, path, ["type"]) == 2 and writers.append_changes(log, path, ["type"]) == 0
    assert writers.append_changes(log.withColumn("type", F.lit("deleted")), path, ["type"]) == 2
    writers.append_marker(spark, path, "session_sealed", "s1", "z", "git", "abc")
    with pytest.raises(ValueError):
        writers.append_marker(spark, path, "odd", "s1", "z")
    good, bad = readers.read_events(spark, path)
    rows = good.orderBy("seq").collect()
    assert bad.count() == 0 and len(rows) == 5 and [r["seq"] for r in rows] == list(range(5)) and {r["commit"] for r in rows} == {None, "abc"}
    writers.write_plan(spark.createDataFrame([(json.dumps(PLAN),)], "document string"), str(tmp_path / "plan"))
    assert readers.read_document(spark, str(tmp_path / "plan"), None) == PLAN
    with pytest.raises(ValueError, match="version must be 1"):
        writers.write_plan(spark.createDataFrame([("{}",)], "document string"), str(tmp_path / "plan"))
    assert writers.read_graph(spark, str(tmp_path / "none")) is None
    nodes, edges = spark.createDataFrame([("a", "function", "a", "f")], "id string, kind string, name string, file string"), spark.createDataFrame([("a", None, "call", "unresolved", None)], "`from` string, `to` string, kind string, confidence string, reason string")
    writers.write_graph(nodes, edges, str(tmp_path / "graph"))
    got = writers.read_graph(spark, str(tmp_path / "graph"))
    assert got[0].collect() == nodes.collect() and got[1].collect() == edges.collect()
    plan, problems = readers.read_plan(spark, str(tmp_path / "plan"))
    assert plan == PLAN and problems == [] and readers.read_plan(spark, str(tmp_path / "none")) == (readers.EMPTY_PLAN, [])
    (tmp_path / "bad.json").write_text('{"version": 3}')
    assert readers.read_plan(spark, str(tmp_path / "bad.json"))[0] == readers.EMPTY_PLAN and "version must be 1" in readers.read_plan(spark, str(tmp_path / "bad.json"))[1]
    writers.write_sessions(spark.createDataFrame([("s1", 3)], "id string, n int"), str(tmp_path / "sessions"))
    writers.write_evolution(spark.createDataFrame([(1, "x")], "seq long, id string"), str(tmp_path / "evolution"))
    assert spark.read.json(str(tmp_path / "sessions")).count() == spark.read.json(str(tmp_path / "evolution")).count() == 1


def test_evolution_markdown_order(spark, tmp_path):
    schema = "id long, parent long, feature string, ts timestamp, label string, type string, identity string, tags array<string>, delta string"
    rows = [(1, None, "b", at(2), "one", None, None, [" t ", "u"], None), (2, 1, "b", at(9), "later", None, None, None, ""), (3, 1, "c", at(3), "sooner", None, None, [], " x → y "), (4, None, "a", at(7), "four", None, None, None, None),
            (5, 3, "b", at(8), "", "deleted", "a.js::f", None, None), (6, None, "", at(1), None, None, None, None, None), (7, 99, "a", at(1), "orphan", None, None, None, None), (8, 8, "a", at(1), "loop", None, None, None, None)]
    rows = spark.createDataFrame(rows, schema)
    writers.write_evolution_markdown(rows, str(tmp_path / "md"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines == ["# Project Evolution", "", "- **a**", "  - four", "", "- **b**", "  - one `t` `u`", "    - sooner", "      - x → y", "      - Removed f", "    - later", "", "- **Unclassified**", "  - unknown"]


def test_reading_order_of_a_deep_chain_and_a_wide_row(spark):
    deep = spark.range(500).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    wide = spark.range(500, 2000).select("id", F.when(F.col("id") > 500, F.lit(500)).alias("up"))
    rows = deep.unionByName(wide).withColumn("ts", -F.col("id"))
    got = {r["id"]: r for r in trees.preorder(rows, ["ts"]).collect()}
    assert [got[i]["place"] for i in (500, 1999, 1998, 501, 0, 1, 499)] == [0, 1, 2, 1499, 1500, 1501, 1999]
    assert (got[499]["depth"], got[499]["root"], got[0]["size"], got[500]["size"], got[900]["size"]) == (499, 0, 500, 1500, 1)
    assert trees.preorder(rows.limit(0), ["ts"]).count() == 0


def test_steps_are_added_and_revised(spark):
    schema = "id string, seq long, feature string, title string, intent string, status string, origin string, step int, readings string"
    nodes = spark.createDataFrame([("plan_0001", 1, "f", "a", "a", "approved", "ai_drafted", 1, "r"), ("plan_0009", 2, "f", "b", "b", "intended", "ai_drafted", 2, "r"), ("x", 3, "g", "c", "c", "intended", "human_authored", None, "r")], schema)
    got = {r["id"]: r for r in authoring.add_step(nodes, "f", " New ", after="plan_0001").collect()}
    assert {i: r["step"] for i, r in got.items()} == {"plan_0001": 1, "plan_0010": 2, "plan_0009": 3, "x": None}
    assert (got["plan_0010"]["title"], got["plan_0010"]["intent"], got["plan_0010"]["origin"]) == ("New", "New.", "human_authored")
    assert {r["id"]: r["step"] for r in authoring.add_step(nodes, "f", "N").collect()}["plan_0010"] == 3
    with pytest.raises(ValueError):
        authoring.add_step(nodes, "f", " ")
    names = spark.createDataFrame([("f", "One", "derived"), ("g", "Two", "derived")], "id string, name string, source string")
    with pytest.raises(ValueError):
        authoring.rename_feature(names, "f", "Two")
    with pytest.raises(ValueError):
        authoring.move_steps(nodes.withColumns({"x": F.lit(1).cast("long"), "y": F.lit(1).cast("long")}), spark.createDataFrame([("x", float("nan"), 1.0)], "id string, x double, y double"))


def test_drafts_fail_closed(spark):
    rows = spark.createDataFrame([(i, f"d{i}" if i else "odd", "t", "i") for i in range(4)], "seq long, identity string, title string, intent string")
    asked = spark.createDataFrame([(f"d{i}",) for i in range(4)], "identity string")
    assert authoring.accept_draft(rows, asked).count() == 3
    with pytest.raises(ValueError):
        authoring.accept_draft(rows.where("seq < 3"), asked)
    with pytest.raises(ValueError):
        authoring.remap_draft(spark.createDataFrame([("a", 1)], "temp_id string, seq long"), spark.createDataFrame([("a", "b")], "`from` string, `to` string"), 1)


def test_controls_cut_sessions(spark):
    rows = [("p", i, at(i), f"i{i}") for i in range(3)] + [("p", 3, at(10), "a"), ("p", 4, at(20), "b"), ("p", 5, at(60), "c"), ("p", 6, at(61), "c")]
    controls = spark.createDataFrame([("p", at(2), "commit"), ("p", at(12), "branch-switch"), ("q", at(1), "commit")], "key string, ts timestamp, kind string")
    got = {r["seq"]: (r["session"], r["sealed_by"]) for r in events.watched_sessions(spark.createDataFrame(rows, "key string, seq long, ts timestamp, identity string"), controls, "key", "identity").collect()}
    assert got == {0: (1, "git"), 1: (1, "git"), 2: (1, "git"), 4: (2, "idle"), 5: (3, "open"), 6: (3, "open")}
    many = [("p", i, at(0), f"i{i}") for i in range(45)]
    got = {r["seq"]: (r["session"], r["sealed_by"]) for r in events.watched_sessions(spark.createDataFrame(many, "key string, seq long, ts timestamp, identity string"), controls.limit(0), "key", "identity").collect()}
    assert got[19] == (1, "cap") and got[20] == (2, "cap") and got[44] == (3, "open")


def test_one_shot_sessions_are_recorded_once(spark):
    entries = spark.createDataFrame([(1, "x"), (2, "y")], "seq long, entry string")
    sealed = spark.createDataFrame([("s0", "check", "x")], "session string, reason string, entry string")
    out = events.one_shot(entries, sealed, "s1", "check").collect()
    assert [(r["type"], r["entry"], r["session"]) for r in out] == [("session_started", None, "s1"), ("change", "x", "s1"), ("change", "y", "s1"), ("session_sealed", None, "s1")]
    again = sealed.unionByName(spark.createDataFrame([("s1", "check", "y"), ("s1", "check", "x")], "session string, reason string, entry string"))
    assert events.one_shot(entries, again, "s2", "check").count() == 0 and events.one_shot(entries, again, "s2", "other").count() == 4


def test_git_boundaries_and_ignored_paths(spark):
    polls = spark.createDataFrame([("p", at(0), "a", "main"), ("p", at(1), "b", "main"), ("p", at(2), "c", "dev"), ("p", at(3), "c", "dev")], "key string, ts timestamp, head string, branch string")
    assert [(r["ts"], r["kind"]) for r in readers.git_boundaries(polls, "key").orderBy("ts").collect()] == [(at(1), "commit"), (at(2), "branch-switch")]
    paths = [("a/b.ts", True, False), ("a/b.d.ts", True, True), ("a/b", None, False), ("a/b.md", True, True), ("node_modules/x.js", True, True), ("a/out/x.js", None, True), ("a/.DS_Store", None, True), (".DS_Store", False, False), ("rebuild/x.js", True, False)]
    df = spark.createDataFrame(paths, "path string, f boolean, expected boolean")
    assert all(r[0] == r[1] for r in df.select("expected", readers.should_ignore(F.col("path"), F.col("f"))).collect())
    assert spark.createDataFrame([("a/b.md",)], "path string").select(readers.should_ignore(F.col("path"))).first()[0] is False


def test_rule_targets(spark):
    nodes = spark.createDataFrame([(1, "a", ["a", "b"], 1, {"b": 2})], "id long, identity string, identities array<string>, approved int, approved_by_identity map<string,int>")
    asked = spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate([("behaviour", None), ("behaviour", "b"), ("behaviour", "z"), ("structure", "z"), ("odd", "a")])], "id long, place int, kind string, target string")
    got = {r["place"]: (r["target"], r["problem"], r["unsupported"], r["facts"], r["approved"]) for r in rules.rule_targets(nodes, asked, spark.createDataFrame([("a", 7)], "identity string, facts int")).collect()}
    assert got == {0: ("a", None, False, 7, 1), 1: ("b", "b is missing from the current project", False, None, None), 2: ("z", "rule target z does not match node identity a", False, None, None), 3: ("z", None, True, None, None)}


def test_vocabulary_is_the_plans_or_the_first_spelling(spark):
    seen = spark.createDataFrame([("Red", 2, True), ("RED", 1, True), ("blue", 0, False)], "word string, seq long, finished boolean")
    assert [r[0] for r in evolution.vocabulary(seen.limit(0), seen, "word").collect()] == ["RED"]
    assert [r[0] for r in evolution.vocabulary(spark.createDataFrame([("own",)], "word string"), seen, "word").collect()] == ["own"]


def test_change_feed(spark, tmp_path):
    rows = [(1, at(0), "src/a.ts", "add", "x"), (2, at(1), "node_modules/b.js", "add", "x"), (3, at(2), "src/a.ts", "unlink", None), (4, at(3), "a.md", "change", "x"), (5, at(3), "a.py", "odd", "x")]
    spark.createDataFrame(rows, readers.FEED).coalesce(1).write.json(str(tmp_path / "feed"))
    query = readers.change_feed(spark, str(tmp_path / "feed")).writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["seq"], r["op"]) for r in spark.table("feed").orderBy("seq").collect()] == [(1, "add"), (3, "unlink")]


def test_titles_and_names(spark):
    ids = F.array(F.lit("a.py::Store.load_all:method"), F.lit("a.py::run:function"))
    cases = [("Load the rows", None), ("", "empty"), (" ".join(["w"] * 13), "too long"), ("Run the job", "placeholder verb"), ("Running the job", None), ("The (LOAD_ALL) way", "names code"), ("The load_allx way", None), ("By Store.load_all", "names code")]
    df = spark.createDataFrame(cases, "title string, expected string")
    assert all(r[0] == r[1] for r in df.select("expected", planning.title_problem(F.col("title"), ids)).collect())


def test_outline_and_json(spark):
    rows = spark.createDataFrame([(1, "f", ["A", "B"]), (2, "f", ["A", "C"]), (3, "g", ["A", "B"]), (4, None, None), (5, "h", ["X", "Y", "Z"]), (6, "h", ["X", "Y"])], "id long, feature string, path array<string>")
    assert {r["id"]: r["shown"] for r in views.outline(rows).collect()} == {1: ["A"], 2: ["A"], 3: [], 4: [], 5: ["Y"], 6: ["Y"]}
    texts = [('```\n[1]\n```', "[1]"), ("see {\"a\": [2]} there", '{"a": [2]}'), ("none", None), ("{broken", None)]
    df = spark.createDataFrame(texts, "t string, expected string")
    assert all(r[0] == r[1] for r in df.select("expected", T.model_json(F.col("t"))).collect())
