"""Plan lifecycle, evolution and view operators on hand-written rows."""

from pyspark.sql import functions as F

from factloom.operators import evolution, graph, planning, views
from factloom.plans import catalogue, relations


def test_forest_breaks_loops_and_features(spark):
    rows = [(1, "f", None), (2, "f", 1), (3, "f", 2), (4, "g", 3), (5, "g", 4), (8, "f", 9), (9, "f", 8), (10, "f", 8), (11, "f", 10), (20, "f", 21), (21, "f", 22), (22, "f", 20), (23, "f", 22), (30, "f", 30), (31, "f", 99)]
    rows += [(i, "h", i - 1 if i > 100 else None) for i in range(100, 201)]
    got = {r["id"]: (r["root"], r["depth"]) for r in evolution.forest(spark.createDataFrame(rows, "id long, feature string, parent long")).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [(1, 0), (1, 1), (1, 2), (4, 0), (4, 1)]
    assert all(got[i] == (i, 0) for i in (8, 9, 10, 11, 20, 21, 22, 23, 30, 31)) and got[200] == (100, 100)


def test_approval_lifecycle(spark):
    rows = spark.createDataFrame([(1, "intended", 1, None, None, 7), (2, "approved", 1, "x", 5, 7), (3, "implemented", 1, None, None, 7)], "id long, status string, version int, approved_by string, approved_facts int, facts int")
    once = planning.approve(rows, F.lit(True), "me")
    twice = planning.approve(once, F.lit(True), "other")
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()}
    got = {r["id"]: (r["status"], r["approved_by"], r["approved_facts"]) for r in once.collect()}
    assert got == {1: ("approved", "me", 7), 2: ("approved", "x", 5), 3: ("implemented", None, None)}
    back = {r["id"]: (r["status"], r["version"], r["approved_facts"]) for r in planning.revise(once, F.lit(True)).collect()}
    assert back == {1: ("intended", 2, None), 2: ("intended", 2, None), 3: ("implemented", 1, None)}


def test_reordering_is_dense(spark):
    nodes = spark.createDataFrame([(1, "f", 1), (2, "f", 2), (3, "f", None), (4, "f", 3)], "id long, feature string, step int")
    moved = spark.createDataFrame([(4, 1)], "id long, place int")
    assert {r["id"]: r["step"] for r in planning.reorder(nodes, moved).collect()} == {4: 1, 1: 2, 2: 3, 3: 4}


def test_common_prefix(spark):
    rows = spark.createDataFrame([("a", ["x", "y", "z"]), ("a", ["x", "y"]), ("b", ["p"]), ("b", ["q"])], "g string, path array<string>")
    assert {r["g"]: r["prefix"] for r in planning.common_prefix(rows, "g", "path").collect()} == {"a": ["x", "y"], "b": []}


def test_python_modules(spark):
    imports = spark.createDataFrame([("a/b/m.py", "c", 1), ("a/b/m.py", "d.e", 2), ("a/b/m.py", "top", 0), ("a/b/m.py", "a.none", 0), ("a/b/m.py", "os", 0), ("m.py", "x", 5)], "importer string, module string, dots int")
    files = spark.createDataFrame([("a/__init__.py",), ("a/b/c.py",), ("a/b/c/__init__.py",), ("a/d/e/__init__.py",), ("top.py",)], "path string")
    got = {(r["module"], r["dots"]): (r["target"], r["confidence"]) for r in planning.python_modules(imports, files).collect()}
    assert got[("c", 1)] == ("a/b/c.py", "certain") and got[("d.e", 2)] == ("a/d/e/__init__.py", "certain") and got[("top", 0)] == ("top.py", "certain")
    assert got[("a.none", 0)] == (None, "inferred") and got[("os", 0)] == (None, "unresolved") and got[("x", 5)] == (None, "unresolved")


def test_folding_and_previews(spark):
    rows = spark.createDataFrame([("f", i, i in (2, 5)) for i in range(8)], "g string, i int, on boolean")
    runs = {(r["first"], r["shown"], r["n"]) for r in views.fold_runs(rows, "g", "i", F.col("on")).collect()}
    assert runs == {(0, False, 2), (2, True, 1), (3, False, 2), (5, True, 1), (6, False, 2)}
    assert sorted(r["i"] for r in views.preview(rows, "g", ["i"], 3).collect()) == [0, 4, 7]
    status = spark.createDataFrame([("a", "superseded"), ("b", "implemented"), ("b", "drifted"), ("b", "error")], "feature string, status string")
    assert {r["feature"]: r["status"] for r in views.feature_status(status).collect()} == {"a": "intended", "b": "drifted"}


def test_labels_keep_refuse_and_fall_back(spark):
    rows = spark.createDataFrame([("t", "a", "old"), ("t", "b", None), ("t", "c", None), ("t", "d", None)], "ts string, identity string, label string")
    labels = spark.createDataFrame([("t", "a", "new"), ("t", "b", "good"), ("t", "c", "Misc")], "ts string, identity string, label string")
    got = {r["identity"]: (r["label"], r["source"]) for r in evolution.apply_labels(rows, labels, F.lit("fb"), ["misc"]).collect()}
    assert got == {"a": ("old", "kept"), "b": ("good", "model"), "c": ("fb", "fallback"), "d": ("fb", "fallback")}


def test_caller_index_covers_all_declarations(spark):
    sf = "/root/testdata/sf0.001"
    got = catalogue.queries()["caller_index"](spark, sf).where("callee = 'console.log'")
    assert got.count() == relations.declarations(spark, sf).select("identity").distinct().count()


def test_constellation_edges_of_all_steps(spark):
    sf = "/root/testdata/sf0.001"
    steps = {r["id"]: (r["feature"], r["parent"]) for r in relations.plan(spark, sf).select("id", "feature", "parent").collect()}
    expected = {(f, steps[p][0]) for f, p in steps.values() if p in steps and steps[p][0] != f}
    got = {(r["from"], r["to"]) for r in catalogue.queries()["constellation_edges"](spark, sf).where("kind = 'call'").collect()}
    assert got == expected


def test_ancestors_of_deep_chains(spark):
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)] + [(200, None)], "id long, parent long")
    assert {r["id"] for r in graph.prune_to_ancestors(rows, F.col("id") == 99).collect()} == set(range(100))
