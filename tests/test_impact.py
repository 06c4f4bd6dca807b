"""Impact of many targets against a queue in plain Python; hot keys; rules of calls, steps and previews."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, impact, planning, skew, views


def walk(edges, target, depth, most):
    """The walk with a queue: (id, depth, kind, confidence) in order, and whether something was left."""
    callers = {}
    for a, b, kind, sure in edges:
        if a is not None and b is not None:
            callers.setdefault(b, []).append((a, kind, sure))
    found, visited, queue = [], {target}, deque([(target, 0)])
    while queue:
        at, d = queue.popleft()
        if d >= depth:
            continue
        row = sorted(callers.get(at, []))
        for i, (a, kind, sure) in enumerate(row):
            if a in visited:
                continue
            visited.add(a)
            found.append((a, d + 1, kind, sure))
            if d + 1 < depth:
                queue.append((a, d + 1))
            if len(found) >= most:
                return found, any(x[0] not in visited for x in row[i + 1 :]) or bool(queue)
    return found, False


@pytest.mark.parametrize(("seed", "depth", "most"), [(1, 3, 25), (2, 3, 4), (3, 1, 3), (4, 2, 1), (5, 4, 7), (6, 0, 5)])
def test_impact_equals_a_queue(spark, monkeypatch, seed, depth, most):
    monkeypatch.setattr(skew, "HOT", 5)
    r = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    edges = [(r.choice(names), r.choice(["hub", *names]) if r.random() < 0.9 else None, r.choice(["call", "import"]), r.choice(["certain", "inferred"])) for _ in range(150)]
    edges += [(f"n{i}", "hub", "call", "certain") for i in range(30)] + [("hub", "n3", "call", "certain"), ("n1", "n1", "call", "certain")]
    frame = spark.createDataFrame(edges, "`from` string, `to` string, kind string, confidence string")
    targets = spark.createDataFrame([(x,) for x in [*names, "hub", "nobody", "", None, "n1"]], "target string")
    got = {}
    for row in impact.impact_of_all(frame, targets, depth, most).orderBy("target", "place").collect():
        got.setdefault(row["target"], ([], row["truncated"]))[0].append((row["id"], row["depth"], row["kind"], row["confidence"]))
    expected = {t: walk(edges, t, depth, most) for t in [*names, "hub", "nobody"]}
    assert got == {t: e for t, e in expected.items() if e[0]}


def test_impact_of_results(spark):
    edges = spark.createDataFrame([("b", "a", "call", "certain"), ("c", "b", "call", "certain")], "`from` string, `to` string, kind string, confidence string")
    results = spark.createDataFrame([("a", "drifted", 1), ("b", "implemented", 2), ("z", "error", 3)], "identity string, status string, n int")
    rows = {r["identity"]: r for r in impact.impact_of_results(results, edges).collect()}
    assert [(e["identity"], e["depth"]) for e in rows["a"]["impact"]] == [("b", 1), ("c", 2)] and rows["b"]["impact"] == [] and rows["z"]["impact"] == []
    assert impact.impact_of_results(results.limit(0), edges).count() == 0 and impact.impact_of_all(edges.limit(0), results.select(F.col("identity").alias("target"))).count() == 0


def test_hot_join_keeps_hot_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 50)
    monkeypatch.setattr(skew, "HOT_KEYS", 10)
    rows = spark.range(1200).selectExpr("id", "case when id % 3 > 0 then 'hot' when id % 9 = 0 then null else 'k' || id end as key")
    keyed = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3)], "key string, v int")
    for how in ("inner", "left"):
        got = skew.hot_join(rows, keyed, "key", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(keyed, "key", how).collect()))


def test_calls_as_they_are_written(spark):
    calls = {"get": ["get"], " svc . run ": ["svc . run", "svc.run", "run"], 'df["a.b"].str.casefold': ["df.str.casefold", "str.casefold", "casefold"], "..x": ["x"], "": [], " [y] ": [], " a.b\t": ["a.b", "b"], "a..b": ["a..b", "a.b", "b"], "f[0]": ["f"]}
    frame = spark.createDataFrame([(c,) for c in calls], "c string")
    assert {r["c"]: r["t"] for r in frame.select("c", graph.call_targets(F.col("c")).alias("t")).collect()} == calls


def test_last_owner_and_first_match_follow_the_plan(spark):
    nodes = spark.createDataFrame([("plan_9999", ["x", "y"], 2), ("plan_10000", ["x", "z"], 3), ("plan_2", ["w"], 1)], "id string, identities array<string>, seq long")
    edges = spark.createDataFrame([("w", "x"), ("y", "x"), ("z", "x"), ("x", "w")], "`from` string, `to` string")
    assert sorted(map(tuple, planning.link_steps(edges, nodes).collect())) == [("plan_10000", "plan_2"), ("plan_2", "plan_10000"), ("plan_9999", "plan_10000"), ("plan_9999", "plan_2")]
    assert {r["id"] for r in planning.reject(nodes, planning.named_by("x")).collect()} == {"plan_10000", "plan_2"}
    assert planning.reject(nodes, planning.named_by("nothing")).count() == 3


def test_preview_of_one_and_batches(spark):
    rows = spark.range(8).selectExpr("'g' as g", "id as i").unionByName(spark.createDataFrame([("h", 5)], "g string, i long"))
    assert sorted((r["g"], r["i"]) for r in views.preview(rows, "g", ["i"], 1).collect()) == [("g", 0), ("g", 7), ("h", 5)]
    files = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("c", 1)], "d string, t long")
    got = sorted((r["batch"], r["batch_name"], r["d"], r["t"]) for r in views.batches(files, ["d", "t"], 3, "d").collect())
    assert got == [(0, "a +1 more", "a", 1), (0, "a +1 more", "a", 2), (0, "a +1 more", "b", 1), (1, "c", "c", 1)]
