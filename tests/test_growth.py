"""What keeps queries in proportion to their input: work in many tasks, each value computed once, no step over a hot key."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from factloom.operators import documents, drafts, graph, impact, planning, reports, skew, summarise, validation
from factloom.plans import catalogue, relations, sources, stores


def test_a_node_is_parsed_once_however_many_fields_are_checked(spark):
    rows = spark.createDataFrame([(1, '{"id": "a", "title": " ", "intent": "why", "rules": [{"kind": "behaviour", "target": "t", "assert": {"throws": {"op": "like"}}}]}'), (2, "[]")], "id long, document string")
    found = validation.node_row_problems(rows, "document", "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parseJson") <= 2 and plan.count("schemaOfVariant") + plan.count("schema_of_variant") < 400
    assert [tuple(r) for r in found.orderBy("id", "place").collect()] == [
        (1, 0, "nodes[1].title must be a non-empty string"), (1, 1, "nodes[1].rules[0].assert.throws.op is not supported"), (1, 2, "nodes[1].rules[0].assert.throws.value is required"), (2, 0, "nodes[2] must be an object"),
    ]


def test_rows_of_one_file_are_spread_over_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = spark.read.parquet(f"{tmp_path}/one")
    assert skew.spread(rows, "id").select(F.spark_partition_id()).distinct().count() > 8


def test_next_id_follows_the_sql_beyond_four_digits(spark, tmp_path):
    spark.createDataFrame([(7,), (12345,), (99,)], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    told = duckdb.connect()
    told.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert catalogue.queries()["next_id"](spark, str(tmp_path)).first()[0] == told.execute(catalogue.oracle_sql()["next_id"]).fetchone()[0] == 1235


def _folded_plainly(steps, callers, budget, most):
    """Folding as it is told: every merge looks at all groups again."""
    groups = [[s] for s in sorted(steps, key=lambda s: s.place)]
    size = lambda g: sum(s.covers for s in g)

    def by_calls():
        owner, found = {x: k for k, g in enumerate(groups) for s in g for x in s.identities}, []
        for k, g in enumerate(groups):
            own = {x for s in g for x in s.identities}
            calling = {owner.get(c) for x in own for c in callers.get(x, ()) if c not in own}
            if len(calling) == 1 and (into := calling.pop()) is not None and into != k and size(groups[into]) + size(g) <= most:
                found.append((into, k))
        return min(found, default=None)

    def by_neighbours(of):
        runs = {}
        for k, g in enumerate(groups):
            if of(g):
                runs.setdefault(of(g), []).append(k)
        pairs = [(size(groups[a]) + size(groups[b]), a, b) for run in runs.values() for a, b in zip(run, run[1:], strict=False)]
        return min((p for p in pairs if p[0] <= most), default=(None, None))[1:] if any(p[0] <= most for p in pairs) else None

    for choose in (by_calls, lambda: by_neighbours(lambda g: g[0].heading), lambda: by_neighbours(lambda g: "all")):
        while len(groups) > budget and (pair := choose()):
            joined = sorted(groups[pair[0]] + groups[pair[1]], key=lambda s: s.place)
            groups = sorted([*(g for k, g in enumerate(groups) if k not in pair), joined], key=lambda g: g[0].place)
    return [[s.id for s in g] for g in groups]


def test_folding_merges_as_a_plain_loop_does():
    r = random.Random(7)
    for _ in range(1500):
        n, shared = r.randint(1, 20), r.random() < 0.4
        names = [f"x{i}" for i in range(n + 3)]
        steps = [summarise.Step(f"s{i:02d}", r.choice([None, 1, 2, 3, 4]), r.choice(["", "a", "b"]), tuple(dict.fromkeys([names[i], *([r.choice(names)] if shared else [])])), r.choice([1, 1, 2, 3])) for i in range(n)]
        callers = {}
        for _ in range(r.randint(0, 2 * n)):
            callers.setdefault(r.choice(names), set()).add(r.choice([*names, "elsewhere"]))
        budget, most = r.randint(1, 6), r.randint(2, 12)
        assert [[s.id for s in g.members] for g in summarise.Folding(steps, callers, budget, most).groups] == _folded_plainly(steps, callers, budget, most)


def test_a_feature_of_many_steps_is_folded_in_proportion_to_them():
    steps = [summarise.Step(f"s{i:08d}", i % 50, f"h{i % 5}", (f"x{i}",)) for i in range(20_000)]
    start = time.monotonic()
    groups = summarise.Folding(steps, {f"x{i}": {f"x{i // 3}"} for i in range(20_000)}, 1, 12).groups
    assert time.monotonic() - start < 60 and sum(g.size for g in groups) == 20_000 and max(g.size for g in groups) <= 12


def test_texts_of_a_table_in_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    spark.range(200).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    texts = sources.source_texts(spark, str(tmp_path)).where("path like 'src/%'")
    assert texts.select(F.spark_partition_id()).distinct().count() > 8


def test_a_live_feed_in_pieces_tells_the_same_sessions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "_PIECE", 400)
    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in catalogue.queries()["live_sessions"](spark, folder).collect())
    told = duckdb.connect()
    told.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert got == sorted(told.execute(catalogue.oracle_sql()["live_sessions"]).fetchall()) and got


def test_a_call_is_resolved_once_a_file_however_many_make_it(spark):
    rows = [(f"f::d{i}", "f", f"d{i}", ["svc.only", "d0"]) for i in range(40)] + [("g::only", "g", "only", []), ("none", None, "alone", ["only"])]
    found = graph.resolve_calls(spark.createDataFrame(rows, "identity string, file string, name string, calls array<string>"))
    assert re.search(r"Aggregate \[here#\d+, call#\d+\]", found._jdf.queryExecution().optimizedPlan().toString())
    want = {(f"f::d{i}", "g::only") for i in range(40)} | {(f"f::d{i}", "f::d0") for i in range(1, 40)} | {("none", "g::only")}
    assert {tuple(r) for r in found.collect()} == want


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _grouped_after_dealing(plan, grouping):
    """Whether the rows are dealt out by number before the first grouping; plans are told from their end."""
    return 0 <= plan.find(grouping) < plan.find("REPARTITION_BY_NUM")


def test_evidence_moves_once_an_identity_and_is_grouped_where_it_lands(spark):
    steps = spark.createDataFrame([("s", 1, "one", ["a::f:function", None, "a::g:function", "a::f:function"]), ("s", 2, None, [])], "id string, place int, title string, identities array<string>")
    rules = spark.createDataFrame([("s", 1, "a::f:function", "x"), ("s", 1, "a::f:function", "x")], "id string, seq int, target string, line string")
    facts = spark.createDataFrame([("a::f:function", ["calls x"]), ("a::g:function", None)], "identity string, evidence array<string>")
    blocks = reports.covers_blocks(steps, rules, facts)
    assert _grouped_after_dealing(_plan(blocks), "partial_collect_list")
    got = {r["place"]: (r["title"], r["names"], r["rules"], r["evidence"]) for r in blocks.collect()}
    assert got == {1: ("one", ["f", "", "g", "f"], ["x", "x"], ["calls x", "calls x"]), 2: (None, [], [], [])}


def test_rules_meet_their_steps_without_a_join_and_what_meets_evidence_is_dealt_by_its_number(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 1)
    steps = spark.createDataFrame([("s", 1, "one", ["x::f:function", "x::g:function"]), ("s", 2, "two", ["x::g:function"]), (None, 3, "three", ["x::f:function"])], "id string, place int, title string, identities array<string>")
    rules = spark.createDataFrame([("s", 2, "x::g:function", "b"), ("s", 1, "x::g:function", "a"), (None, 1, "x::f:function", "c"), ("t", 1, "x::f:function", "d"), ("s", 1, None, "e")], "id string, seq int, target string, line string")
    facts = spark.createDataFrame([("x::f:function", ["calls x"]), ("x::g:function", [])], "identity string, evidence array<string>")
    blocks = reports.covers_blocks(steps, rules, facts)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("^.*Join ", plan, re.M)) == 1 and _plan(blocks).count("REPARTITION_BY_NUM") == 2
    got = {r["place"]: (r["names"], r["rules"], r["evidence"]) for r in blocks.collect()}
    assert got == {1: (["f", "g"], ["a", "b"], ["calls x"]), 2: (["g"], ["a", "b"], []), 3: (["f"], [], ["calls x"])}


def test_pairs_of_steps_are_dealt_out_before_they_are_gathered(spark):
    nodes = spark.createDataFrame([("p", ["x", "y"], 1), ("q", ["y"], 2)], "id string, identities array<string>, seq long")
    edges = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x")], "`from` string, `to` string")
    linked = planning.link_steps(edges, nodes)
    plan = _plan(linked)
    assert _grouped_after_dealing(plan, "HashAggregate") and plan.count("REPARTITION_BY_NUM") == 2
    assert sorted(map(tuple, linked.collect())) == [("p", "q"), ("q", "p")]


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    assert skew.spread(spark.range(5), "id", total=991).rdd.getNumPartitions() == 100


def test_features_are_looked_up_without_the_rows_of_the_draft(spark, monkeypatch):
    """The rules, titles and readings of a draft are no part of the joins by a feature's name, where few keys have all rows."""
    seen = []
    monkeypatch.setattr(drafts, "hot_join", lambda rows, *rest: seen.append(set(rows.columns)) or skew.hot_join(rows, *rest))
    folder = "/root/testdata/sf0.001"
    assert catalogue.queries()["draft_notes"](spark, folder).count() > 0
    assert seen and not any(columns & {"rules", "readings", "title", "dimensions"} for columns in seen)


def test_first_callers_need_no_window_and_results_are_made_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(impact, "reliable", lambda frame: plans.append((frame.columns, _plan(frame))) or graph.reliable(frame))
    edges = spark.createDataFrame([("b", "a", "call", "certain"), ("a", "a", "call", "certain"), ("c", "b", "call", "certain")], "`from` string, `to` string, kind string, confidence string")
    results = spark.range(3).selectExpr("element_at(array('a', 'b', 'z'), cast(id + 1 as int)) as identity", "'error' as status")
    found = impact.impact_of_results(results, edges)
    first = next(plan for columns, plan in plans if "place" in columns)
    assert "Window" not in first and "Range" not in _plan(found)
    assert {r["identity"]: [(e["identity"], e["depth"]) for e in r["impact"]] for r in found.collect()} == {"a": [("b", 1), ("c", 2)], "b": [("c", 1)], "z": []}


def test_a_report_is_one_pass_over_its_results(spark):
    results = spark.range(4).selectExpr("id as seq", "'i' || id as identity", "if(id % 2 = 0, 'drifted', 'error') as status", "'w' as intent", "'me' as approved_by", "cast(null as timestamp) as approved_at", "array('v') as violations", "array('e') as errors", "if(id = 3, array('u'), null) as unsupported", "array_except(array(named_struct('identity', 'x', 'confidence', 'y')), array(named_struct('identity', 'x', 'confidence', 'y'))) as impact")
    lines = documents.verify_report_lines(results, "p", "t", F.lit(None).cast("timestamp")).where("seq >= 0")
    assert _plan(lines).split("Initial Plan")[0].count("Range (") == 1
    got = [tuple(r) for r in lines.orderBy("section", "seq", "place").select("section", "seq", "line").where("section > 1").collect()]
    assert got == [(2, 1, "### `i1`"), (2, 1, ""), (2, 1, "- e"), (2, 1, ""), (2, 3, "### `i3`"), (2, 3, ""), (2, 3, "- e"), (2, 3, ""), (3, 3, "- `i3`: u")]


def test_snapshots_are_made_in_many_tasks(spark):
    assert all("REPARTITION_BY_NUM" in _plan(side) for side in relations.snapshots(spark, "/root/testdata/sf0.001"))
