"""Queries over edits of plans, drafts, reports, layout and plain functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import authoring as A
from ..operators import events, reports, rules, validation, views
from ..operators.skew import spread
from ..sources import readers
from . import relations as R
from .registry import query


def _id(key):
    return events.numbered_id("plan_", key)


def _nodes(spark, sf):
    p = R.plan(spark, sf)
    key = F.col("id")
    return p.select(
        _id(key).alias("id"), key.alias("seq"), "feature", "title", F.col("title").alias("intent"), F.when(key % 5 == 0, "approved").otherwise("intended").alias("status"), F.lit("ai_drafted").alias("origin"), "step",
        F.array(_id(key), F.col("title")).alias("identities"), _id(key).alias("identity"), (key % 3).alias("n_history"), F.when(key % 4 != 0, F.lit("r")).alias("readings"), key.cast("long").alias("x"), key.cast("long").alias("y"),
        F.when(key % 7 == 0, 3).alias("version"), F.lit("me").alias("approved_by"), F.lit(1).alias("approved_facts"), F.lit(None).cast("string").alias("supersedes"),
        F.array().cast("array<struct<id:string,version:int,identity:string,title:string,intent:string,status:string,origin:string>>").alias("history"),
    )


def _padded(expr: str) -> str:
    return f"'plan_' || CASE WHEN length(CAST({expr} AS VARCHAR)) >= 4 THEN CAST({expr} AS VARCHAR) ELSE lpad(CAST({expr} AS VARCHAR), 4, '0') END"


_P_SQL = f"WITH {R.PLAN_SQL}, p AS (SELECT *, {_padded('id')} AS node FROM plan), top AS (SELECT max(id) + 1 AS n FROM plan) "


@query(_P_SQL + f"""SELECT node AS id, feature, CAST(CASE WHEN feature = 'Brand#3' THEN row_number() OVER (PARTITION BY feature ORDER BY step, node) ELSE step END AS INTEGER) AS step FROM p
  UNION ALL SELECT {_padded('n')}, 'Brand#3', CAST((SELECT count(*) FROM plan WHERE feature = 'Brand#3') + 1 AS INTEGER) FROM top""")
def add_step(spark, sf):
    return A.add_step(_nodes(spark, sf), "Brand#3", " A new step ").select("id", "feature", "step")


@query(_P_SQL + "SELECT node AS id, CASE WHEN feature = 'Brand#3' THEN 'Other title' ELSE title END AS title, CASE WHEN id % 4 <> 0 AND feature <> 'Brand#3' THEN 'r' END AS readings FROM p")
def rename_steps(spark, sf):
    return A.rename_step(_nodes(spark, sf), F.col("feature") == "Brand#3", " Other title").select("id", "title", "readings")


@query("SELECT 'r' || r_regionkey AS id, CASE r_regionkey WHEN 2 THEN 'Sea' ELSE r_name END AS name, CASE r_regionkey WHEN 2 THEN 'human_added' ELSE 'derived' END AS source FROM region")
def rename_feature(spark, sf):
    regions = R.table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("derived").alias("source"))
    return A.rename_feature(regions, "r2", "Sea ")


@query(_P_SQL + "SELECT node AS id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 3 = 0 THEN CAST(floor(id + 0.5) AS BIGINT) ELSE id END AS x, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 3 = 0 THEN -id ELSE id END AS y FROM p")
def move_steps(spark, sf):
    n = _nodes(spark, sf)
    k = F.col("seq")
    moves = n.where("seq % 3 = 0").select("id", F.when(k % 6 != 0, k + 0.4).cast("double").alias("x"), (-k - 0.4).cast("double").alias("y"))
    return A.move_steps(n, moves).select("id", "x", "y")


@query(_P_SQL + f"""SELECT CASE WHEN id % 10 = 0 THEN {_padded("(SELECT n FROM top) + id // 10")} ELSE node END AS id, CASE WHEN id % 10 = 0 THEN node END AS supersedes, CAST(CASE WHEN id % 10 = 0 THEN CASE WHEN id % 7 = 0 THEN 4 ELSE 2 END WHEN id % 7 = 0 THEN 3 END AS INTEGER) AS version,
  CASE WHEN id % 10 = 0 OR id % 5 <> 0 THEN 'intended' ELSE 'approved' END AS status, CAST(CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_history FROM p""")
def revise_as_new(spark, sf):
    return A.revise_as_new(_nodes(spark, sf), F.col("seq") % 2 == 0).select("id", "supersedes", "version", "status", F.size("history").alias("n_history"))


@query(_P_SQL + "SELECT node AS id FROM p WHERE NOT (title = 'red ring' OR id % 11 = 0) OR id % 5 = 0 OR id % 3 > 0")
def preserved_nodes(spark, sf):
    n = _nodes(spark, sf)
    batch = n.where("seq % 11 = 0").select(F.col("id").alias("identity")).unionByName(spark.createDataFrame([("red ring",)], "identity string"))
    return A.preserved(n, batch).select("id")


@query("""WITH c AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 9 = 0 THEN 'main.ts' ELSE 'src/' || lower(p_brand) || '/f.ts' END AS path FROM part), d AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory FROM c)
  SELECT seq, directory, CAST((row_number() OVER (ORDER BY directory, seq) - 1) // 20 AS INTEGER) AS batch FROM d""")
def draft_batches(spark, sf):
    path = F.when(F.col("p_partkey") % 9 == 0, "main.ts").otherwise(F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/f.ts")))
    rows = R.table(spark, sf, "part").select(F.concat(path, F.lit("::run"), "p_partkey", F.lit(":function")).alias("identity"), F.col("p_partkey").alias("seq"))
    return A.draft_batches(rows).select("seq", "directory", "batch")


@query("SELECT p_partkey AS seq FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 20 <> 4")
def accept_draft(spark, sf):
    k = F.col("p_partkey")
    rows = R.table(spark, sf, "part").select(k.alias("seq"), F.when(k % 20 == 4, k - 1).otherwise(k).cast("string").alias("identity"), F.when(k % 10 != 3, F.col("p_name")).otherwise(" ").alias("title"), F.lit("why").alias("intent"))
    return A.accept_draft(rows, rows.select("identity")).select("seq")


@query(f"""WITH n AS (SELECT p_partkey AS k, {_padded("(row_number() OVER (ORDER BY p_partkey) + 6)")} AS id FROM part) SELECT a.id AS "from", b.id AS "to" FROM n a JOIN n b ON b.k = a.k // 2""")
def remap_draft(spark, sf):
    k = F.col("p_partkey")
    nodes = R.table(spark, sf, "part").select(F.concat(F.lit("t"), k).alias("temp_id"), k.alias("seq"))
    edges = R.table(spark, sf, "part").select(F.concat(F.lit("t"), k).alias("from"), F.concat(F.lit("t"), F.expr("p_partkey div 2")).alias("to"))
    return A.remap_draft(nodes, edges, 7)[1]


# --- validation ------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, CAST(unnest(range(0, len(e))) AS INTEGER) AS place, unnest(e) AS error FROM (SELECT p_partkey, list_filter([
    CASE WHEN p_partkey % 17 = 0 THEN 'nodes[' || p_partkey || '].title must be a non-empty string' END, CASE WHEN p_size = 7 THEN 'nodes[' || p_partkey || '].version must be a positive integer' END,
    CASE WHEN p_partkey % 13 = 0 THEN 'nodes[' || p_partkey || '].identities[0] must be the node''s own identity' END, CASE WHEN p_partkey % 19 = 0 THEN 'nodes[' || p_partkey || '].merge requires more than one identity' END,
    CASE WHEN p_size % 5 = 0 THEN 'nodes[' || p_partkey || '].step must be a positive integer' END, CASE WHEN p_partkey % 11 = 0 THEN 'nodes[' || p_partkey || '].rules[0].assert.throws.op is not supported' END,
    CASE WHEN p_partkey % 11 = 0 THEN 'nodes[' || p_partkey || '].rules[0].assert.throws.value is required' END, CASE WHEN p_partkey % 23 = 0 THEN 'nodes[' || p_partkey || '].status is invalid' END], lambda x: x IS NOT NULL) AS e FROM part)""")
def validate_plan_rows(spark, sf):
    """Nodes as JSON text, of which some have a value of the wrong type, an unknown word or a contradiction."""
    k, size = F.col("p_partkey"), F.col("p_size")
    own = F.concat(F.lit("d"), k.cast("string"))
    clause = F.struct(F.when(k % 11 == 0, "like").otherwise(">=").alias("op"), F.when(k % 11 != 0, 1).alias("value"))
    rule = F.struct(F.lit("behaviour").alias("kind"), own.alias("target"), F.struct(clause.alias("throws")).alias("assert"))
    first = F.when(k % 13 == 0, "other").otherwise(own)
    node = F.struct(
        own.alias("id"), F.when(k % 17 != 0, F.col("p_name")).otherwise(" ").alias("title"), F.lit("why").alias("intent"), F.when(size == 7, 1.5).otherwise(2.0).alias("version"), own.alias("identity"),
        F.when(k % 19 == 0, F.array(first)).otherwise(F.array(first, F.lit("x"))).alias("identities"),
        F.when(k % 19 == 0, "family").alias("merge"), (size % 5).alias("step"), F.array(rule).alias("rules"), F.when(k % 23 == 0, "done").otherwise("intended").alias("status"),
    )
    parts = spread(R.table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    rows = parts.select(k.alias("id"), F.to_json(node).alias("document"))
    return validation.node_row_problems(rows, "document", "id")


@query("""WITH n AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders), r AS (SELECT id, unnest([0, 1, 2, 3]) AS place, c FROM n)
  SELECT id, place, CASE place WHEN 0 THEN 'd' || c WHEN 1 THEN 'd' || c + 1 WHEN 2 THEN 'elsewhere' ELSE 'd' || c END AS target,
    CASE WHEN place = 2 THEN 'rule target elsewhere does not match node identity d' || c WHEN place = 3 THEN NULL WHEN (c + CASE WHEN place = 1 THEN 1 ELSE 0 END) NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) THEN 'd' || (c + CASE WHEN place = 1 THEN 1 ELSE 0 END) || ' is missing from the current project' END AS problem,
    place = 3 AS unsupported, CAST(CASE WHEN place = 0 THEN CASE WHEN c IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) THEN 7 END WHEN place = 1 THEN CASE WHEN c + 1 IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) THEN 8 END END AS INTEGER) AS approved FROM r""")
def rule_targets(spark, sf):
    c = lambda n: F.concat(F.lit("d"), (F.col("o_custkey") + n).cast("string"))
    orders = R.table(spark, sf, "orders")
    nodes = orders.select(F.col("o_orderkey").alias("id"), c(0).alias("identity"), F.array(c(0), c(1)).alias("identities"), F.lit(7).alias("approved"), F.create_map(c(1), F.lit(8)).alias("approved_by_identity"))
    kinds = [("behaviour", None), ("behaviour", c(1)), ("behaviour", F.lit("elsewhere")), ("structure", c(0)), ("other", c(0))]
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), (F.lit(None).cast("string") if t is None else t).alias("target")) for i, (k, t) in enumerate(kinds)])
    asked = orders.select(F.col("o_orderkey").alias("id"), F.explode(each).alias("r")).select("id", "r.*")
    current = R.table(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("identity"), F.lit(1).alias("facts"))
    return rules.rule_targets(nodes, asked, current).drop("facts")


# --- views -----------------------------------------------------------------------------------------------------------

_STEPS_SQL = f"WITH {R.PLAN_SQL}, s AS (SELECT id, feature, CASE WHEN id % 6 <> 0 THEN step END AS step, CASE WHEN id % 5 = 0 THEN '' WHEN feature = 'Brand#3' THEN 'One' ELSE path[1] END AS heading FROM (SELECT * REPLACE (CASE WHEN feature = 'Brand#4' AND id % 16 <> 3 THEN 'Brand#5' ELSE feature END AS feature) FROM plan)), t AS (SELECT *, CASE WHEN feature = 'Brand#3' THEN 'One' ELSE heading END AS h FROM s), w AS (SELECT id, feature, h, CAST(row_number() OVER (PARTITION BY feature ORDER BY step IS NULL, step, CASE WHEN step IS NOT NULL THEN CAST(id AS VARCHAR) END, id) AS INTEGER) AS place, count(*) OVER (PARTITION BY feature) AS n FROM t) "


def _steps(spark, sf):
    p = R.plan(spark, sf).withColumn("feature", F.when((F.col("feature") == "Brand#4") & (F.col("id") % 16 != 3), "Brand#5").otherwise(F.col("feature")))  # one feature is short
    heading = F.when(F.col("feature") == "Brand#3", F.array(F.lit("One"))).when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("path"))
    return p.select("id", F.col("id").alias("seq"), "feature", F.when(F.col("id") % 6 != 0, F.col("step")).alias("step"), heading.alias("path"), "role", "status", "lens_tags")


@query(_STEPS_SQL + "SELECT id, feature, place FROM w")
def ordered_steps(spark, sf):
    return views.in_step_order(_steps(spark, sf), "feature").select("id", "feature", "place")


@query(_STEPS_SQL + """, f AS (SELECT feature, h, min(place) AS first FROM w GROUP BY feature, h), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY h = '', first) AS part, count(*) OVER (PARTITION BY feature) AS parts FROM f),
  j AS (SELECT w.*, parts, CAST(CASE WHEN n <= 12 THEN NULL WHEN parts = 1 THEN (place - 1) // 10 + 1 ELSE part END AS INTEGER) AS part, CASE WHEN n <= 12 THEN NULL WHEN parts = 1 THEN 'Steps ' || ((place - 1) // 10 * 10 + 1) || '–' || least((place - 1) // 10 * 10 + 10, n) WHEN h = '' THEN 'Other steps' ELSE h END AS part_name FROM w JOIN r USING (feature, h))
  SELECT feature, id, place, part, part_name, CASE WHEN part IS NULL THEN CAST(place AS VARCHAR) WHEN count(*) OVER (PARTITION BY feature, part) = 1 THEN CAST(part AS VARCHAR) ELSE part || '.' || row_number() OVER (PARTITION BY feature, part ORDER BY place) END AS number FROM j""")
def step_numbers(spark, sf):
    return views.parts_of(_steps(spark, sf))


@query(f"""WITH {R.PLAN_SQL}, n AS (SELECT n_nationkey AS seq, 'Brand#' || n_nationkey AS feature FROM nation), p AS (SELECT id, feature, CASE WHEN feature = 'Brand#2' THEN 'tool' ELSE role END AS role, status, step, path[1] AS h, lens_tags FROM plan),
  c AS (SELECT feature, count(*) AS steps, count(DISTINCT h) AS heads FROM p WHERE role = 'behaviour' GROUP BY feature), m AS (SELECT feature, count(*) AS members, count(*) FILTER (WHERE status IN ('drifted', 'error')) AS failing, bool_or(list_contains(lens_tags, 'red')) AS red, bool_or(list_contains(lens_tags, 'ring')) AS ring,
    coalesce(['drifted', 'error', 'intended', 'approved', 'implemented'][min(list_position(['drifted', 'error', 'intended', 'approved', 'implemented'], status))], 'intended') AS status FROM p GROUP BY feature)
  SELECT feature, CAST(CASE WHEN steps IS NOT NULL THEN row_number() OVER (PARTITION BY steps IS NOT NULL ORDER BY seq) END AS INTEGER) AS place, coalesce(steps, 0) AS steps,
    CASE WHEN steps IS NULL THEN NULL WHEN steps > 12 AND (CASE WHEN heads = 1 THEN (steps - 1) // 10 + 1 ELSE heads END) > 1 THEN steps || ' steps · ' || (CASE WHEN heads = 1 THEN (steps - 1) // 10 + 1 ELSE heads END) || ' parts' WHEN steps = 1 THEN '1 step' ELSE steps || ' steps' END AS sub,
    CASE WHEN steps IS NOT NULL THEN array_to_string(list_filter([CASE WHEN red THEN 'red' END, CASE WHEN ring THEN 'ring' END], lambda x: x IS NOT NULL), ',') END AS lenses, CASE WHEN steps IS NOT NULL THEN failing END AS failing, CASE WHEN steps IS NOT NULL THEN status END AS status, CASE WHEN steps IS NULL THEN coalesce(members, 0) END AS setup
  FROM n LEFT JOIN c USING (feature) LEFT JOIN m USING (feature)""")
def constellation(spark, sf):
    features = R.table(spark, sf, "nation").select(F.concat(F.lit("Brand#"), "n_nationkey").alias("feature"), F.col("n_nationkey").alias("seq"))
    nodes = R.plan(spark, sf).withColumns({"seq": F.col("id"), "role": F.when(F.col("feature") == "Brand#2", "tool").otherwise(F.col("role"))})
    return views.constellation(features, nodes, ["red", "nobody", "ring"]).withColumn("lenses", F.array_join("lenses", ","))


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_brand END AS feature, CASE p_partkey % 3 WHEN 0 THEN ['All', p_type, 'k' || p_partkey] WHEN 1 THEN ['All', p_type] ELSE CAST([] AS VARCHAR[]) END AS path FROM part),
  l AS (SELECT id, coalesce(feature, 'Unclassified') AS feature, path, unnest(range(1, len(path) + 1)) AS d FROM r), c AS (SELECT id, feature, d, path[d] AS name, list_slice(path, 1, d) AS lev, CASE WHEN d < len(path) THEN path[d + 1] ELSE 'row:' || id END AS child FROM l),
  k AS (SELECT feature, lev FROM c GROUP BY feature, lev HAVING count(DISTINCT child) > 1), s AS (SELECT id, string_agg(name, '/' ORDER BY d) AS shown FROM c JOIN k USING (feature, lev) GROUP BY id)
  SELECT id, coalesce(feature, 'Unclassified') AS feature, coalesce(shown, '') AS shown FROM r LEFT JOIN s USING (id)""")
def evolution_outline(spark, sf):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.array(F.lit("All"), F.lit(" "), "p_type", F.concat(F.lit("k"), k))).when(k % 3 == 1, F.array(F.lit(" All"), F.col("p_type")))
    rows = R.table(spark, sf, "part").select(k.alias("id"), F.when(k % 20 != 0, F.col("p_brand")).alias("feature"), path.alias("path"))
    return views.outline(rows).withColumn("shown", F.array_join("shown", "/"))


@query("SELECT DISTINCT w AS word, CAST(list_position(['red', 'ring', 'blue', 'gear'], w) - 1 AS INTEGER) AS place, ['#111', '#222', '#333'][(list_position(['red', 'ring', 'blue', 'gear'], w) - 1) % 3 + 1] AS colour FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w IN ('red', 'ring', 'blue', 'gear')")
def vocabulary_places(spark, sf):
    words = R.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return views.vocabulary_places(words, ["red", "ring", "blue", "gear"], ["#111", "#222", "#333"])


# --- reports ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {R.PLAN_SQL} SELECT count(*) AS checked, count(*) FILTER (WHERE status = 'implemented') AS implemented, count(*) FILTER (WHERE status = 'drifted') AS drifted, count(*) FILTER (WHERE status = 'error') AS errors, CAST(sum(id % 3) AS BIGINT) AS unsupported,
  CASE WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN 2 ELSE 1 END AS exit_code FROM plan""")
def verify_totals(spark, sf):
    results = R.plan(spark, sf).select("status", F.array_repeat(F.lit("x"), (F.col("id") % 3).cast("int")).alias("unsupported"))
    return reports.verify_exit_code(reports.verify_totals(results))


@query(f"WITH {R.LOG_SQL} SELECT event_type AS project, count(*) AS events, count(DISTINCT identity) AS declarations FROM log GROUP BY event_type")
def session_status(spark, sf):
    return reports.session_status(R.log(spark, sf).withColumnRenamed("event_type", "project"), "project")


@query(f"WITH {R.LOG_SQL} SELECT identity, count(*) AS changes, count(*) FILTER (WHERE type = 'added') AS added, count(*) FILTER (WHERE type = 'deleted') AS deleted, count(*) FILTER (WHERE type = 'changed') AS changed FROM log GROUP BY identity")
def scan_summary(spark, sf):
    return reports.scan_summary(R.log(spark, sf), "identity")


@query("SELECT reason, count(*) AS n, CASE WHEN count(*) = 1 THEN 'Summary step ' || min(id) || ' uses a fallback title: ' || reason ELSE count(*) || ' summary steps use fallback titles: ' || reason END AS line FROM (SELECT 's' || p_partkey AS id, CASE WHEN p_partkey = 5 THEN 'odd' ELSE p_type END AS reason FROM part) GROUP BY reason")
def fallback_lines(spark, sf):
    k = F.col("p_partkey")
    return reports.fallback_lines(R.table(spark, sf, "part").select(F.concat(F.lit("s"), k).alias("id"), F.when(k == 5, "odd").otherwise(F.col("p_type")).alias("reason")))


@query(f"WITH {R.SNAPSHOTS_SQL} SELECT a.identity, b.returns AS facts FROM snap_a a LEFT JOIN snap_b b ON b.identity = a.identity")
def evolution_facts(spark, sf):
    b, a = R.snapshots(spark, sf)
    return reports.facts_of(a.select("identity"), b.select("identity", F.col("returns").alias("facts")))


@query(f"WITH {R.LOG_SQL} SELECT identity, seq, 'n' || seq AS id, CAST(row_number() OVER (PARTITION BY identity ORDER BY seq) AS INTEGER) AS place FROM log")
def identity_index(spark, sf):
    return reports.identity_index(R.log(spark, sf).withColumn("id", F.concat(F.lit("n"), F.col("seq").cast("string"))))


@query("SELECT p_partkey AS id, unnest(CASE p_partkey % 4 WHEN 0 THEN [p_name, p_brand] WHEN 1 THEN CAST([] AS VARCHAR[]) ELSE [p_type] END) AS identity FROM part")
def node_identities(spark, sf):
    k = F.col("p_partkey") % 4
    own = F.when(k == 0, F.array("p_name", "p_brand")).when(k == 2, F.array().cast("array<string>"))
    return reports.node_identities(R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), own.alias("identities"), F.when(k == 1, "").when(k > 1, F.col("p_type")).alias("identity")))


@query(f"""WITH {R.SNAPSHOTS_SQL}, j AS (SELECT a.identity, b.numbers[1] AS n0, a.numbers[1] AS n1, list_filter(a.calls, lambda c: NOT list_contains(b.calls, c)) AS come, b.throws AS t0, a.throws AS t1, b.returns AS r0, a.returns AS r1, b.params AS p0, a.params AS p1 FROM snap_a a JOIN snap_b b USING (identity))
  SELECT identity, concat_ws(' | ', CASE WHEN n0 <> n1 THEN 'numbers ' || n0 || ' → ' || n1 END, CASE WHEN len(come) > 0 THEN 'calls +' || array_to_string(come, ', ') END, CASE WHEN p0 <> p1 THEN 'params [' || p0 || ',' || p1 || ']' END,
    CASE WHEN t0 <> t1 THEN 'throws [' || t0 || ',' || t1 || ']' END, CASE WHEN r0 <> r1 THEN 'returns [' || r0 || ',' || r1 || ']' END) AS text FROM j""")
def evolution_deltas(spark, sf):
    b, a = R.snapshots(spark, sf)
    facts = lambda: F.create_map(F.lit("numbers"), F.array_join(F.col("numbers").cast("array<string>"), ","), F.lit("calls"), F.array_join("calls", ","), *[x for c in ("params", "throws", "returns") for x in (F.lit(c), F.col(c).cast("string"))])
    both = a.select("identity", facts().alias("after")).join(b.select("identity", facts().alias("before")), "identity")
    return both.select("identity", reports.evolution_delta(F.col("before"), F.col("after")).alias("text"))


@query(f"""WITH {R.LOG_SQL}, p AS (SELECT *, CASE WHEN type <> 'added' THEN last_value(CASE WHEN type = 'added' THEN seq END IGNORE NULLS) OVER (PARTITION BY identity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM log),
  r AS (SELECT c.*, coalesce(p.ts, c.ts) AS t1, coalesce(p.seq, c.seq) AS s1, CASE WHEN p.seq IS NULL THEN 0 ELSE 1 END AS deep,
    CASE CAST(coalesce(p.identity, c.identity) AS BIGINT) % 7 WHEN 0 THEN 'Unclassified' WHEN 1 THEN 'later' ELSE 'f' || CAST(coalesce(p.identity, c.identity) AS BIGINT) % 7 END AS feature FROM p c LEFT JOIN p ON p.seq = c.parent),
  l AS (SELECT feature, t1, s1, deep, ts, seq, unnest([{{'part': 1, 'line': repeat('  ', deep + 1) || '- ' || CASE WHEN type <> 'deleted' THEN event_type ELSE 'Removed u' || identity END || CASE WHEN seq % 3 = 0 THEN ' `' || event_type || '` `x`' ELSE '' END}},
      {{'part': 2, 'line': CASE WHEN type = 'changed' AND before <> after THEN repeat('  ', deep + 1) || '  - numbers ' || before || ' → ' || after END}}]) AS x FROM r),
  h AS (SELECT DISTINCT feature, unnest([{{'part': -1, 'line': CASE WHEN feature <> (SELECT min(feature COLLATE NOCASE) FROM r) THEN '' END}}, {{'part': 0, 'line': '- **' || feature || '**'}}]) AS x FROM r),
  every AS (SELECT feature, 1 AS body, t1, s1, deep, ts, seq, x.part AS part, x.line AS line FROM l UNION ALL SELECT feature, 0, NULL, NULL, NULL, NULL, NULL, x.part, x.line FROM h)
  SELECT row_number() OVER (ORDER BY lower(feature), body, t1, s1, deep, ts, seq, part) AS n, line FROM every WHERE line IS NOT NULL""")
def evolution_markdown(spark, sf):
    """The history's Markdown, line by line: features by name, roots and their children by time, tags and deltas."""
    from ..operators import trees

    log = R.log(spark, sf)
    user, seq = F.col("identity").cast("long") % 7, F.col("seq")
    told = log.select(
        seq.alias("id"), "ts", "type", F.concat(F.lit("src/a.js::u"), "identity").alias("identity"), F.when(F.col("type") != "deleted", F.col("event_type")).alias("label"),
        F.when(user > 1, F.concat(F.lit("f"), user)).alias("feature"), F.when(user == 1, "later").alias("category"),
        F.when(seq % 3 == 0, F.array("event_type", F.lit(" x "))).alias("tags"),
        F.when((F.col("type") == "changed") & (F.col("before") != F.col("after")), F.concat(F.lit("numbers "), "before", F.lit(" → "), "after")).alias("delta"),
    )
    rows = told.join(events.lineage(log).select(seq.alias("id"), "parent"), "id")
    return trees.numbered(reports.evolution_lines(rows), ["place", "part"], "n").select("n", "line")


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
  t AS (SELECT c.id, CASE WHEN c.id % 97 = 0 THEN -1 WHEN c.id % 89 = 0 THEN c.id ELSE p.id END AS up, c.o_orderdate FROM o c LEFT JOIN o p ON p.o_custkey = c.o_custkey AND p.k = CASE WHEN c.o_custkey % 2 = 0 THEN c.k - 1 ELSE c.k // 3 END),
  w(id, root, depth, path) AS (SELECT id, id, 0, [{'d': o_orderdate, 'i': id}] FROM t WHERE up IS NULL UNION ALL SELECT t.id, w.root, w.depth + 1, list_append(w.path, {'d': t.o_orderdate, 'i': t.id}) FROM w JOIN t ON t.up = w.id),
  above AS (SELECT id, unnest(path).i AS over FROM w)
  SELECT w.id, root, depth, CAST(s.size AS BIGINT) AS size, row_number() OVER (ORDER BY path) - 1 AS place FROM w JOIN (SELECT over, count(*) AS size FROM above GROUP BY over) s ON s.over = w.id""")
def reading_order(spark, sf):
    """A customer's orders as a chain or a tree, some below missing rows and some in loops: places in reading order."""
    from pyspark.sql import Window

    from ..operators import trees

    o = R.table(spark, sf, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    above = o.select("o_custkey", F.col("k").alias("_k"), F.col("o_orderkey").alias("_up"))
    wanted = F.when(F.col("o_custkey") % 2 == 0, F.col("k") - 1).otherwise(F.expr("k div 3"))
    linked = o.withColumn("_k", wanted.cast("int")).join(above, ["o_custkey", "_k"], "left")
    up = F.when(F.col("o_orderkey") % 97 == 0, F.lit(-1)).when(F.col("o_orderkey") % 89 == 0, F.col("o_orderkey")).otherwise(F.col("_up"))
    return trees.preorder(linked.select(F.col("o_orderkey").alias("id"), up.alias("up"), "o_orderdate"), ["o_orderdate"])


# --- log -------------------------------------------------------------------------------------------------------------


@query(f"WITH {R.LOG_SQL} SELECT event_type AS session, count(DISTINCT identity) AS n FROM log GROUP BY event_type")
def distinct_identities(spark, sf):
    return events.distinct_identities(R.log(spark, sf).withColumnRenamed("event_type", "session"), "session")


@query(f"WITH {R.LOG_SQL} SELECT identity, arg_min_null(before, seq) AS before, arg_max_null(after, seq) AS after, count(*) AS event_count FROM log WHERE type = 'changed' AND seq % 4 <> 0 GROUP BY identity HAVING arg_min_null(before, seq) IS DISTINCT FROM arg_max_null(after, seq)")
def recovered_net_delta(spark, sf):
    return events.recovered_net_delta(R.log(spark, sf).withColumn("pair", F.col("seq") % 4 != 0), ["identity"])


WATCHED_SQL = """WITH RECURSIVE f AS (SELECT user_id % 5 AS project, ts, event_id AS seq, user_id AS who, CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'commit' WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'branch-switch' END AS control FROM events),
  e AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts, control IS NOT NULL, seq) AS n FROM f),
  fold(project, n, seq, ts, session, who, control, fresh) AS (
    SELECT project, n, seq, ts, CAST(CASE WHEN control IS NULL THEN 1 ELSE 0 END AS BIGINT), CASE WHEN control IS NULL THEN [who] ELSE CAST([] AS BIGINT[]) END, control, control IS NOT NULL FROM e WHERE n = 1
    UNION ALL SELECT e.project, e.n, e.seq, e.ts, CASE WHEN e.control IS NOT NULL THEN f.session WHEN f.fresh OR len(f.who) >= 20 OR e.ts - f.ts >= INTERVAL 30 MINUTE THEN f.session + 1 ELSE f.session END,
      CASE WHEN e.control IS NOT NULL THEN CAST([] AS BIGINT[]) WHEN f.fresh OR len(f.who) >= 20 OR e.ts - f.ts >= INTERVAL 30 MINUTE THEN [e.who] ELSE list_distinct(list_append(f.who, e.who)) END,
      e.control, e.control IS NOT NULL FROM fold f JOIN e ON e.project = f.project AND e.n = f.n + 1),
  s AS (SELECT project, session, max(n) FILTER (WHERE control IS NULL) AS last, max(ts) FILTER (WHERE control IS NULL) AS last_ts, max(len(who)) AS size FROM fold WHERE session > 0 GROUP BY project, session),
  b AS (SELECT s.project, s.session, CASE WHEN size >= 20 THEN 'cap' WHEN nxt.ts - last_ts >= INTERVAL 30 MINUTE THEN 'idle' WHEN nxt.control = 'commit' THEN 'git' WHEN nxt.control IS NOT NULL THEN nxt.control WHEN nxt.n IS NULL THEN 'open' ELSE 'idle' END AS sealed_by FROM s LEFT JOIN e nxt ON nxt.project = s.project AND nxt.n = s.last + 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY session) AS number FROM b WHERE sealed_by <> 'branch-switch')"""


def watched_feed(events_table):
    """project, ts, seq, user_id, kind: the events, of which some errors stand for commits and branch switches."""
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "commit").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 1), "branch-switch")
    return events_table.select((F.col("user_id") % 5).cast("int").alias("project"), F.col("event_id").alias("seq"), "ts", "user_id", kind.alias("kind"))


@query(WATCHED_SQL + """
  SELECT CAST(fold.project AS INTEGER) AS project, seq, CAST(number AS INTEGER) AS session, sealed_by FROM fold JOIN k ON k.project = fold.project AND k.session = fold.session WHERE control IS NULL""")
def watched_sessions(spark, sf):
    feed = watched_feed(R.table(spark, sf, "events"))
    return events.watched_sessions(feed.where("kind is null").drop("kind"), feed.where("kind is not null").select("project", "ts", "kind"), "project", "user_id")


@query(f"""WITH {R.SNAPSHOTS_SQL}, {R.LOG_SQL.strip()} SELECT identity, 'deleted' AS type FROM snap_b WHERE file IN ('Brand#1', 'Brand#2', 'Brand#9') AND file <> 'Brand#2' AND seq % 13 <> 0""")
def removed_files(spark, sf):
    b, _ = R.snapshots(spark, sf)
    removals = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#9",), ("nowhere",)], "file string")
    history = b.where("seq % 13 = 0").select("identity", F.lit("deleted").alias("type")).unionByName(b.where("seq % 13 = 1").select("identity", F.lit("added").alias("type")))
    return events.removed_files(removals, b, spark.createDataFrame([("Brand#2", 0), ("Brand#1", 3)], "file string, n int"), history)


@query("""WITH f AS (SELECT event_id AS seq, ts, user_id AS file, event_type FROM events) SELECT seq, CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END AS op FROM f
  QUALIFY event_type = 'error' OR coalesce(lead(ts) OVER (PARTITION BY file ORDER BY ts, seq) - ts >= INTERVAL 900 SECOND, true)""")
def routed_feed(spark, sf):
    feed = R.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("file"), F.when(F.col("event_type") == "error", "unlink").otherwise("change").alias("op"))
    return events.routed(feed, 900).select("seq", "op")


@query("""SELECT CAST(user_id AS INTEGER) AS project, event_id AS seq, CASE WHEN branch IS DISTINCT FROM was THEN 'branch-switch' ELSE 'commit' END AS kind FROM (SELECT *, event_type AS branch, lag(event_type) OVER w AS was, floor(value) AS head, lag(floor(value)) OVER w AS old, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
  WHERE n > 1 AND (branch IS DISTINCT FROM was OR head IS DISTINCT FROM old)""")
def git_boundaries(spark, sf):
    e = R.table(spark, sf, "events")
    polls = e.select(F.col("user_id").cast("int").alias("project"), "ts", F.floor("value").cast("string").alias("head"), F.col("event_type").alias("branch"))
    found = readers.git_boundaries(polls, "project")
    return found.join(e.select(F.col("user_id").cast("int").alias("project"), "ts", F.col("event_id").alias("seq")), ["project", "ts"]).select("project", "seq", "kind")


@query("""SELECT page_id, contains('/' || p, '/build/') OR contains('/' || p, '/.cache/') OR (k <> 3 AND (string_split(p, '/')[-1] = '.DS_Store' OR (k <> 4 AND NOT regexp_matches(p, '(?i)\\.(js|ts|tsx|py)$')) OR (k <> 4 AND regexp_matches(p, '(?i)\\.d\\.ts$')))) AS ignored
  FROM (SELECT page_id, page_id % 5 AS k, ['src/a' || page_id || '.TS', 'build/x.js', 'a/.cache/y.py', 'src/dir', 'a/.DS_Store', 'types.d.ts', 'notes.md'][page_id % 7 + 1] AS p FROM pages)""")
def ignored_paths(spark, sf):
    k = F.col("page_id") % 5
    paths = F.array(F.concat(F.lit("src\\a"), "page_id", F.lit(".TS")), F.lit("build/x.js"), F.lit("a/.cache/y.py"), F.lit("src/dir"), F.lit("a/.DS_Store"), F.lit("types.d.ts"), F.lit("notes.md"))
    path = F.element_at(paths, (F.col("page_id") % 7 + 1).cast("int"))
    is_file = F.when(k == 3, F.lit(False)).when(k != 4, F.lit(True))  # some are folders, of some it is not known yet
    return R.table(spark, sf, "pages").select("page_id", readers.should_ignore(path, is_file).alias("ignored"))


# --- plain functions -------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, regexp_escape(p_name || '.(x)') = regexp_escape(p_name || '.(x)') AND regexp_matches(p_name || '.(x)', '^' || replace(p_name, ' ', '\\s') || '\\.\\(x\\)$') AS matches, CASE WHEN p_partkey % 9 = 0 THEN 'unknown' ELSE p_name || ' \\| x y' END AS cell,
  '&lt;b c=&quot;' || p_name || '&quot;&gt;&amp;&#39;' AS markup, p_name AS bare, CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '[]' ELSE '[' || p_name || ', x]' END AS listed, CAST(floor(p_size / 8.0 + 0.5) * 8 AS BIGINT) AS snapped, CAST(greatest(5, least(20, p_size)) AS INTEGER) AS clamped,
  ['a', 'b', 'c'][((p_partkey - 5) % 3 + 3) % 3 + 1] AS colour FROM part""")
def text_cleanup(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    odd = F.concat(name, F.lit(".(x)"))
    listed = F.when(k % 3 == 1, F.array().cast("array<string>")).when(k % 3 == 2, F.array(name, F.lit("x")))
    return R.table(spark, sf, "part").select(
        k.alias("id"), F.regexp_like(odd, F.concat(F.lit("^"), T.escape_pattern(odd), F.lit("$"))).alias("matches"), T.escape_cell(F.when(k % 9 != 0, F.concat(name, F.lit(" | x\ny")))).alias("cell"),
        T.escape_markup(F.concat(F.lit('<b c="'), name, F.lit("\">&'"))).alias("markup"), T.unquoted(F.concat(F.lit("'"), name, F.lit('"'))).alias("bare"), T.shown_list(listed).alias("listed"),
        T.snapped(F.col("p_size"), 8).alias("snapped"), T.clamped(F.col("p_size"), 5, 20).cast("int").alias("clamped"), T.of_palette(["a", "b", "c"], k - 5).alias("colour"),
    )


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE '{\"k\": ' || p_partkey || '}' END AS json, CASE WHEN p_partkey % 2 = 0 THEN 'x:1>2,z:none>3' ELSE 'x:1>2' END AS delta FROM part")
def json_and_maps(spark, sf):
    k = F.col("p_partkey")
    body = F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}"))
    answer = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit(" Here it is: "), body, F.lit(" Done."))).when(k % 4 == 2, body).otherwise(F.lit("no {json at all"))
    after = F.when(k % 2 == 0, F.create_map(F.lit("x"), F.lit("2"), F.lit("y"), F.lit("1"), F.lit("z"), F.lit("3"))).otherwise(F.create_map(F.lit("x"), F.lit("2"), F.lit("y"), F.lit("1")))
    delta = T.compact_delta(F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("1")), after)
    none = lambda c: F.coalesce(c, F.lit("none"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries(delta)), lambda e: F.concat(e["key"], F.lit(":"), none(e["value"]["before"]), F.lit(">"), none(e["value"]["after"]))), ",")
    return R.table(spark, sf, "part").select(k.alias("id"), T.model_json(answer).alias("json"), told.alias("delta"))
