"""Queries over evolution rows, feature edges and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evolution as E
from ..operators import graph, views
from . import relations as R
from .registry import query


@query(f"""WITH {R.LOG_SQL} SELECT seq, CASE WHEN seq % 5 = 0 THEN 'done' WHEN seq % 3 = 0 AND event_type <> 'view' THEN event_type ELSE type END AS label,
  CASE WHEN seq % 5 = 0 THEN 'kept' WHEN seq % 3 = 0 AND event_type <> 'view' THEN 'model' ELSE 'fallback' END AS source FROM log""")
def apply_labels(spark, sf):
    log = R.log(spark, sf)
    rows = log.select("ts", "identity", "type", F.when(F.col("seq") % 5 == 0, "done").alias("label"))
    labels = log.where("seq % 3 = 0").select("ts", "identity", F.col("event_type").alias("label"))
    out = E.apply_labels(rows, labels, F.col("type"), ["view"])
    return out.join(log.select("ts", "identity", "seq"), ["ts", "identity"]).select("seq", "label", "source")


@query(f"""WITH {R.LOG_SQL}, r AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS identity, bool_or(o_orderstatus = 'F') AS a FROM orders WHERE o_custkey % 200 < 70 GROUP BY 1)
  SELECT seq, identity, CASE WHEN after % 2 = 0 THEN 'implemented' WHEN a THEN 'approved' ELSE 'intended' END AS status FROM log LEFT JOIN r USING (identity)""")
def apply_rule_status(spark, sf):
    log = R.log(spark, sf).select("seq", "identity", (F.col("after") % 2 == 0).alias("verified"), F.when(F.col("after") % 2 == 0, "implemented").otherwise("intended").alias("status"))
    rules = R.table(spark, sf, "orders").where("o_custkey % 200 < 70").select((F.col("o_custkey") % 200).cast("string").alias("target"), (F.col("o_orderstatus") == "F").alias("approved"))
    return E.apply_rule_status(log, rules)


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS id, p_partkey % 4 // 2 AS feature, CASE p_partkey % 50 WHEN 20 THEN p_partkey + 1 WHEN 21 THEN p_partkey - 1 WHEN 22 THEN p_partkey - 1 WHEN 30 THEN p_partkey + 1 WHEN 31 THEN p_partkey + 1
    WHEN 32 THEN p_partkey - 2 WHEN 40 THEN p_partkey ELSE CASE WHEN p_partkey > 0 THEN p_partkey // 2 END END AS parent FROM part),
  every AS (SELECT c.id, p.id AS up, c.feature = p.feature AS same FROM t c LEFT JOIN t p ON p.id = c.parent),
  ends(id) AS (SELECT id FROM every WHERE up IS NULL UNION ALL SELECT e.id FROM ends JOIN every e ON e.up = ends.id),
  l AS (SELECT id, CASE WHEN same AND id IN (SELECT id FROM ends) THEN up END AS up FROM every),
  w(id, root, depth) AS (SELECT id, id, 0 FROM l WHERE up IS NULL UNION ALL SELECT l.id, w.root, w.depth + 1 FROM w JOIN l ON l.up = w.id) SELECT id, root, depth FROM w""")
def evolution_forest(spark, sf):
    """Parts under half their number, with loops of one, two and three and rows that hang on them."""
    parent = F.expr("case p_partkey % 50 when 20 then p_partkey + 1 when 21 then p_partkey - 1 when 22 then p_partkey - 1 when 30 then p_partkey + 1 when 31 then p_partkey + 1 when 32 then p_partkey - 2 when 40 then p_partkey else if(p_partkey > 0, p_partkey div 2, null) end")
    return E.forest(R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey % 4 div 2").alias("feature"), parent.alias("parent")))


@query(f"""WITH RECURSIVE {R.EDGES_SQL.strip()}, w(id, depth) AS (SELECT 'supplier:3', 0 UNION SELECT e."from", w.depth + 1 FROM w JOIN edges e ON e."to" = w.id WHERE w.depth < 2)
  SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE id <> 'supplier:3' GROUP BY id""")
def callers_by_depth(spark, sf):
    return graph.impact_levels(R.edges(spark, sf), "supplier:3", 2)


@query(f"WITH {R.PLAN_SQL} SELECT feature, role, count(*) AS n, min(id) AS first FROM plan GROUP BY feature, role")
def feature_registers(spark, sf):
    return R.plan(spark, sf).groupBy("feature", "role").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(w) ELSE w END AS tag FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)),
  c AS (SELECT lower(tag) AS k, arg_min(tag, id) AS spelling FROM t GROUP BY 1) SELECT id, array_to_string(list_sort(list_distinct(list(spelling))), ',') AS tags FROM t JOIN c ON k = lower(tag) GROUP BY id""")
def canonical_tags(spark, sf):
    part = R.table(spark, sf, "part")
    tags = part.select(F.col("p_partkey").alias("seq"), F.explode(F.split("p_name", " ")).alias("w")).select("seq", F.when(F.col("seq") % 3 == 0, F.upper("w")).otherwise(F.col("w")).alias("tag"))
    spelt = views.first_spellings(tags, "tag")
    joined = tags.join(spelt, F.lower("tag") == F.col("key"))
    return joined.groupBy(F.col("seq").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("spelling")), ",").alias("tags"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def since_refresh(spark, sf):
    seen = R.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(seen, "id", "left_anti")


@query(f"""WITH {R.EDGES_SQL} SELECT DISTINCT "from" AS other, 'in' AS direction FROM edges WHERE "to" = 'supplier:3' AND "from" IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
  UNION ALL SELECT DISTINCT "to", 'out' FROM edges WHERE "from" = 'supplier:3' AND "to" LIKE 'order:%'""")
def call_arcs(spark, sf):
    visible = R.table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return E.call_arcs(R.edges(spark, sf), "supplier:3", visible)


@query(f"""WITH {R.EDGES_SQL}, e AS (SELECT DISTINCT "from" AS other, 'in' AS direction FROM edges WHERE "to" = 'supplier:3' UNION ALL SELECT DISTINCT "to", 'out' FROM edges WHERE "from" = 'supplier:3')
  SELECT other, direction, other IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0) AS inside FROM e""")
def call_chips(spark, sf):
    shown = R.table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return E.call_chips(R.edges(spark, sf), "supplier:3", shown)


@query("""WITH t AS (SELECT p_partkey AS pos, i, w AS tag FROM part, LATERAL (SELECT unnest([p_name || '', 'RED', 'blue', 'Red', 'big', 'other']) AS w, unnest([0, 1, 2, 3, 4, 5]) AS i)), k AS (SELECT pos, CASE lower(tag) WHEN 'red' THEN 'Red' WHEN 'blue' THEN 'BLUE' ELSE tag END AS tag, min(i) AS i FROM t GROUP BY ALL),
  r AS (SELECT pos, tag, i, row_number() OVER (PARTITION BY pos ORDER BY i) AS n FROM k) SELECT pos, string_agg(tag, ',' ORDER BY i) AS tags, any_value(p_type || CASE WHEN p_type = p_brand THEN '' ELSE '/' || p_brand END) AS path FROM r JOIN part ON p_partkey = pos WHERE n <= 3 GROUP BY pos""")
def cleaned_labels(spark, sf):
    labels = R.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.array(F.col("p_name"), *map(F.lit, ("RED", "blue", "Red", "big", "other"))).alias("tags"), F.array("p_type", "p_type", "p_brand", "p_brand").alias("path"))
    out = E.cleaned_labels(labels, spark.createDataFrame([("red", "Red"), ("blue", "BLUE")], "key string, spelling string"))
    return out.select("pos", F.array_join("tags", ",").alias("tags"), F.array_join("path", "/").alias("path"))


@query(f"""WITH {R.PLAN_SQL}, calls AS (SELECT DISTINCT a.feature AS f, b.feature AS t FROM plan a JOIN plan b ON b.id = a.parent WHERE a.feature <> b.feature),
  o AS (SELECT feature AS f, lead(feature) OVER (ORDER BY feature) AS t FROM (SELECT DISTINCT feature FROM plan))
  SELECT f AS "from", t AS "to", 'call' AS kind FROM calls UNION ALL SELECT f, t, 'order' FROM o WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.f = o.f AND c.t = o.t)""")
def constellation_edges(spark, sf):
    p = R.plan(spark, sf)
    lifted = views.feature_edges(p.select(F.col("id").alias("from"), F.col("parent").alias("to")), p.select("id", "feature"))
    return E.with_order_edges(lifted, p.select("feature").distinct(), ["feature"])


@query("""SELECT n_nationkey AS id, CAST(row_number() OVER (ORDER BY CASE n_regionkey WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 2147483647 END, n_nationkey) AS INTEGER) AS place FROM nation""")
def feature_order(spark, sf):
    rows = R.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Region"), F.col("n_regionkey")).alias("feature"))
    return E.in_feature_order(rows, spark.createDataFrame([("REGION2", 1), ("region0", 2)], "name string, rank int"), "id").select("id", "place")


@query("""WITH w AS (SELECT lower(p_name) AS k, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS seq FROM part GROUP BY 1)
  SELECT 'lens_' || lpad(CAST(row_number() OVER (ORDER BY seq) + 2 AS VARCHAR), 4, '0') AS id, name FROM w WHERE k NOT IN ('red ring', 'blue gear')""")
def vocabulary_insert(spark, sf):
    known = spark.createDataFrame([("RED ring",), ("Blue gear",)], "name string")
    return E.insert_missing(known, R.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq")), "name", "lens_")


@query(f"""WITH {R.LOG_SQL}, g AS (SELECT seq AS pos, CASE WHEN seq % 50 = 0 THEN 'x' ELSE identity END AS identity, CASE WHEN seq % 40 = 0 THEN 'a b c d e f g h i' WHEN seq % 30 = 0 THEN 'misc' ELSE 'fine label' END AS label FROM log WHERE seq % 60 <> 1)
  SELECT pos, e AS error FROM (SELECT log.seq AS pos, unnest([CASE WHEN g.identity IS DISTINCT FROM log.identity THEN 'out of place' END, CASE WHEN label = 'a b c d e f g h i' THEN 'too long' END, CASE WHEN label = 'misc' THEN 'forbidden' END]) AS e
    FROM log LEFT JOIN g ON g.pos = log.seq) WHERE e IS NOT NULL""")
def validate_labels(spark, sf):
    log = R.log(spark, sf).withColumnRenamed("seq", "pos")
    label = F.when(F.col("pos") % 40 == 0, "a b c d e f g h i").when(F.col("pos") % 30 == 0, "Misc").otherwise("fine label")
    given = log.where("pos % 60 <> 1").select("pos", "ts", F.when(F.col("pos") % 50 == 0, "x").otherwise(F.col("identity")).alias("identity"), label.alias("label"))
    return E.label_errors(given, log, 8, ["misc"])


@query("""SELECT CAST(user_id % 20 AS INTEGER) AS run, max(CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INTEGER) END) AS total, CAST(max(CASE WHEN event_type = 'click' THEN 10 END) AS INTEGER) AS batches,
  CAST(max(CASE WHEN event_type = 'click' THEN event_id % 10 END) AS INTEGER) AS last_batch FROM events GROUP BY 1""")
def scan_progress(spark, sf):
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("found "), F.floor("value").cast("string"), F.lit(" declarations"))).when(F.col("event_type") == "click", F.concat(F.lit("batch "), (F.col("event_id") % 10).cast("string"), F.lit("/10"))).otherwise("idle")
    return E.scan_progress(R.table(spark, sf, "events").select((F.col("user_id") % 20).cast("int").alias("run"), line.alias("line")))


@query("""SELECT c_custkey AS id, CASE WHEN n = 0 THEN 'missing' WHEN f = 0 THEN 'no-plan' WHEN p > 0 THEN 'invalid-plan' ELSE 'ready' END AS state, CASE WHEN p > 0 THEN 2 WHEN f > 0 THEN 1 ELSE 0 END AS exit_code
  FROM (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 400000) AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def view_state(spark, sf):
    orders = R.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)).alias("p"))
    rows = R.table(spark, sf, "customer").join(orders, "c_custkey", "left").fillna(0, ["n", "f", "p"])
    judged = views.view_state(rows.withColumns({"has_project": F.col("n") > 0, "has_plan": F.col("f") > 0, "plan_valid": F.col("p") == 0}))
    return judged.select(F.col("c_custkey").alias("id"), "state", F.when(F.col("p") > 0, 2).when(F.col("f") > 0, 1).otherwise(0).alias("exit_code"))


@query(f"WITH {R.PLAN_SQL} SELECT status, count(*) AS n FROM plan WHERE status <> 'superseded' GROUP BY status")
def plan_status_counts(spark, sf):
    return R.plan(spark, sf).where("status <> 'superseded'").groupBy("status").agg(F.count("*").alias("n"))
