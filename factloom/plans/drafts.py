"""Queries over drafted steps and designs: parts as steps, their neighbours as the declarations that they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drafts as D
from ..operators.skew import spread
from . import relations as R
from .registry import query

_PAD = "CASE WHEN length(CAST({0} AS VARCHAR)) >= 4 THEN CAST({0} AS VARCHAR) ELSE lpad(CAST({0} AS VARCHAR), 4, '0') END"

_CLAUSE = "struct<field:string,op:string,value_num:double,value_str:string>"


def _drafted(spark, sf):
    """Three of four parts are steps, every fourth also for the part after it; some are wrong, some settled by hand."""
    p = spread(R.table(spark, sf, "part"), "p_partkey")
    k = F.col("p_partkey")
    one = F.concat(F.lit("d"), k.cast("string"))
    clause = lambda field, op, num, text=None: F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), F.lit(num).cast("double").alias("value_num"), F.lit(text).cast("string").alias("value_str"))
    rule = lambda kind, *clauses: F.struct(kind.alias("kind"), one.alias("target"), F.array(*clauses).cast(f"array<{_CLAUSE}>").alias("clauses"))
    behaviour = F.lit("behaviour")
    drafts = p.where(k % 4 != 1).select(
        k.alias("seq"), F.when(k % 4 == 0, F.array(one, F.concat(F.lit("d"), (k + 1).cast("string")), one)).otherwise(F.array(one, F.lit(" "))).alias("identities"), F.when(k % 20 != 7, F.concat(F.lit(" "), "p_name")).alias("title"), F.lit("why").alias("intent"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).when(k % 3 == 1, F.lower("p_brand")).otherwise("p_type").alias("feature"), F.when(k % 2 == 1, " START_UP ").alias("role"), F.col("p_size").cast("double").alias("step"),
        F.array(F.lit("SQL"), F.lit("odd")).alias("lens_tags"), F.array(F.lit("noun")).alias("dimensions"), F.create_map(F.lit("backend"), F.upper("p_name"), F.lit("security"), F.lit(" as is ")).alias("readings"),
        F.array(rule(F.when(k % 18 != 5, behaviour).otherwise("structure"), clause("throws", "<=", 1)), rule(behaviour, clause("calls", ">=", 1), clause("calls", "contains", None, "call")), rule(behaviour, clause("odd", "==", 1))).alias("rules"),
    )
    facts = F.struct((F.col("p_size") % 3).cast("int").alias("throws"), F.when(k % 8 < 4, F.array(F.lit("call"))).otherwise(F.array().cast("array<string>")).alias("calls"))
    candidates = p.select(one.alias("identity"), F.when(k % 5 == 0, F.array(F.lit("security"))).alias("lens_tags"), F.when(k % 15 != 2, F.col("p_brand")).alias("stage"), F.when(k % 4 == 2, "tool").alias("role"), facts.alias("facts"))
    features = p.groupBy("p_brand").agg(F.min("p_partkey").alias("seq")).select(F.lower("p_brand").alias("id"), F.col("p_brand").alias("name"), "seq")
    plan = p.where(k % 13 == 0).select(F.concat(F.lit("plan_"), k.cast("string")).alias("id"), F.array(one).alias("identities"), F.when(k % 2 == 0, "human_authored").otherwise("ai_edited_by_human").alias("origin"))
    return drafts, candidates, features, plan, {"sql": "database"}


_DRAFT_SQL = f"""WITH c AS (SELECT p_partkey AS k, p_size % 3 <= 1 AS few, p_partkey % 8 < 4 AS calls FROM part), top AS (SELECT max(p_partkey) AS last, max(p_partkey) FILTER (WHERE p_partkey % 13 = 0) + 1 AS n FROM part),
  d AS (SELECT p.p_partkey AS k, p_name, p_brand, p_size, p_partkey % 4 = 0 AS two, p_partkey % 13 = 0 OR p_partkey % 4 = 0 AND (p_partkey + 1) % 13 = 0 AS aside, a.few AND b.few OR a.calls AND b.calls AS whole,
    CASE WHEN p_partkey % 4 = 0 AND p_partkey = last THEN 'not asked about' WHEN p_partkey % 13 = 0 OR p_partkey % 4 = 0 AND (p_partkey + 1) % 13 = 0 THEN '' WHEN p_partkey % 20 = 7 THEN 'no title'
         WHEN p_partkey % 18 = 5 THEN 'no behaviour rule' WHEN p_partkey % 15 = 2 THEN 'unknown feature' END AS problem
    FROM part p JOIN c a ON a.k = p_partkey LEFT JOIN c b ON b.k = p_partkey + 1 CROSS JOIN top WHERE p_partkey % 4 <> 1),
  g AS (SELECT *, unnest(CASE WHEN NOT two OR whole THEN [0] ELSE [0, 1] END) AS piece FROM d WHERE problem IS NULL) """


@query(_DRAFT_SQL + f"""SELECT 'plan_' || {_PAD.format("((SELECT n FROM top) + row_number() OVER (ORDER BY k, piece) - 1)")} AS id, k AS seq, 'd' || (k + piece) AS "identity", lower(p_brand) AS feature, CAST(CASE WHEN two AND whole THEN 2 ELSE 1 END AS INTEGER) AS n_identities,
    trim(p_name) AS title, CASE WHEN k % 2 = 1 THEN 'machinery' WHEN k % 4 = 2 THEN 'tool' ELSE 'behaviour' END AS role, CASE WHEN k % 5 = 0 THEN 'security' ELSE 'database' END AS lenses, CASE WHEN two AND whole THEN 'noun' END AS dimension,
    CAST(CASE WHEN two AND whole THEN 4 ELSE 2 END AS INTEGER) AS n_rules, 1 AS n_readings, CAST(p_size AS DOUBLE) AS step FROM g""")
def normalised_draft(spark, sf):
    nodes = D.normalise_draft(*_drafted(spark, sf))[0]
    n = F.coalesce(F.size("identities"), F.lit(1)).alias("n_identities")
    return nodes.select("id", "seq", "identity", "feature", n, "title", "role", F.array_join("lens_tags", ",").alias("lenses"), F.get("dimensions", F.lit(0)).alias("dimension"), F.size("rules").alias("n_rules"), F.size("readings").alias("n_readings"), "step")


@query(_DRAFT_SQL + """, held AS (SELECT k FROM d WHERE problem IS NULL UNION SELECT k + 1 FROM d WHERE problem IS NULL AND two)
  SELECT 'skipped' AS kind, k AS seq, 'd' || k AS subject, problem AS reason FROM d WHERE problem <> ''
  UNION ALL SELECT 'dropped', k, 'd' || k, unnest(['needs a number', 'unknown field']) FROM d WHERE problem IS NULL OR problem = 'unknown feature'
  UNION ALL SELECT 'split', k, 'd' || k, 'no assertion holds for all' FROM d WHERE problem IS NULL AND two AND NOT whole
  UNION ALL SELECT 'missing', NULL, 'd' || k, 'never mentioned' FROM c WHERE k % 13 <> 0 AND k NOT IN (SELECT k FROM held)""")
def draft_notes(spark, sf):
    return D.normalise_draft(*_drafted(spark, sf))[1]


def _designed(spark, sf, wrong: bool):
    """Brands as lenses, part types as features, parts as nodes that lead to the parts of half and of twice their number."""
    p = R.table(spark, sf, "part")
    k = F.col("p_partkey")
    place = lambda c: p.groupBy(c).agg(F.min("p_partkey").alias("seq"))
    lenses = place("p_brand").select("seq", F.concat(F.lit("l "), "p_brand").alias("temp_id"), F.col("p_brand").alias("label"))
    features = place("p_type").select("seq", F.concat(F.lit(" "), "p_type").alias("temp_id"), F.col("p_type").alias("name"))
    last = p.agg(F.max("p_partkey").alias("last"))  # one row
    half, twice = F.expr("p_partkey div 2").cast("string"), F.when((k * 2 <= F.col("last")) | (F.lit(wrong) & (k % 7 == 0)), k * 2).otherwise(k).cast("string")
    bad = lambda n, value, good: F.when(F.lit(wrong) & (k % 10 == n), value).otherwise(good)
    nodes = p.join(F.broadcast(last)).select(
        k.alias("seq"), bad(1, F.lit("7"), k.cast("string")).alias("temp_id"), bad(2, F.lit("none"), F.concat("p_type", F.lit(" "))).alias("feature"), bad(3, F.lit(" "), F.col("p_name")).alias("title"), F.lit("why").alias("intent"),
        F.array(bad(4, F.lit("l"), F.concat(F.lit("l "), "p_brand"))).alias("lens_tags"), F.array(half, F.concat(F.lit(" "), twice)).alias("edges_out"),
    )
    region = R.table(spark, sf, "region")
    old = region.select(F.concat(F.lit("lens_"), "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("derived").alias("source")), region.select(F.concat(F.lit("feat_"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("derived").alias("source"))
    return lenses, features, nodes, *old, region.select(F.concat(F.lit("plan_"), "r_regionkey").alias("id"))


_DESIGN_SQL = """WITH top AS (SELECT (SELECT max(r_regionkey) + 1 FROM region) AS n, (SELECT max(p_partkey) FROM part) AS last), l AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) AS r FROM part GROUP BY p_brand),
  f AS (SELECT p_type, row_number() OVER (ORDER BY min(p_partkey)) AS r FROM part GROUP BY p_type), p AS (SELECT p_partkey AS k, p_name, p_brand, p_type, row_number() OVER (ORDER BY p_partkey) AS r FROM part) """


@query(_DESIGN_SQL + f"""SELECT 'plan_' || {_PAD.format('(n + p.r - 1)')} AS id, p.k AS seq, 'feat_' || {_PAD.format('(n + f.r - 1)')} AS feature, trim(p.p_name) AS title, 'lens_' || {_PAD.format('(n + l.r - 1)')} AS lenses,
  'plan_' || {_PAD.format('(n + a.r - 1)')} || ',plan_' || {_PAD.format('(n + b.r - 1)')} AS edges FROM p CROSS JOIN top JOIN l USING (p_brand) JOIN f USING (p_type) JOIN p a ON a.k = p.k // 2 JOIN p b ON b.k = CASE WHEN p.k * 2 <= last THEN p.k * 2 ELSE p.k END""")
def normalised_design(spark, sf):
    nodes = D.normalise_design(*_designed(spark, sf, False))[2]
    return nodes.select("id", "seq", "feature", "title", F.array_join("lens_tags", ",").alias("lenses"), F.array_join("edges_out", ",").alias("edges"))


@query("""WITH p AS (SELECT p_partkey AS k, max(p_partkey) OVER () AS last FROM part), w AS (SELECT *, CASE k % 10 WHEN 1 THEN CASE WHEN k > 1 THEN 'repeated temporary id' END WHEN 2 THEN 'unknown feature' WHEN 3 THEN 'no title' WHEN 4 THEN 'unknown lens' WHEN 7 THEN CASE WHEN k = 7 THEN 'repeated temporary id' END END AS problem FROM p),
  known AS (SELECT CASE WHEN k = 1 THEN 7 ELSE k END AS k FROM w WHERE problem IS NULL), t AS (SELECT k, k // 2 AS a, CASE WHEN k * 2 <= last OR k % 7 = 0 THEN k * 2 ELSE k END AS b FROM p)
  SELECT 'node' AS what, k AS seq, problem FROM w WHERE problem IS NOT NULL
  UNION ALL SELECT 'edge', k, 'leads to an unknown node' FROM t WHERE a NOT IN (SELECT k FROM known) OR b NOT IN (SELECT k FROM known)""")
def design_problems(spark, sf):
    return D.design_problems(*_designed(spark, sf, True))
