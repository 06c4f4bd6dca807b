"""Queries over source texts: import records, their resolution, the impact graph and callers.

The texts are derived from parts: part k is a script that calls the function of part k div 2, and every second one a Python module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions import imports as records
from ..operators import graph, imports
from ..operators.skew import spread
from . import relations as R
from .registry import query

# Names of part {k}'s script; every fiftieth cannot be parsed.
_PATH = "concat('src/g', {k} % 5, '/f', {k}, case when {k} % 3 = 0 then '.js' else '.ts' end)"
_PLACE = "concat('../g', {k} % 5, '/f', {k})"
_LINES = (
    "if(k % 50 = 49, 'function (', '')",
    "if(k > 0, concat('import {run', t, '} from \"', {place}, element_at(array('.js', '', '.ts', '/index'), int(k % 4) + 1), '\";'), '')",
    "if(k > 0 and k % 3 = 0, concat('import Def, * as all', k, ' from \"', {place}, '\";'), '')",
    "if(k > 0 and k % 5 = 0, concat('const {help, other: o2} = require(\"./gone', k, '\");'), '')",
    "if(k > 0 and k % 7 = 0, 'import ext from \"lodash\";', '')",
    "if(k > 0 and k % 6 = 3, concat('import {again as b} from \"../g', u % 5, '/f', u, '\";'), '')",
    "if(k > 0 and k % 6 = 1, concat('export {run', t, ' as again} from \"', {place}, '\";'), '')",
    "if(k > 0 and k % 8 = 2, concat('const api = require(\"', {place}, '\");'), '')",
    "concat('export function run', k, '(a) { return ', if(k > 0, concat('run', t, '(a, ', k, ')'), 'a'), '; }')",
    "if(k % 2 = 0, concat('export default class C', k, ' { static make() {} get size() { return null; } }'), '')",
    "if(k % 4 = 1, concat('const LIST', k, ' = [\\'a', k, '\\', \"b\", { x: 1 }];'), '')",
    "if(k % 4 = 2, concat('function hook', k, '() { init({ cb: run', k, ', n: 7 }); }'), '')",
)
_PY_LINES = (
    "concat('from ..p', t % 3, '.m', t, ' import f', t, ', missing')", "'import py.p0.m0 as z'", "'import os'", "'import py.none'", "'from . import m0'", "'from ..p0 import zero'", "'from ....x import y'",
    "'from ..p1 import *'", "concat('def f', k, '(): return 1')",
)


def source_texts(spark, sf) -> DataFrame:
    """path, content, in as many tasks as can parse them at a time."""
    part = spread(R.table(spark, sf, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 2").alias("t"), F.expr("p_partkey div 6 * 6 + 1").alias("u"))
    lines = [x.replace("{place}", _PLACE.replace("{k}", "t")) for x in _LINES]
    scripts = part.select(F.expr(_PATH.replace("{k}", "k")).alias("path"), F.concat_ws("\n", *map(F.expr, lines)).alias("content"))
    even = part.where("k % 2 = 0 and k > 0").withColumn("t", F.expr("k div 4 * 2"))
    modules = even.select(F.expr("concat('py/p', k % 3, '/m', k, '.py')").alias("path"), F.concat_ws("\n", *map(F.expr, _PY_LINES)).alias("content"))
    fixed = [("py/__init__.py", ""), ("py/p0/__init__.py", "from .m0 import f0 as zero"), ("py/p1/__init__.py", ""), ("py/p2/__init__.py", ""), ("py/p0/m0.py", "def f0(): return 0")]
    return scripts.unionByName(modules).unionByName(spark.createDataFrame(fixed, "path string, content string"))


def _declarations(texts: DataFrame) -> DataFrame:
    return extract.extract_declarations(texts)


def _resolved(spark, sf) -> DataFrame:
    texts = source_texts(spark, sf)
    return _imported(texts, graph.reliable(_declarations(texts)))


def _imported(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Resolved imports of texts whose declarations are ``found``."""
    failed = found.where("failed").select(F.col("file").alias("path"), F.lit(True).alias("failed"))
    files = texts.select("path").join(failed, "path", "left").fillna(False, ["failed"])
    return imports.resolve_imports(graph.reliable(records.extract_imports(texts)), files, found.where("not failed").select("identity", "file", "name"))


def _sql(k: str) -> str:
    return f"'src/g' || {k} % 5 || '/f' || {k} || CASE WHEN {k} % 3 = 0 THEN '.js' ELSE '.ts' END"


_SOURCES_SQL = f"""WITH s AS (SELECT p_partkey AS k, p_partkey // 2 AS t, p_partkey // 6 * 6 + 1 AS u FROM part),
  n AS (SELECT k, t, u, u // 2 AS v, {_sql("k")} AS me, {_sql("t")} AS tp, {_sql("u")} AS up, {_sql("(u // 2)")} AS vp, '../g' || t % 5 || '/f' || t AS place, t % 50 = 49 AS bad FROM s WHERE k > 0 AND k % 50 <> 49),
  scripts AS (
    SELECT me AS "from", CASE WHEN k % 4 <> 3 AND NOT bad THEN tp || '::run' || t || ':function' END AS "to", place || ['.js', '', '.ts', '/index'][k % 4 + 1] AS source, 'run' || t AS imported, 'run' || t AS local, 'import' AS kind,
      CASE WHEN k % 4 <> 3 THEN tp END AS target_file, CASE WHEN k % 4 = 3 THEN 'module-not-found' WHEN bad THEN 'target-parse-failed' ELSE 'relative-module-resolved' END AS reason FROM n
    UNION ALL SELECT me, CASE WHEN NOT bad AND t % 2 = 0 THEN tp || '::C' || t || ':class' END, place, 'default', 'Def', 'import', CASE WHEN bad OR t % 2 = 0 THEN tp END, CASE WHEN bad THEN 'target-parse-failed' WHEN t % 2 = 0 THEN 'relative-module-resolved' ELSE 'target-declaration-not-found' END FROM n WHERE k % 3 = 0
    UNION ALL SELECT me, tp, place, '*', 'all' || k, 'namespace', tp, 'namespace-module-resolved' FROM n WHERE k % 3 = 0
    UNION ALL SELECT me, NULL, './gone' || k, 'help', 'help', 'import', NULL, 'module-not-found' FROM n WHERE k % 5 = 0
    UNION ALL SELECT me, NULL, './gone' || k, 'other', 'o2', 'import', NULL, 'module-not-found' FROM n WHERE k % 5 = 0
    UNION ALL SELECT me, NULL, 'lodash', 'default', 'ext', 'import', NULL, 'external-or-non-relative' FROM n WHERE k % 7 = 0
    UNION ALL SELECT me, CASE WHEN u % 50 <> 49 AND v % 50 <> 49 THEN vp || '::run' || v || ':function' END, '../g' || u % 5 || '/f' || u, 'again', 'b', CASE WHEN u % 50 <> 49 AND v % 50 <> 49 THEN 'reexport' ELSE 'import' END,
      CASE WHEN u % 50 = 49 THEN up WHEN v % 50 <> 49 THEN vp END, CASE WHEN u % 50 = 49 THEN 'target-parse-failed' WHEN v % 50 = 49 THEN 'target-declaration-not-found' ELSE 'relative-module-resolved' END FROM n WHERE k % 6 = 3
    UNION ALL SELECT me, tp, place, '*', 'api', 'commonjs', tp, 'commonjs-module-resolved' FROM n WHERE k % 8 = 2),
  m AS (SELECT k, k // 4 * 2 AS t, 'py/p' || k % 3 || '/m' || k || '.py' AS me, 'py/p' || (k // 4 * 2) % 3 || '/m' || k // 4 * 2 || '.py' AS tp FROM s WHERE k > 0 AND k % 2 = 0),
  modules AS (
    SELECT me AS "from", tp || '::f' || t || ':function' AS "to", 'p' || t % 3 || '.m' || t AS source, 'f' || t AS imported, 'f' || t AS local, 'import' AS kind, tp AS target_file, 'declaration-found' AS reason FROM m
    UNION ALL SELECT me, tp, 'p' || t % 3 || '.m' || t, 'missing', 'missing', 'import', tp, 'module-resolved-name-not-found' FROM m
    UNION ALL SELECT me, 'py/p0/m0.py', 'py.p0.m0', NULL, 'z', 'import', 'py/p0/m0.py', 'module-resolved' FROM m
    UNION ALL SELECT me, NULL, 'os', NULL, 'os', 'import', NULL, 'external-or-stdlib' FROM m
    UNION ALL SELECT me, NULL, 'py.none', NULL, 'py.none', 'import', NULL, 'partial-path-matches-project-package' FROM m
    UNION ALL SELECT me, CASE WHEN k % 3 = 0 THEN 'py/p0/m0.py' END, NULL, 'm0', 'm0', 'import', CASE WHEN k % 3 = 0 THEN 'py/p0/m0.py' END, CASE WHEN k % 3 = 0 THEN 'relative-submodule-resolved' ELSE 'relative-import-path-not-found' END FROM m
    UNION ALL SELECT me, 'py/p0/m0.py::f0:function', 'p0', 'zero', 'zero', 'reexport', 'py/p0/m0.py', 'init-reexport-one-hop' FROM m
    UNION ALL SELECT me, NULL, 'x', 'y', 'y', 'import', NULL, 'relative-import-path-not-found' FROM m
    UNION ALL SELECT me, 'py/p1/__init__.py', 'p1', '*', '*', 'wildcard', 'py/p1/__init__.py', 'module-resolved' FROM m
    UNION ALL SELECT 'py/p0/__init__.py', 'py/p0/m0.py::f0:function', 'm0', 'f0', 'zero', 'import', 'py/p0/m0.py', 'declaration-found'),
  resolved AS (SELECT *, CASE WHEN reason = 'partial-path-matches-project-package' THEN 'inferred' WHEN "to" IS NULL THEN 'unresolved' ELSE 'certain' END AS confidence FROM (SELECT * FROM scripts UNION ALL SELECT * FROM modules)) """


@query(_SOURCES_SQL + "SELECT * FROM resolved")
def imports_resolved(spark, sf):
    return _resolved(spark, sf).drop("pos")


def _graph(spark, sf):
    """Scripts and modules now, and before every fiftieth script broke."""
    texts = source_texts(spark, sf)
    found = graph.reliable(_declarations(texts))
    now = found.where("not failed").withColumn("seq", F.col("start"))
    # Of files that are the same then and now the declarations are, too; only the others are parsed again.
    was = texts.withColumn("then", F.regexp_replace("content", r"^function \(", "")).where("then <> content")
    then = graph.reliable(_declarations(was.select("path", F.col("then").alias("content"))))
    same = found.join(was.select(F.col("path").alias("file")), "file", "left_anti").select(then.columns)
    return graph.impact_graph(_imported(texts, found), now, same.unionByName(then).withColumn("seq", F.col("start")))


_RUNS_SQL = _SOURCES_SQL + f""", every AS (SELECT k, t, {_sql("k")} AS me, {_sql("t")} AS tp FROM s),
  declared AS (
    SELECT k, 'run' || k AS name, 'function' AS kind, '' AS ending, me AS file, 1 AS params, 1 AS returns, 0 AS nullish, CASE WHEN k > 0 THEN 'run' || t ELSE '' END AS calls, '' AS callbacks, CASE WHEN k > 0 THEN k || '.0' ELSE '' END AS numbers, NULL AS shape, NULL AS n, NULL AS entries FROM every
    UNION ALL SELECT k, 'C' || k, 'class', '', me, 0, 0, 0, '', '', '', NULL, NULL, NULL FROM every WHERE k % 2 = 0 UNION ALL SELECT k, 'C' || k || '.make', 'method', ':static', me, 0, 0, 0, '', '', '', NULL, NULL, NULL FROM every WHERE k % 2 = 0
    UNION ALL SELECT k, 'C' || k || '.size', 'getter', '', me, 0, 1, 1, '', '', '', NULL, NULL, NULL FROM every WHERE k % 2 = 0
    UNION ALL SELECT k, 'LIST' || k, 'data', '', me, 0, 0, 0, '', '', '1.0', 'array', 3, 'a' || k || '|b|{{ x: 1 }}' FROM every WHERE k % 4 = 1
    UNION ALL SELECT k, 'hook' || k, 'function', '', me, 0, 0, 0, 'init', 'run' || k, '7.0', NULL, NULL, NULL FROM every WHERE k % 4 = 2
    UNION ALL SELECT 0, 'f' || k, 'function', '', me, 0, 1, 0, '', '', '1.0', NULL, NULL, NULL FROM m UNION ALL SELECT 0, 'f0', 'function', '', 'py/p0/m0.py', 0, 1, 0, '', '', '0.0', NULL, NULL, NULL) """


@query(_RUNS_SQL + """SELECT file || '::' || name || ':' || kind || ending AS identity, name, kind, CAST(params AS INTEGER) AS params, CAST(returns AS INTEGER) AS returns, CAST(nullish AS INTEGER) AS returns_nullish, calls, callbacks, numbers, shape, CAST(n AS INTEGER) AS entry_count, entries
  FROM declared WHERE k % 50 <> 49""")
def extracted_declarations(spark, sf):
    found = _declarations(source_texts(spark, sf)).where("not failed")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    return found.select("identity", "name", "kind", "params", "returns", "returns_nullish", joined("calls"), joined("callbacks"), joined("numbers"), "shape", "entry_count", joined("entries"))


@query(_RUNS_SQL + """SELECT file AS path, count(*) AS n, false AS failed FROM declared WHERE k % 50 <> 49 GROUP BY file UNION ALL SELECT DISTINCT file, CAST(0 AS BIGINT), true FROM declared WHERE k % 50 = 49""")
def scanned_files(spark, sf):
    """Declarations of every file that has some, and the files that cannot be parsed."""
    found = _declarations(source_texts(spark, sf))
    return found.groupBy(F.col("file").alias("path")).agg(F.count_if(~F.col("failed")).alias("n"), F.bool_or("failed").alias("failed"))


@query(_RUNS_SQL + """SELECT DISTINCT "from", "to", kind, confidence FROM resolved
  UNION ALL SELECT me || '::run' || k || ':function', tp || '::run' || t || ':function', 'call', CASE WHEN t % 50 = 49 THEN 'unresolved' ELSE 'certain' END FROM every WHERE k > 0 AND k % 50 <> 49
  UNION ALL SELECT me || '::hook' || k || ':function', 'init', 'call', 'unresolved' FROM every WHERE k % 4 = 2 AND k % 50 <> 49""")
def impact_graph_edges(spark, sf):
    return _graph(spark, sf)[1].drop("reason")


@query(_RUNS_SQL + "SELECT file || '::' || name || ':' || kind || ending AS id, kind, name, file FROM declared")
def impact_graph_nodes(spark, sf):
    return _graph(spark, sf)[0]


@query(_SOURCES_SQL.replace("WITH s", "WITH RECURSIVE s") + f""", walk(k, depth, trail) AS (SELECT CAST(1 AS BIGINT), 0, CAST([] AS VARCHAR[]) UNION ALL
    SELECT s.k, walk.depth + 1, list_append(walk.trail, {_sql("s.k")} || '::run' || s.k || ':function') FROM walk JOIN s ON s.t = walk.k WHERE walk.depth < 6 AND s.k <> s.t AND s.k % 50 <> 49)
  SELECT CAST(row_number() OVER (ORDER BY trail) - 1 AS INTEGER) AS place, trail[-1] AS identity, depth, 'inferred' AS confidence FROM walk WHERE depth > 0""")
def find_callers(spark, sf):
    found = _declarations(source_texts(spark, sf)).where("not failed")
    index = graph.caller_index(found.select(F.col("identity").alias("caller"), "calls")).withColumn("confidence", F.lit("inferred"))
    return graph.find_callers(index, "run1", 6)


@query(_RUNS_SQL + """, edges AS (SELECT "from", "to", kind, confidence FROM resolved UNION ALL SELECT me || '::run' || k || ':function', CASE WHEN t % 50 = 49 THEN 'run' || t ELSE tp || '::run' || t || ':function' END, 'call', CASE WHEN t % 50 = 49 THEN 'unresolved' ELSE 'certain' END FROM every WHERE k > 0 AND k % 50 <> 49
    UNION ALL SELECT me || '::hook' || k || ':function', 'init', 'call', 'unresolved' FROM every WHERE k % 4 = 2 AND k % 50 <> 49)
  SELECT kind, confidence, count(*) AS n, count(DISTINCT "from") AS sources FROM edges GROUP BY kind, confidence""")
def join_dependencies(spark, sf):
    texts = source_texts(spark, sf)
    every = graph.reliable(_declarations(texts))
    found = every.where("not failed")
    calls = graph.caller_index(found.select(F.col("identity").alias("caller"), "calls"))
    edges = graph.join_dependencies(_imported(texts, every), graph.resolve_names(calls, found))
    return edges.groupBy("kind", "confidence").agg(F.count("*").alias("n"), F.count_distinct("from").alias("sources"))
