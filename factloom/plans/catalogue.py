"""The engine's queries, one per operator family, each with its oracle in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff, events, graph, impact, rules, views
from . import authoring as _authoring  # noqa: F401  likewise
from . import describe as _describe  # noqa: F401  likewise
from . import drafts as _drafts  # noqa: F401  likewise
from . import history as _history  # noqa: F401  fills the registry
from . import planning as _planning  # noqa: F401  likewise
from . import sources as _sources  # noqa: F401  likewise
from . import stores as _stores  # noqa: F401  likewise
from . import summaries as _summaries  # noqa: F401  likewise
from . import documents as _documents
from . import relations as R
from .registry import ORACLES, QUERIES, query


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# --- snapshots -------------------------------------------------------------------------------------------------------

def _properties() -> dict:
    return {
        "throws": F.col("throws"), "returns_nullish": F.col("returns_nullish"), "calls": F.array_join("calls", ","), "numbers": F.array_join(F.col("numbers").cast("array<string>"), ","),
        "awaits": F.col("awaits"), "catches": F.col("catches"), "params": F.col("params"), "returns": F.col("returns") - F.col("returns_nullish"),
    }


def _diff(spark, sf) -> DataFrame:
    return diff.diff_snapshots(*R.snapshots(spark, sf), _properties())


_DIFF_SQL = f"""WITH {R.SNAPSHOTS_SQL},
  j AS (SELECT coalesce(b.identity, a.identity) AS identity, b.identity IS NULL AS is_new, a.identity IS NULL AS is_gone, b AS b, a AS a FROM snap_b b FULL JOIN snap_a a ON b.identity = a.identity),
  props AS (
    SELECT identity, is_new, is_gone, u.property, u.x AS before, u.y AS after FROM j, unnest([
      {{'property': 'throws', 'x': CAST(b.throws AS VARCHAR), 'y': CAST(a.throws AS VARCHAR)}},
      {{'property': 'returns_nullish', 'x': CAST(b.returns_nullish AS VARCHAR), 'y': CAST(a.returns_nullish AS VARCHAR)}},
      {{'property': 'calls', 'x': array_to_string(b.calls, ','), 'y': array_to_string(a.calls, ',')}},
      {{'property': 'numbers', 'x': array_to_string(b.numbers, ','), 'y': array_to_string(a.numbers, ',')}},
      {{'property': 'awaits', 'x': CAST(b.awaits AS VARCHAR), 'y': CAST(a.awaits AS VARCHAR)}},
      {{'property': 'catches', 'x': CAST(b.catches AS VARCHAR), 'y': CAST(a.catches AS VARCHAR)}},
      {{'property': 'params', 'x': CAST(b.params AS VARCHAR), 'y': CAST(a.params AS VARCHAR)}},
      {{'property': 'returns', 'x': CAST(b.returns - b.returns_nullish AS VARCHAR), 'y': CAST(a.returns - a.returns_nullish AS VARCHAR)}}]) AS t(u)),
  changed AS (
    SELECT identity, property, before, after,
           CASE WHEN property = 'calls' THEN len(list_filter(list_concat(list_filter(string_split(before, ','), lambda c: NOT list_contains(string_split(after, ','), c)),
                  list_filter(string_split(after, ','), lambda c: NOT list_contains(string_split(before, ','), c))), lambda c: NOT regexp_matches(c, '^(console|logger|debug)\\.'))) > 0 ELSE true END AS significant
    FROM props WHERE NOT is_new AND NOT is_gone AND before IS DISTINCT FROM after),
  kinds AS (
    SELECT identity, CASE WHEN is_gone THEN 'deleted' WHEN is_new THEN 'added' WHEN identity IN (SELECT identity FROM changed) THEN 'changed' ELSE 'unchanged' END AS change_type FROM j)
"""


@query(_DIFF_SQL + "SELECT identity, 'changed' AS change_type, property, before, after, significant FROM changed")
def structural_diff(spark: SparkSession, sf: str) -> DataFrame:
    return diff.property_changes(_diff(spark, sf))


@query(_DIFF_SQL + "SELECT change_type, count(*) AS n FROM kinds GROUP BY change_type")
def diff_summary(spark, sf):
    return _diff(spark, sf).groupBy("change_type").agg(F.count("*").alias("n"))


@query(_DIFF_SQL + """SELECT identity, change_type AS declaration_type, CAST(0 AS BIGINT) AS n_reasons FROM kinds WHERE change_type IN ('added', 'deleted')
  UNION ALL SELECT identity, 'changed', count(*) FROM changed WHERE significant GROUP BY identity""")
def significant_changes(spark, sf):
    return diff.analyse_significance(_diff(spark, sf))


@query(_DIFF_SQL + "SELECT property, count(*) AS n, count(*) FILTER (WHERE significant) AS n_significant FROM changed GROUP BY property")
def property_change_counts(spark, sf):
    return diff.property_changes(_diff(spark, sf)).groupBy("property").agg(F.count("*").alias("n"), F.count_if("significant").alias("n_significant"))


@query(f"""WITH {R.SNAPSHOTS_SQL} SELECT a.identity, len(list_filter(list_concat(list_filter(b.calls, lambda c: NOT list_contains(a.calls, c)), list_filter(a.calls, lambda c: NOT list_contains(b.calls, c))),
  lambda c: NOT regexp_matches(c, '^(console|logger|debug)\\.'))) = 0 AS only_noise FROM snap_b b JOIN snap_a a ON a.identity = b.identity""")
def noise_filter(spark, sf):
    b, a = R.snapshots(spark, sf)
    both = b.select("identity", F.col("calls").alias("old")).join(a.select("identity", F.col("calls").alias("new")), "identity")
    return both.select("identity", diff.calls_only_noise(F.col("old"), F.col("new")).alias("only_noise"))


@query(f"WITH {R.FACTS_SQL} SELECT node_id, array_to_string(calls, ',') AS calls, array_to_string(numbers, ',') AS numbers FROM facts")
def sorted_distinct_facts(spark, sf):
    return R.facts(spark, sf).select("node_id", F.array_join("facts.calls", ",").alias("calls"), F.array_join(F.col("facts.numbers").cast("array<string>"), ",").alias("numbers"))


@query(f"WITH {R.SNAPSHOTS_SQL} SELECT identity, file, kind, CAST(throws AS VARCHAR) || '/' || array_to_string(calls, ',') AS facts FROM snap_b")
def baseline_projection(spark, sf):
    b, _ = R.snapshots(spark, sf)
    return diff.baseline_projection(b.withColumn("facts", F.concat_ws("/", F.col("throws").cast("string"), F.array_join("calls", ","))))


_REPEATED_SQL = "WITH d AS (SELECT p_brand AS file, p_name || ':' || p_type AS identity, p_partkey AS seq, row_number() OVER (PARTITION BY p_brand, p_name || ':' || p_type ORDER BY p_partkey) AS n FROM part) "


def _repeated(spark, sf):
    return R.table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.concat_ws(":", "p_name", "p_type").alias("identity"), F.col("p_partkey").alias("seq"))


@query(_REPEATED_SQL + "SELECT file, CASE WHEN n > 1 THEN identity || '#' || n ELSE identity END AS identity, seq FROM d")
def duplicate_identity_suffix(spark, sf):
    return diff.suffix_repeated(_repeated(spark, sf), ["file"], "identity", "seq")


@query(_REPEATED_SQL + "SELECT identity, count(*) AS n FROM d GROUP BY identity HAVING count(*) > 1")
def duplicate_identities(spark, sf):
    return diff.repeated(_repeated(spark, sf), "identity")


# --- rules -----------------------------------------------------------------------------------------------------------


def _clauses(spark, sf, ids):
    return rules.evaluate(R.ruled(spark, sf, ids)).select("node_id", F.col("clause.rule_id").alias("rule_id"), "error", "pass")


_EVALUATED_SQL = f"""WITH {R.FACTS_SQL}, evaluated AS (
  SELECT node_id, r AS rule_id,
         CASE WHEN r = 10 THEN 'field absent' WHEN r = 7 AND NOT has_snapshot THEN 'no snapshot' WHEN r = 8 THEN 'needs a number' WHEN r = 9 THEN 'needs a list' END AS error,
         CASE r WHEN 1 THEN throws <= 1 WHEN 2 THEN returns >= 2 WHEN 3 THEN params = 7 WHEN 4 THEN returns_nullish <> 0 WHEN 5 THEN list_contains(calls, 'R.F')
                WHEN 6 THEN NOT list_contains(calls, 'N.O') WHEN 11 THEN list_contains(numbers, 7) WHEN 12 THEN NOT list_contains(numbers, 7) WHEN 7 THEN CASE WHEN has_snapshot THEN throws = throws0 END END AS pass
  FROM facts, unnest(range(1, 13)) AS t(x), LATERAL (SELECT CAST(x AS INTEGER) AS r)) """


@query(_EVALUATED_SQL + "SELECT * FROM evaluated WHERE rule_id <= 4")
def clause_eval_numeric(spark, sf):
    return _clauses(spark, sf, (1, 2, 3, 4))


@query(_EVALUATED_SQL + "SELECT * FROM evaluated WHERE rule_id IN (5, 6, 11, 12)")
def clause_eval_array(spark, sf):
    return _clauses(spark, sf, (5, 6, 11, 12))


@query(_EVALUATED_SQL + "SELECT * FROM evaluated WHERE rule_id = 7")
def clause_eval_unchanged(spark, sf):
    return _clauses(spark, sf, (7,))


@query(_EVALUATED_SQL + "SELECT rule_id, error, count(*) AS n FROM evaluated WHERE error IS NOT NULL GROUP BY rule_id, error")
def clause_errors(spark, sf):
    return _clauses(spark, sf, tuple(range(1, 13))).where("error is not null").groupBy("rule_id", "error").agg(F.count("*").alias("n"))


_FIELDS, _OPERATORS = [*rules.NUMERIC_FIELDS, *rules.LIST_FIELDS, "nothing"], [*rules.NUMERIC_OPERATORS, *rules.LIST_OPERATORS, "unchanged", "like"]


@query(f"""WITH c AS (SELECT p_partkey AS id, ({_FIELDS})[p_partkey % {len(_FIELDS)} + 1] AS field, ({_OPERATORS})[p_partkey // {len(_FIELDS)} % {len(_OPERATORS)} + 1] AS op FROM part)
  SELECT id, field, op, CASE WHEN field = 'nothing' THEN 'unknown field' WHEN op = 'like' THEN 'unknown operator'
  WHEN field IN {rules.LIST_FIELDS} AND op IN {rules.NUMERIC_OPERATORS} THEN 'needs a number' WHEN field NOT IN {rules.LIST_FIELDS} AND op IN {rules.LIST_OPERATORS} THEN 'needs a list' END AS problem FROM c""")
def clause_static_check(spark, sf):
    """A clause a part; over all parts each field meets each operator."""
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    field, op = pick(_FIELDS, F.col("p_partkey") % len(_FIELDS)), pick(_OPERATORS, F.expr(f"p_partkey div {len(_FIELDS)}") % len(_OPERATORS))
    clauses = R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), field.alias("field"), op.alias("op"))
    return clauses.withColumn("problem", rules.clause_problem(F.col("field"), F.col("op")))


_VERIFIED_SQL = _EVALUATED_SQL + """, nodes AS (
  SELECT node_id, CASE WHEN count(error) > 0 THEN 'error' WHEN count(*) FILTER (WHERE NOT pass) > 0 THEN 'drifted' ELSE 'implemented' END AS status,
         count(*) FILTER (WHERE NOT pass) AS n_violations, count(error) AS n_errors
  FROM evaluated WHERE rule_id IN (1, 5, 7) GROUP BY node_id) """


def _verified(spark, sf):
    return rules.verify(_clauses(spark, sf, (1, 5, 7)), "node_id")


@query(_VERIFIED_SQL + "SELECT * FROM nodes")
def verify_results(spark, sf):
    return _verified(spark, sf)


@query(_VERIFIED_SQL + "SELECT status, count(*) AS n, CAST(sum(n_violations) AS BIGINT) AS violations, CAST(sum(n_errors) AS BIGINT) AS errors FROM nodes GROUP BY status")
def verify_summary(spark, sf):
    return _verified(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum("n_violations").alias("violations"), F.sum("n_errors").alias("errors"))


@query(f"WITH {R.PLAN_SQL} SELECT id, title FROM plan WHERE list_contains(lens_tags, 'red') AND feature = 'Brand#3'")
def select_nodes(spark, sf):
    nodes = R.plan(spark, sf).withColumns({"identity": F.col("title"), "identities": F.array("title")})
    return rules.select_nodes(nodes, lens="red", feature="Brand#3").select("id", "title")


@query(f"""WITH {R.SNAPSHOTS_SQL}, n AS (SELECT o_orderkey AS id, o_custkey % 1000 AS k FROM orders), w AS (SELECT id, unnest([k, k + 1, k + 10]) AS k FROM n)
  SELECT id, count(*) AS n_identities, count(*) FILTER (WHERE k NOT IN (SELECT seq FROM snap_b)) > 0 AS error FROM w GROUP BY id""")
def approve_capture(spark, sf):
    key = F.col("o_custkey") % 1000
    nodes = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array(key, key + 1, key + 10).alias("identities"))
    return rules.capture_approval(nodes, R.snapshots(spark, sf)[0].select(F.col("seq").alias("identity")))


@query(_EVALUATED_SQL + """, held AS (SELECT o_custkey AS grp, rule_id, bool_and(coalesce(pass, false)) AS h FROM evaluated JOIN orders ON o_orderkey = node_id WHERE rule_id IN (1, 2, 7) GROUP BY o_custkey, rule_id)
  SELECT grp, bool_or(h) AS mergeable FROM held GROUP BY grp""")
def merge_gate(spark, sf):
    held = rules.assert_holds(_clauses(spark, sf, (1, 2, 7)), ["node_id", "rule_id"])
    grouped = held.join(R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("grp")), "node_id")
    return rules.merge_gate(grouped, "grp", "rule_id")


# --- graph -----------------------------------------------------------------------------------------------------------


@query(f"WITH {R.DECLARATIONS_SQL} SELECT DISTINCT c AS callee, identity AS caller FROM (SELECT identity, unnest(calls) AS c FROM decl)")
def caller_index(spark, sf):
    return graph.caller_index(R.declarations(spark, sf).select(F.col("identity").alias("caller"), "calls"))


@query(f"WITH {R.DECLARATIONS_SQL} SELECT DISTINCT file, identity FROM decl")
def file_index(spark, sf):
    return graph.file_index(R.declarations(spark, sf))


@query("""WITH e AS (SELECT CASE WHEN l_orderkey % 50 = 0 THEN '' ELSE 'o' || l_orderkey END AS f, 's' || l_suppkey AS t, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS k,
    CASE WHEN l_linestatus = 'O' THEN '' ELSE 'certain' END AS c, 'r' || l_linenumber AS r, l_linenumber * 100000000 + l_partkey AS q FROM lineitem)
  SELECT f AS "from", t AS "to", coalesce(k, 'unknown') AS kind, CASE c WHEN '' THEN 'unresolved' ELSE c END AS confidence, arg_min(r, q) AS reason FROM e WHERE f <> '' GROUP BY ALL""")
def edge_normalize_dedupe(spark, sf):
    line = R.table(spark, sf, "lineitem")
    raw = line.select(
        F.when(F.col("l_orderkey") % 50 == 0, "").otherwise(F.concat(F.lit("o"), F.col("l_orderkey"))).alias("from"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("to"),
        F.when(F.col("l_linenumber") != 1, F.col("l_returnflag")).alias("kind"), F.when(F.col("l_linestatus") == "O", "").otherwise("certain").alias("confidence"),
        F.concat(F.lit("r"), F.col("l_linenumber")).alias("reason"), (F.col("l_linenumber") * F.lit(100000000) + F.col("l_partkey")).alias("seq"),
    )
    return graph.normalise_edges(raw)


@query(f"""WITH {R.DECLARATIONS_SQL}, names AS (SELECT name, count(DISTINCT identity) AS n, min(identity) AS sole FROM decl GROUP BY name), calls AS (SELECT identity AS caller, unnest(calls) AS callee FROM decl)
  SELECT caller, CASE WHEN n = 1 THEN sole ELSE callee END AS "to", CASE WHEN n = 1 THEN 'certain' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS confidence FROM calls LEFT JOIN names ON name = callee""")
def ambiguous_name_resolution(spark, sf):
    d = R.declarations(spark, sf)
    return graph.resolve_names(d.select(F.col("identity").alias("caller"), F.explode("calls").alias("callee")), d)


_SUFFIXES = ["", ".js", ".ts", ".tsx", ".py", "/index.js", "/index.ts"]


@query(f"""WITH w AS (SELECT DISTINCT o_orderpriority AS importer, 'm' || (o_custkey % 300) AS source FROM orders),
  f AS (SELECT DISTINCT 'm' || (p_partkey % 250) || CASE p_size % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' WHEN 2 THEN '.py' ELSE '' END AS path FROM part WHERE p_partkey % 3 = 0),
  c AS (SELECT importer, source, x.i, source || x.s AS path FROM w, (SELECT unnest({_SUFFIXES}) AS s, unnest(range(0, {len(_SUFFIXES)})) AS i) x)
  SELECT w.importer, w.source, (SELECT arg_min(c.path, c.i) FROM c JOIN f ON f.path = c.path WHERE c.importer = w.importer AND c.source = w.source) AS target FROM w""")
def candidate_path_resolution(spark, sf):
    wanted = R.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("importer"), F.concat(F.lit("m"), F.col("o_custkey") % 300).alias("source")).distinct()
    size = F.col("p_size") % 4
    end = F.when(size == 0, ".ts").when(size == 1, "/index.js").when(size == 2, ".py").otherwise("")
    files = R.table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("m"), F.col("p_partkey") % 250, end).alias("path")).distinct()
    return graph.resolve_paths(wanted, files, _SUFFIXES)


_CALLS_SQL = f"""WITH {R.DECLARATIONS_SQL},
  idx AS (SELECT DISTINCT identity, file, unnest([name, string_split(name, '.')[-1]]) AS target FROM decl),
  calls AS (SELECT DISTINCT identity AS f, file, unnest(calls) AS call FROM decl),
  cand AS (SELECT f, file, call, unnest([call, array_to_string(list_slice(string_split(call, '.'), -2, -1), '.'), string_split(call, '.')[-1]]) AS target, unnest([0, 1, 2]) AS pos FROM calls),
  tot AS (SELECT target, count(DISTINCT identity) AS n, min(identity) AS sole FROM idx GROUP BY target),
  loc AS (SELECT target, file, count(DISTINCT identity) AS n, min(identity) AS sole FROM idx GROUP BY target, file),
  hit AS (SELECT c.f, c.call, c.pos, t.n, t.sole, l.n AS ln, l.sole AS lonly FROM cand c JOIN tot t USING (target) LEFT JOIN loc l ON l.target = c.target AND l.file = c.file
          QUALIFY row_number() OVER (PARTITION BY c.f, c.call ORDER BY c.pos) = 1),
  call_edges AS (SELECT DISTINCT f AS "from", CASE WHEN n = 1 THEN sole WHEN ln = 1 THEN lonly END AS "to" FROM hit WHERE CASE WHEN n = 1 THEN sole WHEN ln = 1 THEN lonly END IS DISTINCT FROM f
                 AND CASE WHEN n = 1 THEN sole WHEN ln = 1 THEN lonly END IS NOT NULL) """


#: Calls as sources have them: with blanks around dots and ends, subscripts with dots in them, and parts without text.
_WRITTEN_SQL = _CALLS_SQL.replace(
    "unnest(calls) AS call FROM decl),",
    """unnest(list_concat(calls, ['  svc . ' || calls[2] || ' ', 'rows["a.b"].' || calls[2] || '[0]', '..' || string_split(calls[2], '.')[-1], ' [x] '])) AS call FROM decl),
  parts AS (SELECT *, regexp_replace(trim(call), '\\[[^\\]]*\\]', '', 'g') AS whole, list_filter(list_transform(string_split(regexp_replace(trim(call), '\\[[^\\]]*\\]', '', 'g'), '.'), lambda x: trim(x)), lambda x: x <> '') AS p FROM calls),""",
).replace(
    "unnest([call, array_to_string(list_slice(string_split(call, '.'), -2, -1), '.'), string_split(call, '.')[-1]]) AS target, unnest([0, 1, 2]) AS pos FROM calls)",
    "unnest(CASE WHEN len(p) > 1 THEN [whole, p[-2] || '.' || p[-1], p[-1]] ELSE p END) AS target, unnest(range(0, CASE WHEN len(p) > 1 THEN 3 ELSE len(p) END)) AS pos FROM parts)",
)


@query(_WRITTEN_SQL + "SELECT * FROM call_edges")
def call_graph_resolve(spark, sf):
    other = F.element_at("calls", 2)
    written = F.array(F.concat(F.lit("  svc . "), other, F.lit(" ")), F.concat(F.lit('rows["a.b"].'), other, F.lit("[0]")), F.concat(F.lit(".."), F.element_at(F.split(other, r"\."), -1)), F.lit(" [x] "))
    return graph.resolve_calls(R.declarations(spark, sf).withColumn("calls", F.concat("calls", written)))


_DEGREES_SQL = _CALLS_SQL + """, deg AS (SELECT d.identity AS id, (SELECT count(DISTINCT "from") FROM call_edges e WHERE e."to" = d.identity) AS callers, (SELECT count(DISTINCT "to") FROM call_edges e WHERE e."from" = d.identity) AS callees FROM decl d) """


def _degrees(spark, sf):
    d = R.declarations(spark, sf)
    return graph.degrees(d.select(F.col("identity").alias("id")), graph.resolve_calls(d))


@query(_DEGREES_SQL + "SELECT * FROM deg")
def degree_counts(spark, sf):
    return _degrees(spark, sf)


@query(_DEGREES_SQL + """SELECT id, CASE WHEN kind = 'data' THEN 'vocabulary' WHEN (list_contains(string_split(name, '.'), 'gear') OR list_contains(string_split(name, '.'), 'bolt')) AND callers = 0 THEN 'machinery'
  WHEN callers >= 2 AND callees = 0 AND seq % 2 = 0 AND params <= 2 THEN 'tool' ELSE 'behaviour' END AS role FROM deg JOIN decl ON identity = id""")
def propose_role(spark, sf):
    d = R.declarations(spark, sf).select(F.col("identity").alias("id"), "kind", "params", T.split_words(F.col("name")).alias("words"), (F.col("seq") % 2).alias("throws"), F.lit(0).alias("awaits"))
    return graph.propose_role(d.join(_degrees(spark, sf), "id"), ["gear", "bolt"])


@query(f"""WITH {R.DECLARATIONS_SQL}, w AS (SELECT *, string_split(name, '.') AS ws FROM decl),
  pat AS (SELECT identity, seq, file, kind, params, i AS pos, array_to_string(list_transform(ws, lambda x, j: CASE WHEN j = i + 1 THEN '*' ELSE x END), ' ') AS pattern FROM w, unnest(range(0, len(ws))) AS t(i)),
  b AS (SELECT file, kind, params, pos, pattern, count(DISTINCT identity) AS size, min(seq) AS first FROM pat GROUP BY ALL HAVING count(DISTINCT identity) > 1)
  SELECT identity, pattern, size FROM pat JOIN b USING (file, kind, params, pos, pattern) QUALIFY row_number() OVER (PARTITION BY identity ORDER BY size DESC, first, pos) = 1""")
def sibling_families(spark, sf):
    return graph.sibling_families(R.declarations(spark, sf).withColumn("words", F.split("name", r"\.")))


@query(f"""WITH {R.DECLARATIONS_SQL}, gone AS (SELECT name, arg_min(identity, seq) AS old FROM decl WHERE seq % 10 = 1 GROUP BY name), calls AS (SELECT identity AS f, unnest(calls) AS t FROM decl)
  SELECT f AS "from", coalesce(old, t) AS "to" FROM calls LEFT JOIN gone ON name = t""")
def reanchor_deleted(spark, sf):
    d = R.declarations(spark, sf)
    calls = d.select(F.col("identity").alias("from"), F.explode("calls").alias("to"))
    return graph.reanchor_deleted(calls, d.where("seq % 10 = 1")).select("from", "to")


_REACH_SQL = f"""WITH RECURSIVE {R.EDGES_SQL.strip()}, walk(id, depth) AS (
  SELECT 'region:0', 0 UNION SELECT e."from", w.depth + 1 FROM walk w JOIN edges e ON e."to" = w.id WHERE w.depth < 3) """


@query(_REACH_SQL + "SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id HAVING min(depth) > 0")
def impact_by_level(spark, sf):
    return graph.impact_levels(R.edges(spark, sf), "region:0")


@query(f"""WITH {R.EDGES_SQL}, l1 AS (SELECT "from" AS id, kind, confidence, row_number() OVER (ORDER BY "from") AS rank FROM edges WHERE "to" = 'region:0'),
  l2 AS (SELECT e."from" AS id, e.kind, e.confidence, row_number() OVER (ORDER BY l1.rank, e."from") AS rank FROM edges e JOIN l1 ON e."to" = l1.id),
  n AS (SELECT count(*) AS c FROM l1), l3 AS (SELECT e."from" AS id, e.kind, e.confidence, min(l2.rank) AS up FROM edges e JOIN l2 ON e."to" = l2.id GROUP BY ALL),
  r3 AS (SELECT *, row_number() OVER (ORDER BY up, id) AS rank FROM l3), m AS (SELECT count(*) AS c FROM l2), k AS (SELECT count(*) AS c FROM l3)
  SELECT id, 1 AS depth, kind, confidence, true AS truncated FROM l1 UNION ALL SELECT id, 2, kind, confidence, true FROM l2, n WHERE l2.rank <= 25 - n.c
  UNION ALL SELECT id, 3, kind, confidence, true FROM r3, n, m WHERE r3.rank <= 25 - n.c - m.c""")
def impact_capped(spark, sf):
    return graph.impact_capped(R.edges(spark, sf), "region:0")


_TARGETS_SQL = _VERIFIED_SQL + """, """ + R.EDGES_SQL.strip() + """, asked AS (
  SELECT 'order:' || node_id AS target FROM nodes WHERE status <> 'implemented'
  UNION SELECT 'supplier:' || s_suppkey FROM supplier UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'region:' || r_regionkey FROM region),
  c AS (SELECT "to" AS at, "from" AS id, kind, confidence FROM edges QUALIFY row_number() OVER (PARTITION BY "to", "from" ORDER BY kind, confidence) = 1),
  f1 AS (SELECT target, c.id, 1 AS depth, 0 AS parent, kind, confidence, row_number() OVER (PARTITION BY target ORDER BY c.id) AS place FROM asked JOIN c ON c.at = target WHERE c.id <> target),
  k1 AS (SELECT * FROM f1 WHERE place <= 25), s1 AS (SELECT target, id FROM k1 UNION ALL SELECT target, target FROM asked), n1 AS (SELECT target, count(*) AS n FROM k1 GROUP BY target),
  d2 AS (SELECT k.target, c.id, 2 AS depth, k.place AS parent, c.kind, c.confidence FROM k1 k JOIN n1 ON n1.target = k.target AND n1.n < 25 JOIN c ON c.at = k.id ANTI JOIN s1 ON s1.target = k.target AND s1.id = c.id
         QUALIFY row_number() OVER (PARTITION BY k.target, c.id ORDER BY k.place) = 1),
  k2 AS (SELECT d2.*, n + row_number() OVER (PARTITION BY d2.target ORDER BY parent, id) AS place FROM d2 JOIN n1 ON n1.target = d2.target QUALIFY place <= 25),
  s2 AS (SELECT * FROM s1 UNION ALL SELECT target, id FROM k2), n2 AS (SELECT s.target, count(*) - 1 AS n FROM s2 s GROUP BY s.target),
  d3 AS (SELECT k.target, c.id, 3 AS depth, k.place AS parent, c.kind, c.confidence FROM k2 k JOIN n2 ON n2.target = k.target AND n2.n < 25 JOIN c ON c.at = k.id ANTI JOIN s2 ON s2.target = k.target AND s2.id = c.id
         QUALIFY row_number() OVER (PARTITION BY k.target, c.id ORDER BY k.place) = 1),
  k3 AS (SELECT d3.*, n + row_number() OVER (PARTITION BY d3.target ORDER BY parent, id) AS place FROM d3 JOIN n2 ON n2.target = d3.target QUALIFY place <= 25),
  found AS (SELECT * FROM k1 UNION ALL BY NAME SELECT * FROM k2 UNION ALL BY NAME SELECT * FROM k3), known AS (SELECT target, id, place, depth FROM found UNION ALL SELECT target, target, 0, 0 FROM asked),
  ended AS (SELECT target, parent FROM found WHERE place = 25),
  cut AS (SELECT e.target FROM ended e JOIN known k ON k.target = e.target AND k.place > e.parent AND k.depth < 3
          UNION SELECT e.target FROM ended e JOIN known k ON k.target = e.target AND k.place = e.parent JOIN c ON c.at = k.id ANTI JOIN known s ON s.target = e.target AND s.id = c.id),
  walked AS (SELECT target, id, CAST(depth AS INTEGER) AS depth, CAST(place AS INTEGER) AS place, kind, confidence, target IN (SELECT target FROM cut) AS truncated FROM found) """


def _results(spark, sf):
    """Verification results of orders, and of suppliers, nations and regions that were not found any more."""
    orders = _verified(spark, sf).select(F.concat(F.lit("order:"), F.col("node_id").cast("string")).alias("identity"), "status")
    for name, key in (("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        orders = orders.unionByName(R.table(spark, sf, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("identity"), F.lit("error").alias("status")))
    return orders


@query(_TARGETS_SQL + "SELECT * FROM walked")
def impact_of_all_results(spark, sf):
    targets = _results(spark, sf).where("status <> 'implemented'").select(F.col("identity").alias("target"))
    return impact.impact_of_all(R.edges(spark, sf), targets)


@query(_TARGETS_SQL + """, r AS (SELECT 'order:' || node_id AS identity, status FROM nodes UNION ALL SELECT target, 'error' FROM asked WHERE target NOT LIKE 'order:%')
  SELECT r.identity, r.status, CAST(count(w.id) AS INTEGER) AS n, coalesce(string_agg(w.id || '@' || w.depth, ' ' ORDER BY place), '') AS affected, coalesce(bool_or(w.truncated), false) AS truncated
  FROM r LEFT JOIN walked w ON w.target = r.identity AND r.status <> 'implemented' GROUP BY r.identity, r.status""")
def verify_impact(spark, sf):
    shown = F.array_join(F.transform("impact", lambda e: F.concat(e["identity"], F.lit("@"), e["depth"].cast("string"))), " ")
    return impact.impact_of_results(_results(spark, sf), R.edges(spark, sf)).select("identity", "status", F.size("impact").alias("n"), shown.alias("affected"), "truncated")


_documents.register(_diff, _DIFF_SQL, _results, _TARGETS_SQL)


# --- log -------------------------------------------------------------------------------------------------------------


@query(f"WITH {R.LOG_SQL} SELECT seq, identity, event_type FROM log QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY identity ORDER BY seq)")
def event_dedupe(spark, sf):
    return events.dedupe_consecutive(R.log(spark, sf), ["event_type"]).select("seq", "identity", "event_type")


@query(f"""WITH {R.LOG_SQL} SELECT a.seq, a.identity, a.type FROM log a WHERE a.seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM log b WHERE b.seq % 2 = 0 AND b.seq % 5 = 0 AND b.type IN ('added', 'deleted') AND b.identity = a.identity AND b.type = a.type)""")
def history_distinct(spark, sf):
    log = R.log(spark, sf)
    return events.new_changes(log.where("seq % 2 = 1"), log.where("seq % 2 = 0 and seq % 5 = 0")).select("seq", "identity", "type")


_GROUPED_SQL = f"""WITH {R.LOG_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY identity ORDER BY ts, seq) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM log),
  grouped AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY identity ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM g),
  net AS (SELECT identity, grp, arg_min_null(before, seq) AS before, arg_max_null(after, seq) AS after, count(*) AS event_count FROM grouped GROUP BY identity, grp) """


def _grouped(spark, sf):
    return events.time_groups(R.log(spark, sf), 30, "identity")


@query(_GROUPED_SQL + "SELECT seq, identity, grp FROM grouped")
def time_groups(spark, sf):
    return _grouped(spark, sf).select("seq", "identity", "grp")


@query(_GROUPED_SQL + "SELECT * FROM net WHERE before IS DISTINCT FROM after")
def net_delta(spark, sf):
    return events.net_delta(_grouped(spark, sf), ["identity", "grp"])


@query(_GROUPED_SQL + """, e AS (SELECT grp AS session, identity, arg_min(type, seq) AS type, count(*) AS event_count FROM grouped GROUP BY grp, identity),
  d AS (SELECT grp AS session, identity, count(*) AS n FROM net WHERE before IS DISTINCT FROM after GROUP BY grp, identity)
  SELECT e.session, e.identity, e.type, e.event_count, coalesce(d.n, 0) AS n_properties FROM e LEFT JOIN d USING (session, identity) WHERE type <> 'changed' OR coalesce(d.n, 0) > 0""")
def session_entries(spark, sf):
    g = _grouped(spark, sf).withColumnRenamed("grp", "session")
    return events.session_entries(g, events.net_delta(g, ["session", "identity"]))


@query(f"""WITH {R.LOG_SQL} SELECT seq, identity, type, CASE WHEN type <> 'added' THEN last_value(CASE WHEN type = 'added' THEN seq END IGNORE NULLS) OVER (PARTITION BY identity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM log""")
def lineage(spark, sf):
    return events.lineage(R.log(spark, sf))


_MARKED_SQL = f"""WITH {R.LOG_SQL}, m AS (SELECT seq, identity, CASE event_type WHEN 'signup' THEN 'session_started' WHEN 'error' THEN 'session_sealed' ELSE 'changed' END AS type FROM log) """


@query(_MARKED_SQL + """SELECT * FROM (SELECT seq, identity, CAST(sum(CASE WHEN type = 'session_started' THEN 1 ELSE 0 END) OVER (PARTITION BY identity ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session, type FROM m)
  WHERE session > 0 AND type = 'changed'""")
def sessions_from_markers(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "session_started").when(F.col("event_type") == "error", "session_sealed").otherwise("changed")
    return events.sessions_from_markers(R.log(spark, sf).withColumn("type", kind), "identity").select("seq", "identity", "session", "type")


@query(_GROUPED_SQL + """, s AS (SELECT grp AS session, identity, type, min(ts) AS a, max(ts) AS z FROM grouped GROUP BY grp, identity, type)
  SELECT session, identity, type, seq FROM (SELECT s.session, s.identity, s.type, l.seq FROM s JOIN log l ON l.identity = s.identity AND l.type = s.type AND l.ts BETWEEN s.a AND s.z)
  QUALIFY row_number() OVER (PARTITION BY session, identity, type ORDER BY seq DESC) = 1""")
def interval_join(spark, sf):
    entries = _grouped(spark, sf).groupBy(F.col("grp").alias("session"), "identity", "type").agg(F.min("ts").alias("opened_at"), F.max("ts").alias("sealed_at"))
    return events.interval_join(entries, R.log(spark, sf)).select("session", "identity", "type", "seq")


@query(f"WITH {R.LOG_SQL} SELECT seq, identity FROM log WHERE NOT (seq % 3 = 0 AND event_type <> 'view')")
def new_events_anti(spark, sf):
    log = R.log(spark, sf)
    stored = log.where("seq % 3 = 0").select("ts", "type", "identity", (F.col("event_type") != "view").alias("finished"))
    return events.new_or_unfinished(log, stored).select("seq", "identity")


@query(f"""WITH {R.LOG_SQL}, f AS (SELECT seq, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, seq) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh, ts FROM log)
  SELECT seq, CAST(sum(fresh) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM f""")
def time_groups_of_all(spark, sf):
    return events.time_groups_of_all(R.log(spark, sf), 5).select("seq", "grp")


@query(_MARKED_SQL + """SELECT identity, session, count(*) FILTER (WHERE type = 'changed') AS events, bool_or(type = 'session_sealed') AS sealed
  FROM (SELECT *, CAST(sum(CASE WHEN type = 'session_started' THEN 1 ELSE 0 END) OVER (PARTITION BY identity ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m) WHERE session > 0 GROUP BY identity, session""")
def recovered_sessions(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "session_started").when(F.col("event_type") == "error", "session_sealed").otherwise("changed")
    return events.recovered_sessions(R.log(spark, sf).withColumn("type", kind), "identity")


@query(_GROUPED_SQL + """, e AS (SELECT identity || '/' || grp AS session, min(ts) AS a, max(ts) AS z, count(*) AS events FROM grouped GROUP BY 1), k AS (SELECT identity || '/' || grp AS session, count(*) AS entries, bool_or(after % 2 = 0) AS s FROM net WHERE before IS DISTINCT FROM after GROUP BY 1)
  SELECT session, CAST(floor(epoch(z)) - floor(epoch(a)) AS BIGINT) AS seconds, events, coalesce(entries, 0) AS entries, coalesce(s, false) AS significant FROM e LEFT JOIN k USING (session)""")
def sealed_sessions(spark, sf):
    g = _grouped(spark, sf).withColumn("session", F.concat_ws("/", "identity", F.col("grp").cast("string")))
    entries = events.net_delta(g, ["session", "identity"]).withColumn("significant", F.col("after") % 2 == 0)
    out = events.seal(g, entries)
    return out.select("session", (F.unix_timestamp("sealed_at") - F.unix_timestamp("opened_at")).alias("seconds"), "events", "entries", "significant")


@query(f"""WITH {R.LOG_SQL}, base AS (SELECT count(*) AS c FROM log WHERE seq % 4 = 0), ids AS (
    SELECT seq, identity, type, false AS fresh, 'old' || seq AS id FROM log WHERE seq % 4 = 0
    UNION ALL SELECT seq, identity, type, true, 'n_' || CASE WHEN row_number() OVER (ORDER BY seq) + (SELECT c FROM base) > 9999 THEN '' ELSE repeat('0', 4 - length(CAST(row_number() OVER (ORDER BY seq) + (SELECT c FROM base) AS VARCHAR))) END || (row_number() OVER (ORDER BY seq) + (SELECT c FROM base)) FROM log WHERE seq % 4 <> 0)
  SELECT id, identity, type, parent FROM (SELECT *, CASE WHEN type <> 'added' THEN coalesce(last_value(CASE WHEN type = 'added' THEN id END IGNORE NULLS) OVER w, last_value(id) OVER w) END AS parent FROM ids
    WINDOW w AS (PARTITION BY identity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE fresh""")
def evolution_nodes(spark, sf):
    log = R.log(spark, sf).select("seq", "ts", "identity", "type")
    return events.evolution_nodes(log.where("seq % 4 = 0").withColumn("id", F.concat(F.lit("old"), F.col("seq").cast("string"))), log)


@query(f"WITH {R.LOG_SQL} SELECT seq, identity, row_number() OVER (PARTITION BY identity ORDER BY ts DESC, seq DESC) > 1 AS superseded FROM log")
def superseded_latest(spark, sf):
    return events.mark_superseded(R.log(spark, sf)).select("seq", "identity", "superseded")


@query(f"WITH {R.LOG_SQL} SELECT identity, arg_max(CASE WHEN after % 3 = 0 THEN 'drifted' ELSE 'implemented' END, seq) AS status FROM log WHERE after % 2 = 0 AND type <> 'deleted' GROUP BY identity")
def latest_verified(spark, sf):
    status = F.when(F.col("type") == "deleted", "superseded").when(F.col("after") % 3 == 0, "drifted").otherwise("implemented")
    return events.latest_verified(R.log(spark, sf).select("identity", "ts", "seq", (F.col("after") % 2 == 0).alias("verified"), status.alias("status")))


@query(f"WITH {R.SNAPSHOTS_SQL}, {R.LOG_SQL.strip()} SELECT origin, type, count(*) AS n FROM (SELECT 'genesis' AS origin, 'added' AS type FROM snap_b UNION ALL SELECT 'session', type FROM log) GROUP BY origin, type")
def genesis_union(spark, sf):
    genesis = R.snapshots(spark, sf)[0].select(F.lit("genesis").alias("origin"), F.lit("added").alias("type"))
    return genesis.unionByName(R.log(spark, sf).select(F.lit("session").alias("origin"), "type")).groupBy("origin", "type").agg(F.count("*").alias("n"))


@query(_DIFF_SQL + """SELECT identity, property || ': ' || CASE WHEN property = 'calls' THEN
    concat_ws(' ', '+' || nullif(array_to_string(list_filter(string_split(after, ','), lambda c: NOT list_contains(string_split(before, ','), c)), ','), ''),
                   '-' || nullif(array_to_string(list_filter(string_split(before, ','), lambda c: NOT list_contains(string_split(after, ','), c)), ','), ''))
    ELSE coalesce(before, 'none') || ' -> ' || coalesce(after, 'none') END AS description FROM changed""")
def describe_delta(spark, sf):
    return diff.property_changes(_diff(spark, sf)).select("identity", events.describe_delta("property", "before", "after").alias("description"))


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id % 5 AS INTEGER) AS project, event_id AS seq, ts, user_id AS who, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events),
  fold(project, n, seq, ts, session, who) AS (
    SELECT project, n, seq, ts, CAST(1 AS BIGINT), [who] FROM e WHERE n = 1
    UNION ALL SELECT e.project, e.n, e.seq, e.ts, CASE WHEN len(f.who) >= 20 OR e.ts - f.ts >= INTERVAL 30 MINUTE THEN f.session + 1 ELSE f.session END,
      CASE WHEN len(f.who) >= 20 OR e.ts - f.ts >= INTERVAL 30 MINUTE THEN [e.who] ELSE list_distinct(list_append(f.who, e.who)) END
    FROM fold f JOIN e ON e.project = f.project AND e.n = f.n + 1)
  SELECT project, seq, session FROM fold""")
def capped_sessions(spark, sf):
    e = R.table(spark, sf, "events").select((F.col("user_id") % 5).cast("int").alias("project"), F.col("event_id").alias("seq"), "ts", "user_id")
    return events.capped_sessions(e, "project", "user_id")


@query(f"WITH {R.LOG_SQL} SELECT seq, identity FROM log QUALIFY coalesce(lead(ts) OVER (PARTITION BY identity ORDER BY ts, seq) - ts >= INTERVAL 600 SECOND, true)")
def debounce_replay(spark, sf):
    return events.debounced(R.log(spark, sf), "identity", 600).select("seq", "identity")


@query(f"""WITH {R.LOG_SQL}, b AS (SELECT identity, any_value('view') AS s FROM log WHERE seq % 7 = 0 GROUP BY identity)
  SELECT seq, identity, event_type FROM log LEFT JOIN b USING (identity) QUALIFY event_type IS DISTINCT FROM coalesce(lag(event_type) OVER (PARTITION BY identity ORDER BY seq), b.s)""")
def last_seen_filter(spark, sf):
    log = R.log(spark, sf)
    baseline = log.where("seq % 7 = 0").select("identity", F.lit("view").alias("event_type")).distinct()
    return events.changed_signatures(log, "identity", "event_type", baseline).select("seq", "identity", "event_type")


# --- views -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {R.PLAN_SQL} SELECT feature, coalesce(['drifted', 'error', 'intended', 'approved', 'implemented'][min(list_position(['drifted', 'error', 'intended', 'approved', 'implemented'], status))], 'intended') AS status FROM plan GROUP BY feature""")
def feature_status(spark, sf):
    return views.feature_status(R.plan(spark, sf))


@query(f"WITH {R.PLAN_SQL} SELECT lens, (SELECT count(*) FROM plan WHERE list_contains(lens_tags, lens)) AS n FROM unnest(['red', 'bolt', 'ring', 'nobody']) AS t(lens)")
def lens_coverage(spark, sf):
    return views.lens_coverage(spark.createDataFrame([(x,) for x in ("red", "bolt", "ring", "nobody")], "lens string"), R.plan(spark, sf))


@query(f"WITH {R.PLAN_SQL} SELECT feature, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in views.SEVERITY) + " FROM plan GROUP BY feature")
def status_pivot(spark, sf):
    return views.status_pivot(R.plan(spark, sf), "feature", list(views.SEVERITY))


@query(f"""WITH {R.PLAN_SQL}, n AS (SELECT feature, id, row_number() OVER (PARTITION BY feature ORDER BY step, id) - 1 AS i, count(*) OVER (PARTITION BY feature) AS c FROM plan)
  SELECT 6 AS most, feature, id FROM n WHERE c <= 6 OR i IN (SELECT CAST(floor(k * (c - 1) / 5.0 + 0.5) AS BIGINT) FROM unnest(range(0, 6)) AS t(k))
  UNION ALL SELECT 1, feature, id FROM n WHERE i IN (0, c - 1) UNION ALL SELECT 2, feature, id FROM n WHERE i IN (0, c - 1)""")
def preview_pick(spark, sf):
    """With limits of six, two and one; the last still shows where a feature begins and ends."""
    of = lambda most: views.preview(R.plan(spark, sf), "feature", ["step", "id"], most).select(F.lit(most).alias("most"), "feature", "id")
    return of(6).unionByName(of(1)).unionByName(of(2))


@query(f"WITH {R.PLAN_SQL} SELECT feature, id, CAST((row_number() OVER (PARTITION BY feature ORDER BY step, id) - 1) // 10 AS INTEGER) AS chunk FROM plan")
def chunk_ranges(spark, sf):
    return views.chunks(R.plan(spark, sf), "feature", ["step", "id"], 10).select("feature", "id", "chunk")


@query(f"""WITH {R.PLAN_SQL}, f AS (SELECT feature, id, role = 'tool' AS shown, lag(role = 'tool') OVER (PARTITION BY feature ORDER BY id) AS was FROM plan),
  i AS (SELECT *, sum(CASE WHEN shown OR was IS NULL OR was THEN 1 ELSE 0 END) OVER (PARTITION BY feature ORDER BY id) AS island FROM f)
  SELECT feature, min(id) AS first, bool_or(shown) AS shown, count(*) AS n FROM i GROUP BY feature, island""")
def fold_runs(spark, sf):
    return views.fold_runs(R.plan(spark, sf), "feature", "id", F.col("role") == "tool")


@query(f"""WITH {R.PLAN_SQL}, t AS (SELECT feature, id, step, CAST(coalesce(sum(height) OVER (PARTITION BY feature ORDER BY step, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM plan)
  SELECT feature, id, top, lead(top) OVER (PARTITION BY feature ORDER BY step, id) AS next_top FROM t""")
def running_layout(spark, sf):
    return views.layout(R.plan(spark, sf), "feature", ["step", "id"], "height").select("feature", "id", "top", "next_top")


@query(f"WITH {R.PLAN_SQL} SELECT feature, id, coalesce(lead(id) OVER (PARTITION BY feature ORDER BY id), min(id) OVER (PARTITION BY feature)) AS following FROM plan WHERE status = 'drifted'")
def next_drift(spark, sf):
    return views.next_marked(R.plan(spark, sf).where("status = 'drifted'"), "feature", "id")


@query(f"WITH {R.PLAN_SQL} SELECT id, title FROM plan WHERE contains(lower(title), 'ring') OR contains(lower(feature), 'ring') ORDER BY step, id LIMIT 8")
def find_steps(spark, sf):
    return views.find_steps(R.plan(spark, sf), "RING", ["title", "feature"], ["step", "id"]).select("id", "title")


@query(f"WITH {R.PLAN_SQL} SELECT DISTINCT a.feature AS \"from\", b.feature AS \"to\" FROM plan a JOIN plan b ON b.id = a.parent WHERE a.feature <> b.feature")
def feature_edges(spark, sf):
    p = R.plan(spark, sf)
    return views.feature_edges(p.select(F.col("id").alias("from"), F.col("parent").alias("to")), p.select("id", "feature"))


@query(f"WITH {R.PLAN_SQL} SELECT DISTINCT feature, unnest([path[1], path[1] || ' > ' || path[2]]) AS heading FROM plan")
def heading_prefixes(spark, sf):
    return views.heading_prefixes(R.plan(spark, sf), "feature", "path")


@query("SELECT lower(w) AS key, arg_min(w, seq) AS spelling FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS w, p_partkey AS seq FROM part) GROUP BY lower(w)")
def vocabulary_first_spelling(spark, sf):
    word = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return views.first_spellings(R.table(spark, sf, "part").select(word.alias("word"), F.col("p_partkey").alias("seq")), "word")


_TAGS = {"metal": ("bolt", "gear", "ring"), "colour": ("red", "blue", "green"), "size": ("small", "large")}


@query("SELECT p_partkey AS id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f"contains(lower(p_name), '{w}')" for w in ws)} THEN '{t}' END" for t, ws in _TAGS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def fallback_tags(spark, sf):
    return R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(views.fallback_tags(F.col("p_name"), _TAGS), ",").alias("tags"))


@query(f"""WITH RECURSIVE {R.PLAN_SQL.strip()}, up AS (SELECT id, parent FROM plan WHERE title = 'red widget' UNION SELECT p.id, p.parent FROM up JOIN plan p ON p.id = up.parent) SELECT p.id, p.title FROM plan p WHERE p.id IN (SELECT id FROM up)""")
def tree_prune_by_tag(spark, sf):
    return graph.prune_to_ancestors(R.plan(spark, sf), F.col("title") == "red widget").select("id", "title")


# --- scalars and extraction ------------------------------------------------------------------------------------------


@query("""SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<script')) AS scripts,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def html_facts(spark, sf):
    count = lambda p, n: T.count_of(F.col("html"), p).cast("long").alias(n)
    return R.table(spark, sf, "pages").select("page_id", count("<a ", "links"), count("<p>", "paragraphs"), count("<script", "scripts"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""SELECT p_partkey AS id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(p_brand || 'getHTTPUrl$x' || p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: w <> ''), ',') AS words FROM part""")
def split_words(spark, sf):
    return R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.split_words(F.concat("p_brand", F.lit("getHTTPUrl$x"), "p_name")), ",").alias("words"))


@query(f"WITH {R.SNAPSHOTS_SQL} SELECT identity, file, name FROM snap_b")
def identity_parse(spark, sf):
    b, _ = R.snapshots(spark, sf)
    return b.select("identity", T.identity_file(F.col("identity")).alias("file"), T.identity_name(F.col("identity")).alias("name"))


@query("""SELECT o_orderkey AS id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN '1 day ago' ELSE d || ' days ago' END AS age
  FROM (SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '1998-10-04 12:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS d FROM orders)""")
def relative_dates(spark, sf):
    now = F.lit("1998-10-04 12:00:00").cast("timestamp")
    return R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.relative_age(F.col("o_orderdate").cast("timestamp"), now).alias("age"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """node_id, status, n_violations, dependants: rules over order facts, and how many customers depend on each order."""
    dependants = R.edges(spark, sf).groupBy(F.col("to").alias("id")).agg(F.count_distinct("from").alias("dependants"))
    drift = _verified(spark, sf).where("status <> 'implemented'").withColumn("id", F.concat(F.lit("order:"), F.col("node_id").cast("string")))
    return drift.join(dependants, "id", "left").select("node_id", "status", "n_violations", F.coalesce("dependants", F.lit(0)).cast("long").alias("dependants"))
