"""Input relations of the queries, derived from the star-schema tables; each has a SQL twin for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.skew import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of facts: some declarations deleted, added and changed, some only in noise."""
    part = spread(table(spark, sf, "part"), "p_partkey")
    key = F.col("p_partkey")

    def side(rows: DataFrame, grown, extra) -> DataFrame:
        size = F.col("p_size") + grown
        calls = F.array_sort(F.array_distinct(F.concat(F.array(F.concat(F.lower("p_type"), F.lit(".run")), F.lit("save")), extra)))
        return rows.select(
            F.concat_ws(":", F.concat_ws("::", "p_brand", "p_name"), key.cast("string")).alias("identity"),
            F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), key.alias("seq"),
            (size % 4).alias("throws"), size.alias("returns"), (size % 3).alias("returns_nullish"), calls.alias("calls"), F.array(size).alias("numbers"),
            (key % 2).cast("int").alias("awaits"), F.lit(0).alias("catches"), (F.col("p_size") % 5).alias("params"),
        )

    none = F.array().cast("array<string>")
    noise = F.when(key % 4 == 0, F.array(F.lit("console.log"))).otherwise(none)
    retry = F.when(key % 8 == 0, F.array(F.lit("retry"))).otherwise(none)
    before = side(part.where(key % 10 != 0), F.lit(0), none)
    after = side(part.where(key % 10 != 1), (key % 3 == 0).cast("int"), F.concat(noise, retry))
    return before, after


_SIDE = """
  SELECT p_brand || '::' || p_name || ':' || p_partkey AS identity, p_brand AS file, p_name AS name, 'function' AS kind, p_partkey AS seq,
         size % 4 AS throws, size AS returns, size % 3 AS returns_nullish, list_sort(list_distinct(list_concat([lower(p_type) || '.run', 'save'], extra))) AS calls,
         [size] AS numbers, CAST(p_partkey % 2 AS INTEGER) AS awaits, 0 AS catches, p_size % 5 AS params
"""
SNAPSHOTS_SQL = f"""
  snap_b AS ({_SIDE} FROM (SELECT *, p_size AS size, CAST([] AS VARCHAR[]) AS extra FROM part WHERE p_partkey % 10 <> 0)),
  snap_a AS ({_SIDE} FROM (SELECT *, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS size,
    list_concat(CASE WHEN p_partkey % 4 = 0 THEN ['console.log'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN p_partkey % 8 = 0 THEN ['retry'] ELSE CAST([] AS VARCHAR[]) END) AS extra
    FROM part WHERE p_partkey % 10 <> 1))"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """node_id, facts, approved: per order, from its lines; a third of the orders have an approved snapshot."""
    line = table(spark, sf, "lineitem")
    late = F.col("l_linenumber") == 7
    rows = line.groupBy(F.col("l_orderkey").alias("node_id")).agg(
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("throws"),
        F.count("*").cast("int").alias("returns"),
        F.count_if(F.col("l_linestatus") == "O").cast("int").alias("returns_nullish"),
        F.max("l_linenumber").alias("params"),
        F.array_sort(F.collect_set(F.concat_ws(".", "l_returnflag", "l_linestatus"))).alias("calls"),
        F.array_sort(F.collect_set(F.col("l_quantity").cast("int"))).alias("numbers"),
        F.count_if((F.col("l_returnflag") == "R") & ~late).cast("int").alias("throws0"),
    )
    now = F.struct("throws", "returns", "returns_nullish", "params", "calls", "numbers")
    then = F.struct(F.col("throws0").alias("throws"), "returns", "returns_nullish", "params", "calls", "numbers")
    return rows.select("node_id", now.alias("facts"), F.when(F.col("node_id") % 3 == 0, then).alias("approved"))


FACTS_SQL = """
  facts AS (
    SELECT l_orderkey AS node_id, count(*) FILTER (WHERE l_returnflag = 'R') AS throws, count(*) AS returns, count(*) FILTER (WHERE l_linestatus = 'O') AS returns_nullish,
           max(l_linenumber) AS params, list_sort(list_distinct(list(l_returnflag || '.' || l_linestatus))) AS calls,
           list_sort(list_distinct(list(CAST(l_quantity AS INTEGER)))) AS numbers,
           count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber <> 7) AS throws0, l_orderkey % 3 = 0 AS has_snapshot
    FROM lineitem GROUP BY l_orderkey)"""

#: Rules as rows: id, field, op, numeric value, text value; three of them (8 to 10) cannot be evaluated.
RULES = (
    (1, "throws", "<=", 1.0, None), (2, "returns", ">=", 2.0, None), (3, "params", "==", 7.0, None), (4, "returns_nullish", "!=", 0.0, None),
    (5, "calls", "contains", None, "R.F"), (6, "calls", "notContains", None, "N.O"), (7, "throws", "unchanged", None, None),
    (8, "calls", ">=", 1.0, None), (9, "returns", "contains", None, "x"), (10, "entries", "contains", None, "x"),
    (11, "numbers", "contains", 7.0, None), (12, "numbers", "notContains", 7.0, None),
)


def ruled(spark: SparkSession, sf: str, ids: tuple[int, ...]) -> DataFrame:
    """Every node with each of the rules: a literal array, so no join."""
    rule = lambda r: F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("field"), F.lit(r[2]).alias("op"), F.lit(r[3]).cast("double").alias("value_num"), F.lit(r[4]).cast("string").alias("value_str"))
    return facts(spark, sf).withColumn("clause", F.explode(F.array(*[rule(r) for r in RULES if r[0] in ids])))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies by foreign keys; those between orders and suppliers are inferred from lines."""
    key = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))

    def links(df: DataFrame, a, b, kind: str, sure: str) -> DataFrame:
        return df.select(a.alias("from"), b.alias("to"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))

    orders, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return (
        links(orders, key("customer", "o_custkey"), key("order", "o_orderkey"), "call", "certain")
        .unionByName(links(line, key("order", "l_orderkey"), key("supplier", "l_suppkey"), "call", "inferred").distinct())
        .unionByName(links(table(spark, sf, "supplier"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "import", "certain"))
        .unionByName(links(table(spark, sf, "nation"), key("nation", "n_nationkey"), key("region", "n_regionkey"), "import", "certain"))
    )


EDGES_SQL = """
  edges AS (
    SELECT 'customer:' || o_custkey AS "from", 'order:' || o_orderkey AS "to", 'call' AS kind, 'certain' AS confidence FROM orders
    UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'call', 'inferred' FROM lineitem
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'import', 'certain' FROM supplier
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'import', 'certain' FROM nation)"""


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """identity, file, name, kind, params, seq, calls: parts as declarations that call earlier ones by dotted names."""
    part = table(spark, sf, "part")
    name = F.concat(F.regexp_replace("p_name", " ", "."), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("."), F.col("p_partkey").cast("string"))).otherwise(F.lit("")))
    rows = part.select("p_partkey", "p_brand", "p_size", name.alias("name"))
    other = rows.select(F.col("p_partkey").alias("other_key"), F.col("name").alias("other"))
    return rows.join(other, F.expr("other_key = p_partkey div 2")).select(
        F.concat_ws(":", F.concat_ws("::", "p_brand", "name"), F.col("p_partkey").cast("string")).alias("identity"),
        F.col("p_brand").alias("file"), "name", F.when(F.col("p_size") % 9 == 0, "data").otherwise("function").alias("kind"), (F.col("p_size") % 4).alias("params"), F.col("p_partkey").alias("seq"),
        F.array(F.concat(F.lit("svc."), F.col("other")), F.col("other"), F.lit("console.log")).alias("calls"),
    )


DECLARATIONS_SQL = """
  named AS (SELECT *, replace(p_name, ' ', '.') || CASE WHEN p_partkey % 7 = 0 THEN '.' || p_partkey ELSE '' END AS name FROM part),
  decl AS (
    SELECT a.p_brand || '::' || a.name || ':' || a.p_partkey AS identity, a.p_brand AS file, a.name, CASE WHEN a.p_size % 9 = 0 THEN 'data' ELSE 'function' END AS kind,
           a.p_size % 4 AS params, a.p_partkey AS seq, ['svc.' || b.name, b.name, 'console.log'] AS calls
    FROM named a JOIN named b ON b.p_partkey = a.p_partkey // 2)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    """seq, ts, identity, type, before, after: the event stream as a change log; signup adds, error deletes, others change."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("changed")
    value = F.floor("value").cast("long")
    before = F.lag(value).over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("identity"), kind.alias("type"), before.alias("before"), value.alias("after"), "event_type")


LOG_SQL = """
  log AS (
    SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS identity, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'changed' END AS type,
           lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS before, CAST(floor(value) AS BIGINT) AS after, event_type
    FROM events)"""


def plan(spark: SparkSession, sf: str) -> DataFrame:
    """id, title, feature, step, status, lens_tags, path, role, parent, height: parts as plan steps."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    status = F.when(key % 11 == 0, "drifted").when(key % 13 == 0, "error").when(key % 5 == 0, "superseded").when(key % 3 == 0, "approved").when(key % 2 == 0, "implemented").otherwise("intended")
    words = T.split_words(F.col("p_name"))
    return p.select(
        key.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("feature"), F.col("p_size").alias("step"), status.alias("status"), words.alias("lens_tags"),
        F.array(F.col("p_type"), F.col("p_name")).alias("path"), F.when(key % 4 == 0, "tool").otherwise("behaviour").alias("role"), F.when(key > 0, F.expr("p_partkey div 3")).alias("parent"), (F.col("p_size") % 6 + 1).alias("height"),
    )


PLAN_SQL = """
  plan AS (
    SELECT p_partkey AS id, p_name AS title, p_brand AS feature, p_size AS step,
           CASE WHEN p_partkey % 11 = 0 THEN 'drifted' WHEN p_partkey % 13 = 0 THEN 'error' WHEN p_partkey % 5 = 0 THEN 'superseded' WHEN p_partkey % 3 = 0 THEN 'approved'
                WHEN p_partkey % 2 = 0 THEN 'implemented' ELSE 'intended' END AS status,
           string_split(p_name, ' ') AS lens_tags, [p_type, p_name] AS path, CASE WHEN p_partkey % 4 = 0 THEN 'tool' ELSE 'behaviour' END AS role,
           CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, p_size % 6 + 1 AS height
    FROM part)"""
