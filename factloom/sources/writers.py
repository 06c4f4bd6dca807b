"""Sinks: snapshots, event appends and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import with_rank
from ..operators.reports import evolution_lines
from ..operators.validation import plan_problems
from .readers import VERSION
from .store import EventLog

# Types of session markers.
MARKERS = ("session_started", "session_sealed")


def write_snapshot(declarations: DataFrame, path: str) -> None:
    """Overwrites a snapshot: one JSON line a declaration with the format's version, sorted by identity; ``read_snapshot`` reads it."""
    rows = declarations.select(F.lit(VERSION).alias("version"), "identity", "file", "kind", "properties")
    rows.orderBy("identity").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_changes(incoming: DataFrame, path: str, same: list[str]) -> int:
    """Appends those events that differ from the event of their identity before them, in the log or among themselves; how many.

    ``incoming`` has seq (of its own order), ts, identity, type and the columns ``same``. The log is a ``store.EventLog``: what is
    read of it is the last event of the identities at hand, and appended events are numbered on.
    """
    return EventLog(incoming.sparkSession, path, same).append(incoming)


def append_marker(spark: SparkSession, path: str, kind: str, session: str, ts: str, reason: str | None = None, commit: str | None = None) -> None:
    """One session marker; a kind that is none is an error."""
    if kind not in MARKERS:
        raise ValueError(f"{kind} is no session marker")
    row = spark.createDataFrame([(0, ts, kind, session, reason, commit)], "seq long, ts string, type string, sessionId string, reason string, commit string")
    EventLog(spark, path, ["type"]).append(row.withColumn("identity", F.lit(None).cast("string")), deduped=False)


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Overwrites the sessions; a failed write leaves no half of them behind, as Spark commits files when all are there."""
    sessions.write.mode("overwrite").json(path)


def write_plan(documents: DataFrame, path: str, column: str = "document") -> None:
    """Overwrites a plan with its document (JSON text); an invalid one is an error that names its first problems."""
    problems = documents.select(F.explode(plan_problems(F.col(column))).alias("p")).limit(10).collect()
    if problems:
        raise ValueError("; ".join(r[0] for r in problems))
    documents.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_evolution(nodes: DataFrame, path: str) -> None:
    nodes.orderBy("seq").write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Overwrites nodes (by id) and edges (by all their columns) under ``path``; ``read_graph`` reads them."""
    nodes.orderBy("id").write.mode("overwrite").json(f"{path}/nodes")
    edges.select("from", "to", "kind", "confidence", "reason").orderBy("from", "to", "kind", "confidence").write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """What ``write_graph`` wrote, or nothing if that is missing."""
    try:
        nodes = spark.read.schema("id string, kind string, name string, file string").json(f"{path}/nodes")
        return nodes, spark.read.schema("`from` string, `to` string, kind string, confidence string, reason string").json(f"{path}/edges")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def write_evolution_markdown(rows: DataFrame, path: str) -> None:
    """The history as Markdown text files in order (``reports.evolution_lines``) under a heading."""
    top = rows.sparkSession.createDataFrame([(-1, 0, "# Project Evolution"), (-1, 1, "")], "place long, part int, line string")
    top.unionByName(evolution_lines(rows)).orderBy("place", "part").select("line").write.mode("overwrite").text(path)


def declaration_lines(declarations: DataFrame) -> DataFrame:
    """identity, line: kind and name in columns of fixed width, longer ones whole, then the place."""
    wide = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(F.col(c))
    return declarations.select("identity", F.concat(wide("kind", 12), F.lit(" "), wide("name", 40), F.lit(" "), "file", F.lit(":"), F.col("start").cast("string")).alias("line"))


def diff_lines(changes: DataFrame) -> DataFrame:
    """identity, place, line of a diff: a line for the declaration, then one a changed property."""
    head = changes.select("identity", F.lit(0).alias("place"), F.concat(F.col("change_type"), F.lit(" "), "identity").alias("line")).where("change_type <> 'unchanged'")
    each = changes.select("identity", F.posexplode("changes").alias("k", "c"))
    text = F.concat(F.lit("  "), "c.property", F.lit(": "), F.coalesce("c.before", F.lit("-")), F.lit(" → "), F.coalesce("c.after", F.lit("-")))
    return head.unionByName(each.select("identity", (F.col("k") + 1).alias("place"), text.alias("line")))


def append_initial(declarations: DataFrame, log: DataFrame, path: str, ts: str) -> bool:
    """One ``added`` event a declaration with a shared time; nothing if the log has any event."""
    if not log.isEmpty():
        return False
    added = with_rank(declarations.select(F.lit(ts).alias("ts"), "identity", F.lit("added").alias("type")), ["identity"])
    EventLog(declarations.sparkSession, path, ["type"]).append(added.withColumnRenamed("rank", "seq"), deduped=False)
    return True


def check_report(changes: DataFrame) -> DataFrame:
    """One JSON row: total, significant, insignificant, added, deleted, changed counts of (identity, change_type, significant)."""
    kinds = [F.count_if(F.col("change_type") == k).alias(k) for k in ("added", "deleted", "changed")]
    one = changes.where("change_type <> 'unchanged'").agg(F.count("*").alias("total"), F.count_if("significant").alias("significant"), F.count_if(~F.col("significant")).alias("insignificant"), *kinds)
    return one.select(F.to_json(F.struct("*")).alias("report"), (F.col("significant") > 0).cast("int").alias("exit_code"))


def check_changes(changes: DataFrame) -> DataFrame:
    """identity, entry: the changes of a check's report as one JSON text each, unchanged ones left out; the summary is ``check_report``'s."""
    return changes.where("change_type <> 'unchanged'").select("identity", F.to_json(F.struct("identity", F.col("change_type").alias("type"), "significant", "changes")).alias("entry"))


def verify_markdown(results: DataFrame) -> DataFrame:
    """Ordered lines (section, place, line) of a verification's Markdown: every result in its status's section, empty ones left out."""
    titles = {"drifted": 1, "error": 2, "implemented": 3}
    section = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for s, i in titles.items()], F.lit(len(titles) + 1))
    rows = results.select(section.alias("section"), "status", F.struct("node_id").alias("place"), F.concat(F.lit("- "), F.col("node_id").cast("string"), F.lit(": "), F.col("n_violations").cast("string"), F.lit(" violations")).alias("line"))
    heads = rows.groupBy("section", "status").agg(F.lit(None).cast(rows.schema["place"].dataType).alias("place")).withColumn("line", F.concat(F.lit("## "), "status"))
    top = results.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit(None).cast(rows.schema["place"].dataType).alias("place"), F.lit("# Verification").alias("line"))
    columns = ["section", "place", "line"]
    return top.unionByName(heads.select(columns)).unionByName(rows.select(columns)).orderBy("section", F.col("place").asc_nulls_first())


def write_verify_markdown(results: DataFrame, path: str) -> None:
    """The whole report as text files in order; of an earlier report nothing stays."""
    verify_markdown(results).select("line").write.mode("overwrite").text(path)
