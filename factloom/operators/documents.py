"""Whole reports of checks and verifications, with the impact of every result; a row an entry or a line, so their size is free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_cell, relative_age
from .impact import impact_of_results
from .reports import verify_totals

# The version of the report formats, and the headings of a verification's text.
SCHEMA = 1
_SECTIONS = {1: "## Drifted", 2: "## Errors", 3: "## Unsupported"}


def verify_scope(nodes: DataFrame, lens: str | None = None, identity: str | None = None) -> DataFrame:
    """The nodes that a verification looks at: approved, with the lens, named by the identity or id, and with an identity of their own."""
    kept = nodes.where((F.col("status") == "approved") & (F.coalesce(F.col("identity"), F.lit("")) != ""))
    if lens:
        kept = kept.where(F.array_contains("lens_tags", lens))
    if identity:
        own = F.coalesce(F.array_contains("identities", identity), F.lit(False))
        kept = kept.where((F.col("id").cast("string") == identity) | (F.col("identity") == identity) | own)
    return kept


def check_document(changes: DataFrame, edges: DataFrame, project: str, generated_at: str) -> tuple[DataFrame, DataFrame]:
    """A check's report: one row ``report`` (schema, generatedAt, project, summary) and rows (identity, entry), all as JSON texts.

    ``changes`` has identity, change_type, significant and changes (property, before, after); unchanged ones are no part of it.
    An entry has identity, type, significant, delta by property, and of significant changes the impact: affected, unresolved
    (edges of the graph that lead nowhere) and truncated.
    """
    real = changes.where("change_type in ('added', 'deleted', 'changed')")
    of = lambda kind: F.count_if(F.col("change_type") == kind)
    summary = F.struct(F.count("*").alias("changes"), F.count_if("significant").alias("significant"), F.count_if(~F.col("significant")).alias("insignificant"), of("added").alias("added"), of("deleted").alias("deleted"))
    head = real.agg(summary.alias("s")).select(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit(generated_at).alias("generatedAt"), F.lit(project).alias("project"), F.col("s").alias("summary"))).alias("report"))
    unresolved = edges.where("`to` is null").count()
    walked = impact_of_results(real.withColumn("status", F.when(F.col("significant"), "drifted").otherwise("implemented")), edges)
    delta = F.map_from_entries(F.transform("changes", lambda c: F.struct(c["property"].alias("key"), F.struct(c["before"].alias("before"), c["after"].alias("after")).alias("value"))))
    impact = F.when(F.col("significant"), F.struct(F.col("impact").alias("affected"), F.lit(unresolved).alias("unresolved"), "truncated"))
    entry = F.struct("identity", F.col("change_type").alias("type"), "significant", delta.alias("delta"), impact.alias("impact"))
    return head, walked.select("identity", F.to_json(entry).alias("entry"))


def verify_document(results: DataFrame, edges: DataFrame, project: str, generated_at: str) -> tuple[DataFrame, DataFrame]:
    """A verification's report: one row ``report`` (schema, generatedAt, project, summary) and rows (seq, identity, status, entry), as JSON texts.

    ``results`` has seq, identity, status (implemented, drifted, error), the arrays violations, errors and unsupported, and
    whatever else is to be told; those that are not implemented get their impact.
    """
    totals = verify_totals(results).select(F.struct(F.col("checked").alias("approved"), F.col("implemented").alias("verified"), "drifted", "errors", "unsupported").alias("s"))
    head = totals.select(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit(generated_at).alias("generatedAt"), F.lit(project).alias("project"), F.col("s").alias("summary"))).alias("report"))
    told = impact_of_results(results, edges)
    return head, told.select("seq", "identity", "status", F.to_json(F.struct(*[F.col(c) for c in told.columns if c not in ("seq", "truncated")])).alias("entry"))


def _table(head: list[str], rows: Column) -> Column:
    """A table with its heading and the empty line behind it; nothing without rows."""
    none = F.array().cast("array<string>")
    return F.when(F.size(rows) > 0, F.concat(F.array(*map(F.lit, head)), rows, F.array(F.lit("")))).otherwise(none)


def verify_report_lines(results: DataFrame, project: str, generated_at: str, now: Column) -> DataFrame:
    """section, seq, place, line of a verification's Markdown; sorted by the first three they are the text.

    ``results`` (as ``impact_of_results`` gives them) has seq, identity, status, intent, approved_by, approved_at, violations,
    errors, unsupported (texts) and impact. Drifted results come with their violations and impact, errors with their
    messages, then what is unsupported of all.
    """
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    cell = lambda c: F.concat(F.lit("| "), escape_cell(c), F.lit(" |"))
    title = F.concat(F.lit("### `"), escape_cell(F.col("identity")), F.lit("`"))
    about = F.array(title, F.lit(""), F.concat(F.lit("**Intent:** "), escape_cell(F.col("intent"))), F.concat(F.lit("**Approver:** "), escape_cell(F.col("approved_by"))), F.concat(F.lit("**Approved:** "), F.when(F.col("approved_at").isNull(), "unknown date").otherwise(relative_age(F.col("approved_at"), now))), F.lit(""))
    violations = _table(["| Violation |", "|---|"], F.transform(listed("violations"), cell))
    impact = _table(["| Impact | Confidence |", "|---|---|"], F.transform("impact", lambda e: F.concat(F.lit("| "), escape_cell(e["identity"]), F.lit(" | "), escape_cell(e["confidence"]), F.lit(" |"))))
    messages = F.transform(listed("errors"), lambda e: F.concat(F.lit("- "), escape_cell(e)))
    other = F.transform(listed("unsupported"), lambda u: F.concat(F.lit("- `"), escape_cell(F.col("identity")), F.lit("`: "), escape_cell(u)))
    part = lambda section, when, lines: F.when(when, F.struct(F.lit(section).alias("section"), lines.alias("lines")))
    parts = F.array_compact(F.array(
        part(1, F.col("status") == "drifted", F.concat(about, violations, impact)), part(2, F.col("status") == "error", F.concat(F.array(title, F.lit("")), messages, F.array(F.lit("")))), part(3, F.size(listed("unsupported")) > 0, other),
    ))
    body = results.select("seq", F.explode(parts).alias("part")).select("part.section", "seq", "part.lines")  # one pass over the results
    heading = F.coalesce(*[F.when(F.col("section") == k, F.lit(t)) for k, t in _SECTIONS.items()])
    heads = body.groupBy("section").agg(F.lit(-1).cast("long").alias("seq")).withColumn("lines", F.array(heading, F.lit("")))
    totals = verify_totals(results)
    counts = [F.concat(F.lit(f"| {name} | "), F.col(c).cast("string"), F.lit(" |")) for name, c in (("Approved", "checked"), ("Verified", "implemented"), ("Drifted", "drifted"), ("Errors", "errors"), ("Unsupported", "unsupported"))]
    fixed = ["# Verify", "", f"Project: `{project}`", f"Generated: `{generated_at}`", "", "## Summary", "", "| Status | Count |", "|---|---:|"]
    top = totals.select(F.lit(0).alias("section"), F.lit(-1).cast("long").alias("seq"), F.array(*map(F.lit, fixed), *counts, F.lit("")).alias("lines"))
    every = top.unionByName(heads).unionByName(body.withColumn("seq", F.col("seq").cast("long")))
    return every.select("section", "seq", F.posexplode("lines").alias("place", "line"))


def drift_count(verified: DataFrame) -> DataFrame:
    """One row ``n``: the identities whose verified status is drifted."""
    return verified.agg(F.count_if(F.col("status") == "drifted").alias("n"))


def declaration_count(baseline: DataFrame | None, spark=None) -> DataFrame:
    """One row ``n``: the declarations of a baseline; null if there is none."""
    return baseline.agg(F.count("*").alias("n")) if baseline is not None else spark.range(1).select(F.lit(None).cast("long").alias("n"))


def count_nodes(tree: DataFrame) -> DataFrame:
    """One row ``n``: the rows of a tree that are neither a feature nor a group of their own (``kind``)."""
    return tree.agg(F.count_if(~F.coalesce(F.col("kind"), F.lit("")).isin("feature", "group")).alias("n"))
