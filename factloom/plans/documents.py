"""Queries over whole reports, their scope, and the counts of views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, documents, impact
from ..operators.skew import spread
from . import relations as R
from .registry import query


def register(diffed, diff_sql: str, results, targets_sql: str) -> None:
    """Fill the registry; the catalogue gives the relations that it has."""

    def callers(spark, sf):
        b, a = R.snapshots(spark, sf)
        known = b.select("seq", "identity").unionByName(a.select("seq", "identity")).distinct()
        return known.join(known.select(F.col("seq").alias("up"), F.col("identity").alias("to")), F.expr("up = seq div 2")).select(F.col("identity").alias("from"), "to", F.lit("call").alias("kind"), F.lit("certain").alias("confidence"))

    @query(diff_sql + """, sig AS (SELECT identity, change_type, change_type IN ('added', 'deleted') OR identity IN (SELECT identity FROM changed WHERE significant) AS significant FROM kinds WHERE change_type <> 'unchanged'),
      known AS (SELECT seq, identity FROM snap_b UNION SELECT seq, identity FROM snap_a), pl AS (SELECT sig.*, seq FROM sig JOIN known USING (identity))
      SELECT pl.identity, change_type AS type, CASE WHEN significant THEN 'true' ELSE 'false' END AS significant, CAST((SELECT count(*) FROM changed c WHERE c.identity = pl.identity AND pl.change_type = 'changed') AS INTEGER) AS n_delta,
        CASE WHEN significant THEN CAST((SELECT count(*) FROM known k WHERE k.identity <> pl.identity AND (k.seq // 2 = pl.seq OR k.seq // 4 = pl.seq AND EXISTS (FROM known m WHERE m.seq = k.seq // 2)
          OR k.seq // 8 = pl.seq AND EXISTS (FROM known m WHERE m.seq = k.seq // 2) AND EXISTS (FROM known m WHERE m.seq = k.seq // 4))) AS INTEGER) END AS n_affected FROM pl""")
    def check_entries(spark, sf):
        """The entries of a check's report, taken apart again."""
        changes = diffed(spark, sf)
        judged = diff.analyse_significance(changes).select("identity", F.lit(True).alias("_significant"))
        changes = changes.where("change_type <> 'unchanged'").join(judged, "identity", "left").withColumn("significant", F.coalesce("_significant", F.lit(False)))
        kept = F.when(F.col("change_type") == "changed", F.col("changes")).otherwise(F.slice("changes", 1, 0))
        _, entries = documents.check_document(changes.withColumn("changes", kept), callers(spark, sf), "p", "t")
        of = lambda path: F.get_json_object("entry", path)
        n_delta = F.size(F.json_object_keys(of("$.delta")))
        return entries.select("identity", of("$.type").alias("type"), of("$.significant").alias("significant"), n_delta.alias("n_delta"), F.json_array_length(of("$.impact.affected")).alias("n_affected"))

    def told(spark, sf):
        rows = results(spark, sf)
        number = F.regexp_extract("identity", ":([0-9]+)$", 1).cast("long")
        listed = lambda when, text: F.when(when, F.array(F.concat(F.lit(text), "identity"))).otherwise(F.array().cast("array<string>"))
        return rows.select(number.alias("seq"), "identity", "status", F.when(number % 3 > 0, F.concat(F.lit("a|b "), "identity")).alias("intent"), F.lit("me").alias("approved_by"), F.lit(None).cast("timestamp").alias("approved_at"), listed(F.col("status") == "drifted", "throws "), listed(F.col("status") == "error", "gone "), listed(number % 50 == 0, "layer ")).toDF("seq", "identity", "status", "intent", "approved_by", "approved_at", "violations", "errors", "unsupported")

    @query(targets_sql + """, res AS (SELECT 'order:' || node_id AS identity, status FROM nodes UNION ALL SELECT target, 'error' FROM asked WHERE target NOT LIKE 'order:%'),
      r AS (SELECT *, CAST(string_split(identity, ':')[2] AS BIGINT) AS seq FROM res), a AS (SELECT target, list('| ' || id || ' | ' || confidence || ' |' ORDER BY place) AS rows FROM walked GROUP BY target),
      lines AS (SELECT 1 AS section, seq, identity, unnest(list_concat(['### `' || identity || '`', '', '**Intent:** ' || CASE WHEN seq % 3 > 0 THEN 'a\\|b ' || identity ELSE 'unknown' END, '**Approver:** me', '**Approved:** unknown date', '', '| Violation |', '|---|', '| throws ' || identity || ' |', ''],
          CASE WHEN a.rows IS NULL THEN [] ELSE list_concat(['| Impact | Confidence |', '|---|---|'], a.rows, ['']) END)) AS line FROM r LEFT JOIN a ON target = identity WHERE status = 'drifted'
        UNION ALL SELECT 2, seq, identity, unnest(['### `' || identity || '`', '', '- gone ' || identity, '']) FROM r WHERE status = 'error'
        UNION ALL SELECT 3, seq, identity, '- `' || identity || '`: layer ' || identity FROM r WHERE seq % 50 = 0)
      SELECT section, seq, line, count(*) AS n FROM lines GROUP BY ALL""")
    def verify_report(spark, sf):
        """The lines of a verification's Markdown below the headings, counted; their order is in the tests."""
        rows = impact.impact_of_results(told(spark, sf), R.edges(spark, sf))
        lines = documents.verify_report_lines(rows, "p", "t", F.lit(None).cast("timestamp")).where("seq >= 0")
        return spread(lines, "section", "seq", "line", total=12 * R.table(spark, sf, "orders").count()).groupBy("section", "seq", "line").agg(F.count("*").alias("n"))

    @query(f"""WITH {R.PLAN_SQL} SELECT 'drifted' AS what, count(*) FILTER (WHERE status = 'drifted') AS n FROM plan UNION ALL SELECT 'declarations', count(*) FROM plan
      UNION ALL SELECT 'nodes', count(*) FILTER (WHERE id % 7 > 1) FROM plan""")
    def view_counts(spark, sf):
        plan = R.plan(spark, sf)
        tree = plan.select(F.when(F.col("id") % 7 == 0, "feature").when(F.col("id") % 7 == 1, "group").alias("kind"))
        named = lambda what, rows: rows.select(F.lit(what).alias("what"), "n")
        return named("drifted", documents.drift_count(plan)).unionByName(named("declarations", documents.declaration_count(plan))).unionByName(named("nodes", documents.count_nodes(tree)))

    @query(f"""WITH {R.PLAN_SQL}, n AS (SELECT *, CASE WHEN id % 4 > 0 THEN feature || id END AS identity FROM plan WHERE status = 'approved' AND id % 4 > 0)
      SELECT 'all' AS scope, id FROM n UNION ALL SELECT 'lens', id FROM n WHERE list_contains(lens_tags, 'ring') UNION ALL SELECT 'both', id FROM n WHERE list_contains(lens_tags, 'ring') AND title = 'red ring'
      UNION ALL SELECT 'id', id FROM n WHERE id = 9""")
    def verify_scopes(spark, sf):
        nodes = R.plan(spark, sf).withColumn("identity", F.when(F.col("id") % 4 > 0, F.concat("feature", F.col("id").cast("string")))).withColumn("identities", F.array("title"))
        of = lambda name, **by: documents.verify_scope(nodes, **by).select(F.lit(name).alias("scope"), "id")
        return of("all").unionByName(of("lens", lens="ring")).unionByName(of("both", lens="ring", identity="red ring")).unionByName(of("id", identity="9"))

