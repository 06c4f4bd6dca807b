"""Queries over stores and feeds: appended logs, merged tables, file changes, and sessions out of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events
from ..sources import readers, store, writers
from ..streaming import processors
from . import relations as R
from .authoring import WATCHED_SQL, watched_feed
from .registry import query


@query(f"""WITH {R.LOG_SQL}, k AS (SELECT * FROM log QUALIFY type IS DISTINCT FROM lag(type) OVER (PARTITION BY identity ORDER BY seq))
  SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, identity, type FROM k""")
def appended_log(spark, sf):
    """The change log, appended in four pieces and read back."""
    rows, path = R.log(spark, sf).select("seq", F.col("ts").cast("string").alias("ts"), "identity", "type"), store.scratch(spark, "log")
    bound = rows.agg(F.max("seq")).first()[0] or 0
    for i in range(4):
        writers.append_changes(rows.where(F.floor(F.col("seq") * 4 / (bound + 1)) == i), path, ["type"])
    return readers.read_events(spark, path)[0].select("seq", "identity", "type")


@query(f"""WITH {R.PLAN_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN 'drifted' ELSE status END AS status, CAST(CASE WHEN id % 10 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM plan
  UNION ALL SELECT -id, 'intended', CAST(3 AS INTEGER) FROM plan WHERE id % 25 = 1""")
def merged_store(spark, sf):
    """A plan's rows, some of them put anew and some added in two later updates."""
    plan, path = R.plan(spark, sf), store.scratch(spark, "plan")
    put = lambda rows: store.update_rows(rows, path)
    put(plan.select("id", "status", F.lit(1).alias("version")))
    put(plan.where("id % 10 = 0").select("id", F.lit("drifted").alias("status"), F.lit(2).alias("version")))
    put(plan.where("id % 25 = 1").select((-F.col("id")).alias("id"), F.lit("intended").alias("status"), F.lit(3).alias("version")))
    return store.read_rows(spark, path)


@query("""WITH feed AS (SELECT CAST(user_id AS VARCHAR) AS file, user_id % 3 > 0 AS based, event_id AS seq, ts, event_type = 'error' AS gone,
    CASE WHEN event_type <> 'error' AND event_id % 11 > 0 THEN CAST(floor(value) AS BIGINT) % 3 END AS a, CASE WHEN event_type <> 'error' AND event_id % 11 > 0 AND event_id % 3 > 0 THEN event_id % 2 END AS b FROM events),
  fired AS (SELECT * FROM feed QUALIFY gone OR coalesce(lead(ts) OVER (PARTITION BY file ORDER BY ts, seq) - ts >= INTERVAL 600 SECOND, true)),
  told AS (SELECT *, coalesce(CAST(a AS VARCHAR), '-') || '|' || coalesce(CAST(b AS VARCHAR), '-') AS sig FROM fired WHERE NOT gone OR based),
  marked AS (SELECT *, sig IS DISTINCT FROM lag(sig) OVER (PARTITION BY file ORDER BY ts, seq) AS counts FROM told),
  seen AS (SELECT *, last_value(CASE WHEN counts AND NOT gone THEN {'a': a, 'b': b} END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM marked),
  pairs AS (SELECT file, seq, CASE WHEN gone OR p IS NULL THEN CASE WHEN based THEN 0 END ELSE p.a END AS a0, CASE WHEN gone OR p IS NULL THEN NULL ELSE p.b END AS b0, CASE WHEN (gone OR p IS NULL) AND based THEN 9 END AS c0, a, b FROM seen WHERE counts),
  each AS (SELECT file, seq, 'a' AS identity, a0 AS was, a AS now FROM pairs UNION ALL SELECT file, seq, 'b', b0, b FROM pairs UNION ALL SELECT file, seq, 'c', c0, NULL FROM pairs)
  SELECT file, seq, identity, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' ELSE 'changed' END AS type FROM each WHERE was IS DISTINCT FROM now""")
def file_changes_replay(spark, sf):
    """A feed of saves and removals of files whose declarations follow from the events."""
    e = R.table(spark, sf, "events")
    gone = F.col("event_type") == "error"
    entry = lambda name, value, there: F.when(there, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    full = F.col("event_id") % 11 > 0
    facts = F.map_from_entries(F.array_compact(F.array(entry("a", F.floor("value").cast("long") % 3, full), entry("b", F.col("event_id") % 2, full & (F.col("event_id") % 3 > 0)))))
    feed = e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("seq"), "ts", F.when(gone, "unlink").otherwise("change").alias("op"), F.when(~gone, facts).alias("facts"))
    base = e.where("user_id % 3 > 0").select(F.col("user_id").cast("string").alias("file")).distinct().withColumn("facts", F.create_map(F.lit("a"), F.lit("0"), F.lit("c"), F.lit("9")))
    return events.file_changes(feed, base, 600).select("file", "seq", "identity", "type")


#: Events that the live feed hands over at a time.
_PIECE = 1_000_000


@query(WATCHED_SQL + """, t AS (SELECT max(ts) AS now FROM e), ends AS (SELECT project, session, max(ts) AS last FROM fold WHERE control IS NULL GROUP BY project, session)
  SELECT CAST(fold.project AS INTEGER) AS project, seq, CAST(number AS INTEGER) AS session, CASE WHEN sealed_by = 'open' THEN 'idle' ELSE sealed_by END AS sealed_by
  FROM fold JOIN k ON k.project = fold.project AND k.session = fold.session JOIN ends ON ends.project = fold.project AND ends.session = fold.session, t
  WHERE control IS NULL AND (sealed_by <> 'open' OR last + INTERVAL 30 MINUTE <= date_trunc('millisecond', now))""")
def live_sessions(spark, sf):
    """The sessions of ``watched_sessions`` as a stream tells them: those that have ended, idle ones by the watermark alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    table, out = R.table(spark, sf, "events"), store.scratch(spark, "live")
    # The feed comes in pieces of time, each of which the watermark passes before the next, so no more than a piece waits in state.
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    pieces = -(-table.where("ts is not null").count() // _PIECE)
    cuts = sorted(set(table.select(us.cast("double").alias("us")).approxQuantile("us", [i / pieces for i in range(1, pieces)], 0.1 / pieces))) if pieces > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        piece = table if low is None else table.where(us > int(low))
        (piece if high is None else piece.where(us <= int(high))).write.mode("append").parquet(f"{out}/feed")
        stream = watched_feed(spark.readStream.schema(table.schema).parquet(f"{out}/feed")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds")
        told = processors.watched_sessions(stream, "project", "user_id")
        told.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("project int, seq long, session int, sealed_by string").parquet(f"{out}/rows")
