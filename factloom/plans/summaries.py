"""Queries over the folding of plan steps into summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summarise as S
from . import relations as R
from .registry import query

_STEPS_SQL = f"""WITH {R.PLAN_SQL}, steps AS (SELECT *, 'plan_' || lpad(CAST(id AS VARCHAR), 9, '0') AS node, status = 'intended' AND role = 'behaviour' AND id % 9 <> 0 AND id % 7 <> 0 AS free, role = 'behaviour' AS counts, CASE WHEN id % 8 = 1 THEN 2 ELSE 1 END AS covers FROM plan),
  per AS (SELECT feature, count(*) FILTER (WHERE free) AS n, count(*) FILTER (WHERE counts AND NOT free) AS settled FROM steps GROUP BY feature),
  over AS (SELECT * FROM per WHERE n > greatest(1, 20 - settled) OR n + settled > 20) """


def _plan(spark, sf):
    """Plan steps of which some were drafted by a model, some by hand, some revised, and some are summaries of two already."""
    key = F.col("id")
    node = lambda k: F.concat(F.lit("plan_"), F.lpad(k.cast("string"), 9, "0"))
    p = R.plan(spark, sf)
    title = F.col("title")
    covered = F.when(key % 8 == 1, F.array(*[F.struct(F.array(F.concat(node(key), F.lit(x))).alias("identities"), F.concat(title, F.lit(x)).alias("title")) for x in ("", "b")]))
    steps = p.select(
        node(key).alias("id"), "feature", "role", "title", "status", F.when(key % 9 != 0, "ai_drafted").otherwise("human").alias("origin"), (key % 7 == 0).cast("int").alias("n_history"), "step", "path", "lens_tags",
        F.when(key % 8 == 1, F.array(node(key), F.concat(node(key), F.lit("b")))).otherwise(F.array(node(key))).alias("identities"), covered.alias("summary_of"), F.when(key % 8 == 1, 2).alias("n_covers"),
    )
    calls = p.where("parent is not null").select(node(key).alias("identity"), node(F.col("parent")).alias("caller"))
    rules = p.select(node(key).alias("id"), F.lit(0).alias("place"), F.concat(F.lit("rule "), (key % 5).cast("string")).alias("rule"))
    return steps, calls, rules


@query(_STEPS_SQL + "SELECT feature, n AS foldable, settled FROM per")
def foldable_steps(spark, sf):
    steps, _, _ = _plan(spark, sf)
    counted = steps.where(S.is_behaviour()).groupBy("feature").agg(F.count_if(S.is_eligible()).alias("foldable"), F.count_if(~S.is_eligible()).alias("settled"))
    return steps.select("feature").distinct().join(counted, "feature", "left").fillna(0)


@query(_STEPS_SQL + "SELECT node AS id, feature, true AS small FROM steps JOIN over USING (feature) WHERE free")
def summarise_features(spark, sf):
    """Every foldable step of a crowded feature is in just one group, and no group of several covers more than MOST steps."""
    steps, calls, _ = _plan(spark, sf)
    folded = S.fold_features(steps, calls).join(steps.select("id", "n_covers"), "id")
    size = folded.groupBy("feature", "grp").agg(F.sum(F.coalesce("n_covers", F.lit(1))).alias("covers"), F.count("*").alias("n"))
    return folded.join(size, ["feature", "grp"]).select("id", "feature", ((F.col("n") == 1) | (F.col("covers") <= S.MOST)).alias("small"))


@query(_STEPS_SQL + "SELECT feature, CAST(n + settled AS INTEGER) AS before, CAST(settled AS INTEGER) AS settled, true AS consistent FROM over")
def fold_report(spark, sf):
    """What folding reports of each crowded feature: it ends within its budget unless the limit of a summary stops it."""
    steps, calls, _ = _plan(spark, sf)
    report = S.fold_report(S.fold_features(steps, calls))
    within = F.col("limited") | (F.col("after") <= F.greatest(F.lit(S.CAP), F.col("settled") + 1))
    return report.select("feature", "before", "settled", (within & (F.col("overflow") == F.greatest(F.col("after") - S.CAP, F.lit(0)))).alias("consistent"))


@query(_STEPS_SQL + "SELECT feature, CAST(sum(covers) AS BIGINT) AS n FROM steps GROUP BY feature")
def covered_sizes(spark, sf):
    return S.covered_size(_plan(spark, sf)[0])


@query()
def summary_steps(spark, sf):
    """The summary steps themselves; folding is greedy, so tests hold them against hand-made features."""
    steps, calls, rules = _plan(spark, sf)
    return S.build_summaries(S.fold_features(steps, calls), steps, rules, first_number=1)
