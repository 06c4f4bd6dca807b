"""Edits of a plan by hand, revision with history, and the preparation of drafts; every edit is a new frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import numbered_id, with_rank
from .planning import next_number, reorder
from .validation import ORIGINS

#: Words that ask for a step's place at the end.
LAST = 1 << 30


def _next_id(nodes: DataFrame) -> int:
    return next_number(nodes.where(F.col("id").rlike("^plan_[0-9]+$")).select("id"), "id").first()[0]


def _cleaned(text: str, what: str) -> str:
    if not (text or "").strip():
        raise ValueError(f"{what} needs a text")
    return text.strip()


def add_step(nodes: DataFrame, feature: str, title: str, intent: str = "", after: str | None = None) -> DataFrame:
    """``nodes`` with a new step by hand behind ``after`` (an id, else at the end), and the feature's steps numbered 1..N.

    ``nodes`` has id, feature, title, intent, status, origin, step; further columns of the new step are null.
    """
    title = _cleaned(title, "a step")
    row = {"id": f"plan_{_next_id(nodes):04d}", "feature": feature, "title": title, "intent": (intent or "").strip() or f"{title}.", "status": "intended", "origin": "human_authored"}
    fresh = nodes.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in nodes.schema.fields])
    mine = F.col("feature") == feature
    ordered = reorder(nodes.where(mine), nodes.where(mine).where(F.lit(False)).select("id", F.col("step").alias("place")))
    place = ordered.where(F.col("id") == after).select(F.col("step")).first() if after else None
    moved = nodes.sparkSession.createDataFrame([(row["id"], place[0] + 1 if place else LAST)], "id string, place int")
    return nodes.where(~F.coalesce(mine, F.lit(False))).unionByName(reorder(ordered.unionByName(fresh), moved).select(nodes.columns))


def rename_step(nodes: DataFrame, chosen: Column, title: str) -> DataFrame:
    """The chosen steps under another title; readings, which described the old one, go."""
    title = _cleaned(title, "a step")
    out = nodes.withColumn("title", F.when(chosen, F.lit(title)).otherwise(F.col("title")))
    return out.withColumn("readings", F.when(~F.coalesce(chosen, F.lit(False)), F.col("readings"))) if "readings" in nodes.columns else out


def rename_feature(features: DataFrame, feature: str, name: str) -> DataFrame:
    """The feature under another name, as added by hand; a name that another feature has is an error."""
    name = _cleaned(name, "a feature")
    if not features.where((F.col("id") != feature) & (F.col("name") == name)).isEmpty():
        raise ValueError(f"another feature is called {name}")
    mine = F.col("id") == feature
    return features.withColumns({"name": F.when(mine, F.lit(name)).otherwise(F.col("name")), "source": F.when(mine, F.lit("human_added")).otherwise(F.col("source"))})


def move_steps(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Steps with the positions of ``moves`` (id, x, y as doubles), rounded to whole numbers; a null x or y takes both away.

    A position that is no finite number is an error.
    """
    finite = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))
    if not moves.where(~(finite("x") & finite("y"))).isEmpty():
        raise ValueError("a position needs two numbers")
    both = F.col("to_x").isNotNull() & F.col("to_y").isNotNull()
    to = moves.select("id", F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.lit(True).alias("to_move"))
    out = nodes.join(to, "id", "left")
    rounded = lambda c: F.floor(F.col(f"to_{c}") + 0.5).cast("long")
    placed = {c: F.when(F.col("to_move"), F.when(both, rounded(c))).otherwise(F.col(c)) for c in ("x", "y")}
    return out.withColumns(placed).select(nodes.columns)


def revise_as_new(nodes: DataFrame, chosen: Column) -> DataFrame:
    """Approved steps among ``chosen`` under a new id, one version on: intended, without snapshot, with what they were in ``history``.

    ``nodes`` has id, seq, version, status, approved_by, approved_facts, supersedes, history and, for the history, identity,
    title, intent and origin. Ids follow seq from the plan's next number on.
    """
    now = F.coalesce(chosen & (F.col("status") == "approved"), F.lit(False))
    numbers = with_rank(nodes.where(now).select("id", "seq"), ["seq"]).select("id", numbered_id("plan_", F.col("rank") + _next_id(nodes)).alias("new_id"))
    version = F.coalesce("version", F.lit(1))
    was = F.struct("id", version.alias("version"), "identity", "title", "intent", "status", "origin")
    history = F.concat(F.coalesce("history", F.array().cast(nodes.schema["history"].dataType)), F.array(was).cast(nodes.schema["history"].dataType))
    out = nodes.join(numbers, "id", "left")
    new = F.col("new_id").isNotNull()
    none = lambda c: F.when(~new, F.col(c))
    changed = {
        "history": F.when(new, history).otherwise(F.col("history")), "supersedes": F.when(new, F.col("id")).otherwise(F.col("supersedes")), "version": F.when(new, version + 1).otherwise(F.col("version")),
        "approved_by": none("approved_by"), "approved_facts": none("approved_facts"), "status": F.when(new, "intended").otherwise(F.col("status")), "id": F.coalesce("new_id", "id"),
    }
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in nodes.columns])


def preserved(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Nodes that a new draft of the ``batch`` (identity) leaves alone: those that hold none of it, and those settled or touched by hand.

    ``nodes`` has id, identities, status, origin, n_history.
    """
    held = nodes.select("id", F.explode("identities").alias("identity")).join(batch.select("identity").distinct(), "identity").select("id").distinct()
    settled = (F.col("status") == "approved") | (F.coalesce("n_history", F.lit(0)) > 0) | ~F.col("origin").eqNullSafe(ORIGINS[0])
    out = nodes.join(held.withColumn("_held", F.lit(True)), "id", "left")
    return out.where(F.col("_held").isNull() | F.coalesce(settled, F.lit(False))).select(nodes.columns)


def draft_batches(candidates: DataFrame, size: int = 20) -> DataFrame:
    """``candidates`` (identity, seq) with ``directory`` and ``batch``: sorted by directory, then as they come, in runs of ``size``."""
    path = F.substring_index("identity", "::", 1)
    directory = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))
    ranked = with_rank(candidates.withColumn("directory", directory), ["directory", "seq"])
    return ranked.withColumn("batch", F.floor(F.col("rank") / size).cast("int")).drop("rank")


def accept_draft(rows: DataFrame, candidates: DataFrame, most_bad: float = 0.25) -> DataFrame:
    """Drafted steps that may enter the plan; if more than ``most_bad`` of them may not, none does and it is an error.

    ``rows`` has identity, title, intent, seq; a row is good if its identity was asked for (in ``candidates``), it has title
    and intent, and no earlier row has its identity.
    """
    n = F.row_number().over(Window.partitionBy("identity").orderBy("seq"))
    asked = candidates.select("identity", F.lit(True).alias("_asked")).distinct()
    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    judged = rows.join(asked, "identity", "left").withColumn("_good", F.coalesce("_asked", F.lit(False)) & text("title") & text("intent") & (n == 1))
    bad, every = judged.agg(F.count_if(~F.col("_good")), F.count("*")).first()
    if bad > most_bad * every:
        raise ValueError(f"{bad} of {every} drafted steps cannot be used")
    return judged.where("_good").select(rows.columns)


def remap_draft(nodes: DataFrame, edges: DataFrame, first_number: int) -> tuple[DataFrame, DataFrame]:
    """Drafted nodes (temp_id, seq, ...) with final ids, and their edges (from, to) by these; an edge to an unknown temp_id is an error."""
    numbered = with_rank(nodes, ["seq"]).withColumn("id", numbered_id("plan_", F.col("rank") + first_number)).drop("rank")
    ids = numbered.select("temp_id", "id")
    if ids.count() != ids.select("temp_id").distinct().count():
        raise ValueError("a temporary id occurs twice")
    out = edges.join(ids.toDF("from", "a"), "from", "left").join(ids.toDF("to", "b"), "to", "left")
    if not out.where("a is null or b is null").isEmpty():
        raise ValueError("an edge leads to a temporary id that no node has")
    return numbered, out.select(F.col("a").alias("from"), F.col("b").alias("to"))
