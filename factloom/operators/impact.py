"""What depends on many targets at once: breadth-first over (target, node) pairs, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import reliable
from .skew import hot_join, spread

#: Rows whose targets are broadcast at most.
FEW = 100_000


def first_callers(edges: DataFrame, most: int) -> DataFrame:
    """id, callers: of every node the first ``most`` distinct callers by id, kind and confidence; one row a node.

    A caller counts by its first edge. Of a node with many callers only that many reach its task, as ranks are cut before
    the shuffle; repeated edges go before that, so that a caller has a row for each of its kinds and confidences.
    """
    each = edges.where("`to` is not null and `from` is not null").select(F.col("to").alias("id"), F.col("from").alias("caller"), "kind", "confidence").distinct()
    n = F.dense_rank().over(Window.partitionBy("id").orderBy("caller"))
    kept = each.withColumn("_n", n).where(F.col("_n") <= most).groupBy("id", "caller").agg(F.min(F.struct("kind", "confidence")).alias("e"))
    return kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("caller", "e.kind", "e.confidence"))).alias("callers"))


def impact_of_all(edges: DataFrame, targets: DataFrame, max_depth: int = 3, max_results: int = 25) -> DataFrame:
    """target, id, depth, place, kind, confidence, truncated: what reaches each target, in the order of a walk in breadth.

    A node's callers come sorted by id, kind and confidence; each node counts once a target, by the edge that met it first,
    and ``place`` (from 1) is the order. A target's walk ends at ``max_results`` nodes (one at least); it is truncated if then a
    caller of the node in hand, or a node that was met and not walked yet, is left. ``edges`` has from, to, kind, confidence;
    edges without a target lead nowhere. ``targets`` has target; null, empty and repeated ones count as none or one.

    All targets advance together: a level is one join of their fronts with the nodes' first callers. As a target keeps
    ``max_results`` nodes, no more than twice as many callers of a node can matter to it, so a node that everything depends on
    costs no more than any other, and a target has a bounded number of rows at any time.
    """
    most = max(1, max_results)
    callers = reliable(first_callers(edges, 2 * most + 2))
    asked = targets.where("target is not null and target <> ''").select(F.col("target").cast("string").alias("target")).distinct()
    asked = reliable(asked.select("target", F.col("target").alias("id")))
    none = [F.lit(None).cast("string").alias(c) for c in ("kind", "confidence")]
    seen = asked.select("target", "id", F.lit(0).alias("depth"), F.lit(0).alias("place"), F.lit(-1).alias("parent"), *none)
    if max_depth > 0:
        # The first level is the target's own callers, which lie in order in one row.
        others = F.slice(F.filter("callers", lambda e: e["caller"] != F.col("target")), 1, most)
        met = hot_join(asked, callers, "id").select("target", F.posexplode(others).alias("n", "e"))
        front = reliable(met.select("target", F.col("e.caller").alias("id"), F.lit(1).alias("depth"), (F.col("n") + 1).alias("place"), F.lit(0).alias("parent"), "e.kind", "e.confidence"))
        seen = seen.unionByName(front)
    for depth in range(2, max_depth + 1):
        # A target with all its results walks no further; one whose front has no callers is done.
        front = front.join(front.where(F.col("place") == most).select("target"), "target", "left_anti")
        met = reliable(hot_join(front.select("target", "id", F.col("place").alias("parent")), callers, "id").select("target", "parent", F.explode("callers").alias("e")))
        n_met = met.count()
        if not n_met:
            break
        walking = met.select("target").distinct()
        known = seen.join(F.broadcast(walking) if n_met <= FEW else walking, "target", "left_semi")
        fresh = met.select("target", F.col("e.caller").alias("id"), "parent", "e.kind", "e.confidence").join(known.select("target", "id"), ["target", "id"], "left_anti")
        first = fresh.groupBy("target", "id").agg(F.min(F.struct("parent", "id", "kind", "confidence")).alias("f"))
        so_far = known.groupBy("target").agg(F.max("place").alias("so_far"))
        n = F.row_number().over(Window.partitionBy("target").orderBy("f"))
        placed = first.join(so_far, "target").withColumn("place", F.col("so_far") + n).where(F.col("place") <= most)
        front = reliable(placed.select("target", "id", F.lit(depth).alias("depth"), "place", "f.parent", "f.kind", "f.confidence"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    # Only a target with all its results can be truncated.
    last = seen.where(F.col("place") == most).select("target", F.col("depth").alias("last_depth"), F.col("parent").alias("at"))
    closed = reliable(seen.join(last, "target").select("target", "id", "depth", "place", "at"))
    waiting = closed.where((F.col("place") > F.col("at")) & (F.col("depth") < max_depth)).select("target")
    in_hand = closed.where("place = at").select("target", "id")
    left = hot_join(in_hand, callers, "id").select("target", F.explode("callers.caller").alias("id")).join(closed.select("target", "id"), ["target", "id"], "left_anti").select("target")
    cut = waiting.unionByName(left).distinct().withColumn("truncated", F.lit(True))
    out = seen.where("depth > 0").join(cut, "target", "left")
    return out.select("target", "id", "depth", "place", "kind", "confidence", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def impact_of_results(results: DataFrame, edges: DataFrame, max_depth: int = 3, max_results: int = 25) -> DataFrame:
    """``results`` (identity, status, ...) with ``impact``: an array of what depends on each one that is not implemented, in order.

    Implemented results have an empty array, as has an identity that nothing depends on; ``truncated`` tells of a cut one.
    """
    results = reliable(results)
    found = impact_of_all(edges, results.where("status <> 'implemented'").select(F.col("identity").alias("target")), max_depth, max_results)
    entry = F.struct("place", F.col("id").alias("identity"), "depth", "kind", "confidence")
    found = spread(found, "target", total=results.count())
    lists = found.groupBy(F.col("target").alias("identity")).agg(F.array_sort(F.collect_list(entry)).alias("_all"), F.bool_or("truncated").alias("_cut"))
    given = results.join(lists, "identity", "left")
    no_impact = (F.col("status") == "implemented") | F.col("_all").isNull()
    kept = F.transform("_all", lambda e: F.struct(*[e[c].alias(c) for c in ("identity", "depth", "kind", "confidence")]))
    shape = "array<struct<identity:string,depth:int,kind:string,confidence:string>>"
    return given.select(*[F.col(c) for c in results.columns], F.when(no_impact, F.array().cast(shape)).otherwise(kept).alias("impact"), (~no_impact & F.coalesce("_cut", F.lit(False))).alias("truncated"))
