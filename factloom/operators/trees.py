"""Places of rows in the reading order of a forest, however deep, and however many children a row has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import with_rank, with_running_sum
from .graph import reliable
from .skew import hot_join


def _sizes(links: DataFrame) -> DataFrame:
    """id, size: the rows under each row and itself, of (id, up) rows whose chain of ``up`` ends at a row without one.

    In round k a row knows those less than 2^k steps under it and its ancestor 2^k steps above; what its ancestor gains is
    the row's own number. Rows above a missing row go when their pointer reaches it; when a round ends no chain any more, the
    rest lead into loops and go too.
    """
    state = reliable(links.select("id", F.col("up").alias("at"), F.lit(1).cast("long").alias("size")))
    left = state.where("at is not null").count()
    while left:
        climbing = state.where("at is not null")
        gained = climbing.groupBy(F.col("at").alias("id")).agg(F.sum("size").alias("more"))
        moved = hot_join(climbing, state.select(F.col("id").alias("at"), F.col("at").alias("next")), "at").select("id", F.col("next").alias("at"), "size")
        every = moved.unionByName(state.where("at is null")).join(gained, "id", "left")
        state = reliable(every.select("id", "at", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        now = state.where("at is not null").count()
        if now == left:
            break
        left = now
    return state.where("at is null").select("id", "size")


def preorder(rows: DataFrame, order: list[str]) -> DataFrame:
    """id, root, depth, size, place: where a row stands when each is read before its children, and siblings by ``order``, then id.

    ``rows`` has a distinct id, ``up`` (null: a root) and the columns of ``order``. ``place`` counts from 0 without gaps, ``size``
    is the row and all under it, so its children and theirs have the places up to ``place + size - 1``. Rows whose chain of ``up``
    leads into a loop or to an id that no row has are left out. Ids that are null or repeated are not allowed.

    A row's place is the sum, over it and the rows above it, of one and the sizes of the siblings before it. Sizes and sums
    come by doubling, so the rounds grow with the logarithm of the depth, and no task sees all children of a row.
    """
    links = rows.select("id", "up", *[c for c in order if c not in ("id", "up")])
    sized = links.join(_sizes(links), "id")
    summed = reliable(with_running_sum(sized, ["up", *order, "id"], F.col("size"), "_through").select("id", "up", "size", (F.col("_through") - F.col("size")).alias("_before")))
    firsts = summed.where("up is not null").groupBy("up").agg(F.min("_before").alias("_first"))
    below = hot_join(summed.where("up is not null"), firsts, "up").select("id", "up", "size", (F.col("_before") - F.col("_first") + 1).alias("place"))
    roots = summed.where("up is null").select("id", "up", "size", F.col("_before").alias("place"))
    found = below.unionByName(roots)
    state = reliable(found.select("id", F.col("up").alias("at"), "size", "place", F.col("id").alias("root"), F.col("up").isNotNull().cast("int").alias("depth")))
    while not state.where("at is not null").isEmpty():
        on = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("place").alias("_place"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        moved = hot_join(state.where("at is not null"), on, "at")
        moved = moved.select("id", F.col("_at").alias("at"), "size", (F.col("place") + F.col("_place")).alias("place"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = reliable(moved.unionByName(state.where("at is null")))
    return state.select("id", "root", "depth", "size", "place")


def numbered(lines: DataFrame, order: list[str], name: str) -> DataFrame:
    """``lines`` with their number ``name`` from 1 in ``order``."""
    return with_rank(lines, order).withColumn(name, F.col("rank") + 1).drop("rank")
