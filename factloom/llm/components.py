"""Connected components: local contraction, then alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Edges that a task contracts at a time; memory per task is bounded by it, whatever the number of edges.
LOCAL = 400_000


#: A key with more rows than HEAVY, and than the HEAVY_KEYS-th part of all rows, is heavy; so there are HEAVY_KEYS of them at most.
HEAVY, HEAVY_KEYS = 1000, 10_000


def _bound(total: int) -> int:
    return max(HEAVY, total // HEAVY_KEYS)


def heavy_join(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """The inner join of ``rows`` with ``keyed``, which has one row a ``key`` and in ``c`` how many of ``rows`` have it.

    Rows of heavy keys stay where they are, as those keys (HEAVY_KEYS at most) are broadcast; so no task gathers a hot key.
    Both frames are read several times and should be checkpointed.
    """
    bound = _bound(keyed.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    heavy, light = F.broadcast(keyed.where(F.col("c") > bound).drop("c")), keyed.where(F.col("c") <= bound).drop("c")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def spread_join(rows: DataFrame, wide: DataFrame, key: str, wide_key: str, counted: DataFrame, deal_by: list[str]) -> DataFrame:
    """The inner join of ``rows`` with ``wide`` (one large row a ``wide_key``) on key = wide_key; rows of heavy keys are dealt to several tasks.

    ``counted`` (checkpointed) tells how many rows a key has. The large rows of heavy keys are repeated for the tasks, all in
    all at most 2 * HEAVY_KEYS times; the others are joined by the key alone, so large rows that lie by it do not move again.
    """
    bound = _bound(counted.count())
    heavy = counted.groupBy(F.col(key).alias("_heavy")).agg(F.count("*").alias("_c")).where(F.col("_c") > bound)
    heavy = checkpointed(heavy.select("_heavy", F.expr(f"cast(_c div {bound} as int)").alias("_last")))
    if heavy.isEmpty():
        return rows.join(wide, F.col(key) == F.col(wide_key))
    heavy = F.broadcast(heavy)
    light = rows.join(heavy, F.col(key) == F.col("_heavy"), "left_anti").join(wide, F.col(key) == F.col(wide_key))
    part = F.pmod(F.xxhash64(*deal_by), F.col("_last") + 1).cast("int")
    dealt = rows.join(heavy, F.col(key) == F.col("_heavy")).select(*rows.columns, part.alias("_part"))
    repeated = wide.join(heavy, F.col(wide_key) == F.col("_heavy")).select(*wide.columns, F.explode(F.sequence(F.lit(0), "_last")).alias("_for"))
    dealt = dealt.join(repeated, (F.col(key) == F.col(wide_key)) & (F.col("_part") == F.col("_for"))).drop("_part", "_for")
    return dealt.unionByName(light)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the roots with the least node that these edges connect it to."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    top, pairs = np.arange(len(nodes)), ends.reshape(2, -1)
    while True:
        a, b = top[pairs[0]], top[pairs[1]]
        if np.array_equal(a, b):
            break
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(top, top[top]):
            top = top[top]
    moved = top != np.arange(len(nodes))
    return nodes[moved], nodes[top[moved]]


def _contracted(batches):
    held, size = [], 0

    def out():
        u, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(u, v)], names=["u", "v"])

    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        size += batch.num_rows
        if size > LOCAL:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, root (the least node reachable) for every node that some edge (u, v) of longs with u <> v touches.

    Tasks first contract LOCAL edges each to a forest. While there is more than one such part, every step hangs a node's
    neighbours on the least of them, so only minima are aggregated and no neighbourhood is gathered; the number of steps
    grows with the logarithm of the size. Null ends and loops are dropped.
    """
    sides = [F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")]
    here, seen = checkpointed(edges.where("u <> v").select(*sides).distinct()), None
    n = here.count()
    here = checkpointed(here.coalesce(max(1, -(-n // LOCAL))).mapInArrow(_contracted, "u long, v long"))
    done = n <= LOCAL
    for _ in range(limit):
        if done:
            return here.select(F.col("u").alias("node"), F.col("v").alias("root")).union(here.select("v", "v").distinct())
        both = here.union(here.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        here = checkpointed(hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct())
        now = tuple(here.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        done, seen = now == seen, now
    raise RuntimeError(f"components did not settle in {limit} steps")
