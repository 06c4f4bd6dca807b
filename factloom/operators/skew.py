"""Joins whose large side may have hot keys, and rows of a few blocks that many tasks have to share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than HOT, and than the HOT_KEYS-th part of all rows, is hot; so there are HOT_KEYS of them at most.
HOT, HOT_KEYS = 1000, 10_000
#: Rows that a task gets at most, on average, where rows are dealt out by their number.
TASK_ROWS = 250_000


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with ``keyed``, which has one row a ``key``; rows of hot keys stay where they are.

    The keyed rows of hot keys (HOT_KEYS at most) are broadcast, so no task gathers the rows of a hot key. Keys are counted
    first, so ``rows`` is read twice, unless ``counted`` has their keys from a cheaper plan; then the others are also spread by their number.
    """
    counts = (rows if counted is None else counted).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"))
    total, most = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.max("_c"), F.lit(0))).first()
    bar = max(HOT, total // HOT_KEYS)
    dealt = (lambda part: part) if counted is None else lambda part: spread(part, key, total=total)
    if most <= bar:
        return dealt(rows).join(keyed, key, how)
    hot = F.broadcast(counts.where(F.col("_c") > bar).select(key))
    others = dealt(rows.join(hot, key, "left_anti")).join(keyed, key, how)
    return rows.join(hot, key, "left_semi").join(F.broadcast(keyed.join(hot, key, "left_semi")), key, how).unionByName(others)


def spread(rows: DataFrame, *keys: str, total: int = 0) -> DataFrame:
    """``rows`` by hashes of ``keys`` in several tasks a core, and in a task for every TASK_ROWS rows, if ``total`` tells how many there are.

    A compressed table of short rows is read by a few tasks, as Spark splits files by their bytes; where every row is the start of
    much work, that work would be theirs alone. It is narrow rows that should move: before anything is made of them. What a task
    sorts or hashes is bounded only if the number of tasks grows with the rows.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-total // TASK_ROWS)), *keys)
