"""Byte-balanced contiguous shards by global prefix sums.

Rows are range-partitioned by id; each partition's total and row count give, by a prefix sum over partitions, where every
partition begins. A running sum inside the partition then places each row at its global byte offset, and the byte line is
cut at equal targets. Texts never move: only id, size and checksum are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard`` and the gapless ``slot`` within the shard.

    A row's size is its text's UTF-8 bytes (null: none) plus ``overhead``; the checksum of a null text is that of no bytes.
    A row goes to the shard that holds the middle of its byte range, so shards are contiguous in id order and differ from
    the target by less than one row. A null id sorts first; repeated rows each get a slot of their own; ties of the id are
    broken by checksum and size. An empty table gives no rows; other columns are ignored.
    """
    order = [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    raw = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = checkpointed(rows.repartitionByRange(partitions(docs), *order).withColumn("part", F.spark_partition_id()))
    every = Window.orderBy("part")
    parts = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("bytes_all"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    ranked = (
        placed.join(starts, "part")
        .withColumn("upto", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rank", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * upto - size) * {shards}) div (2 * bytes_all)) as int)"))
    )
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # at most `shards` rows
    return ranked.join(F.broadcast(first), "shard").select(
        F.col(id_col), "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot")
    )
