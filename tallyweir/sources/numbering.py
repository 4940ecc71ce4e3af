"""Ordinals over whole tables without a task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize

#: monotonically_increasing_id() holds the partition above this bit and the row within it below.
_ROW_BITS = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "no", parts: int | None = None) -> DataFrame:
    """df with name: a gapless long from 0 in the given order.

    Two levels: rows are dealt by range and sorted, a row's place within its partition is stored with it, and what stands in
    the partitions before is added. Only the counts, a row per partition, meet in one task and are broadcast. Rows that tie in order
    stay in one partition and are numbered in no fixed order: end the order with a column that tells them apart where many may tie.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__tw_at", F.monotonically_increasing_id())
    placed = materialize(at, "numbered")
    part = F.shiftright("__tw_at", _ROW_BITS)
    counts = placed.groupBy(part.alias("__tw_part")).agg(F.count("*").alias("__tw_n"))
    before = Window.orderBy("__tw_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__tw_part", F.coalesce(F.sum("__tw_n").over(before), F.lit(0)).alias("__tw_base"))
    row = F.col("__tw_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(base), part == F.col("__tw_part")).withColumn(name, F.col("__tw_base") + row).select(*[F.col(f"`{c}`") for c in df.columns], name)
