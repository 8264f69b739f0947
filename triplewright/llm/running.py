"""Running totals over a whole sorted table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

_PART = 33  # monotonically_increasing_id() holds the partition above this bit


def running_total(df: DataFrame, ws: Workspace, order: list[Column], value: str) -> DataFrame:
    """Adds ``position`` (from 0) and ``ahead`` (the sum of ``value`` over all earlier rows) in this order.

    Rows are sorted by range, each partition is totalled, and the totals of whole partitions, one row each,
    are added up in order. ``order`` must tell any two rows apart that differ.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ws.save(placed.withColumn("_at", F.monotonically_increasing_id()), ws.unique("sorted"))
    placed = placed.withColumn("_part", F.shiftright("_at", _PART))
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
                          F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_sum"))
    inside = Window.partitionBy("_part").orderBy("_at")
    return (
        placed.withColumn("_local", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside) - 1)
        .join(bases, "_part")
        .select(*df.columns, (F.col("_rows") + F.col("_row")).cast("long").alias("position"),
                (F.col("_sum") + F.col("_local") - F.col(value)).cast("long").alias("ahead"))
    )
