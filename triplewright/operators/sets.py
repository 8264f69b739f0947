"""Set operators and grouping on DataFrames. Everything has set semantics."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings
from .joins import hot_values, skew_join


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that are not in ``right``.

    Both sides are partitioned by the whole row, so no single key can be hot, and the distinct and
    the anti join share one shuffle of ``left``.
    """
    return left.distinct().join(right, on=left.columns, how="left_anti")


def unseen(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct candidates that are not known, by one aggregation over both.

    The same rows as ``difference``, for two large inputs: both are shuffled by the whole row once and
    nothing is sorted, and an aggregation that outgrows its memory spills.
    """
    keys = candidates.columns
    flagged = candidates.withColumn("_new", F.lit(True)).unionByName(known.select(*keys).withColumn("_new", F.lit(False)))
    return flagged.groupBy(*keys).agg(F.min("_new").alias("_new")).where("_new").drop("_new")


def group_values(df: DataFrame, key: str, value: str, per_chunk: int = 1000,
                 settings: Settings = Settings()) -> DataFrame:
    """Key -> list of distinct values, as rows (key, chunk, n, vals) of about ``per_chunk`` values.

    A key with few values has the single chunk 0, which is its whole sorted list. A key with many is
    spread over as many chunks as its exact count asks for, so no task ever holds a whole hot group.
    """
    pairs = df.select(key, value).distinct()
    sizes = pairs.groupBy(key).agg(F.ceil(F.count("*") / per_chunk).alias("_chunks"))
    hot = hot_values(pairs, key, settings)
    spread = F.conv(F.substring(F.md5(F.col(value)), 1, 8), 16, 10).cast("bigint")
    return (
        skew_join(pairs, sizes, [key], key, hot_left=hot, salts=settings.salts)
        .withColumn("chunk", spread % F.col("_chunks"))
        .groupBy(key, "chunk")
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_set(value)).alias("vals"))
    )
