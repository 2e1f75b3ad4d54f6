"""Prefix computations over ordered rows without one task for each file.

Rows carry a segment number that rises with their order (a file's split, a range of ids). Each computation runs inside
segments, then over one row for each segment, and combines the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], segment: str):
    return Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)


def number(df: DataFrame, keys: list[str], segment: str, order: list, out: str, first: int = 1) -> DataFrame:
    """Adds a gapless number within keys."""
    sizes = df.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(_before(keys, segment)), F.lit(0)),
    ).drop("_n")
    local = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, segment).orderBy(*order)))
    return local.join(sizes, [*keys, segment]).withColumn(out, F.col("_k") + F.col("_before") + (first - 1)).drop("_k", "_before")


def carry(df: DataFrame, keys: list[str], segment: str, order: list, value: Column, out: str) -> DataFrame:
    """Adds the latest non-null value at or before each row; value must rise along the order, as line numbers do."""
    return running_max(df, keys, segment, order, value, out)


def running_max(df: DataFrame, keys: list[str], segment: str, order: list, value: Column, out: str) -> DataFrame:
    """Adds the largest value at or before each row; nulls count for nothing."""
    valued = df.withColumn("_v", value)
    carried = valued.groupBy(*keys, segment).agg(F.max("_v").alias("_m")).withColumn("_c", F.max("_m").over(_before(keys, segment))).drop("_m")
    local = valued.withColumn("_l", F.max("_v").over(Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(carried, [*keys, segment]).withColumn(out, F.greatest("_l", "_c")).drop("_v", "_l", "_c")


def running_sum(df: DataFrame, keys: list[str], segment: str, order: list, value: Column, out: str) -> DataFrame:
    """Adds the sum of value up to and with each row."""
    valued = df.withColumn("_v", value)
    before = valued.groupBy(*keys, segment).agg(F.sum("_v").alias("_m")).withColumn("_c", F.coalesce(F.sum("_m").over(_before(keys, segment)), F.lit(0))).drop("_m")
    local = valued.withColumn("_l", F.sum("_v").over(Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(before, [*keys, segment]).withColumn(out, F.col("_l") + F.col("_c")).drop("_v", "_l", "_c")
