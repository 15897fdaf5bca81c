"""Whole ordered sequences without one task: numbers, running sums and neighbours over range partitions.

A sequence is sorted by ranges and stored. What has to pass from one range to the next (sums, counts, last
values) is a row a range, worked out on a table as small as the number of partitions and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

PART, PLACE = "_part", "_place"
#: Spark's increasing ids hold the number of the partition above so many bits.
_BITS = 33


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df in its order, stored, with the columns _part and _place; rows of equal order should be few (aggregate them first)."""
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    return stored(placed.select("*", F.shiftright("_at", _BITS).alias(PART), F.col("_at").bitwiseAND((1 << _BITS) - 1).alias(PLACE)).drop("_at"))


def _ends(df: DataFrame, *columns: Column) -> DataFrame:
    """A row for each range that has rows, in a window over a table of that size."""
    return df.groupBy(PART).agg(*columns)


def running(df: DataFrame, **sums: Column) -> DataFrame:
    """The sums of given columns from the first row up to and with each row; df from in_ranges."""
    with_values = df.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)).cast("long") for k, v in sums.items()})
    totals = _ends(with_values, *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PART, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    out = with_values.join(F.broadcast(offsets), PART)  # a row a partition
    out = out.withColumns({k: F.sum(f"_v_{k}").over(inside) + F.col(f"_o_{k}") for k in sums})
    return out.drop(*(f"_{p}_{k}" for p in "vo" for k in sums))


def previous(df: DataFrame, column: str, name: str) -> DataFrame:
    """The value of a column in the row before, across ranges; null in the first row. df from in_ranges."""
    lasts = _ends(df, F.max_by(column, PLACE).alias("_last"))
    carried = lasts.select(PART, F.lag("_last").over(Window.orderBy(PART)).alias("_carried"))
    inside = Window.partitionBy(PART).orderBy(PLACE)
    out = df.join(F.broadcast(carried), PART)  # a row a partition
    return out.withColumn(name, F.when(F.col(PLACE) == 0, F.col("_carried")).otherwise(F.lag(column).over(inside))).drop("_carried")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a gapless number from 1 in a total order."""
    return running(in_ranges(df, *order), **{name: F.lit(1)}).drop(PART, PLACE)


def median(counted: DataFrame, value: str, count: str) -> float | None:
    """The exact median of values given with their counts, each value once; None where there are none."""
    at = running(in_ranges(counted.select(F.col(value).alias("_x"), F.col(count).alias("_n")), F.col("_x")), _upto=F.col("_n"))
    total = at.agg(F.max("_upto")).first()[0]
    if not total:
        return None
    held = [(F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k) for k in ((total + 1) // 2, (total + 2) // 2)]
    low, high = at.where(held[0] | held[1]).agg(F.min("_x"), F.max("_x")).first()
    return (low + high) / 2
