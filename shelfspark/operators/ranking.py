"""First-n-per-group without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups larger than a task should hold are cut into this many slices first.
SLICES = 64


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of every key.

    ``row_number() = 1`` is trimmed by Spark before the shuffle, so a hot key
    sends one row per task instead of all of its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, keys: list[str], n: int | Column, order: list, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key with their rank, for any ``n``, also a column of ``df``.

    Every slice of a group gives up its own first ``n``; only those meet in the
    final window.  Nothing is lost: a row outside its slice's first ``n`` cannot
    be among the group's first ``n``.
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(SLICES))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_slice", spread)
        .withColumn(rank, F.row_number().over(inner)).where(F.col(rank) <= n)
        .withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)
        .drop("_slice")
    )


def with_place(df: DataFrame, keys: list[str], number: str, width: int, place: str, total: str) -> DataFrame:
    """Adds the place (from 0) of every row in its group and the group's size.

    ``number`` is a unique whole number that orders the group.  Rows are placed
    inside slices of ``width`` numbers, and slices by a running total of their
    counts, so no window holds more than a slice's rows or a group's slices.
    The rows are sorted for their window already, so the merge they are asked to
    join by moves nothing; a broadcast would send them through the driver.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(number) / width))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    starts = counts.select(
        *keys, "_slice", F.sum("_n").over(group).alias(total),
        (F.sum("_n").over(group.orderBy("_slice")) - F.col("_n")).alias("_start"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(number)) - 1
    return (
        sliced.withColumn("_inside", inside).hint("merge").join(starts, [*keys, "_slice"])
        .withColumn(place, F.col("_start") + F.col("_inside")).drop("_slice", "_start", "_inside")
    )


def with_start(df: DataFrame, keys: list[str], number: str, width: int, amount: str, start: str) -> DataFrame:
    """Adds the sum of ``amount`` over the group's rows of smaller ``number``.

    ``number`` is a unique whole number in the group. Sums run inside slices of ``width`` numbers
    and over the totals of slices, so no window holds more than either.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(number) / width))
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_total"))
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_slice", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).hint("merge").join(totals, [*keys, "_slice"])
        .withColumn(start, F.col("_ahead") + F.col("_inside")).drop("_slice", "_inside", "_ahead")
    )
