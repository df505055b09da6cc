"""Prefix sums over an order without a task that holds a whole group.

Groups that fit in a task are one window.  Beyond that rows go to range partitions by (group, order), whose borders Spark measures on a sample, so that
partitions are alike in size whatever the values are.  Sums run within each partition's part of a group, and again over the parts'
totals, of which there are as many as partitions and groups together.  Rows are distinct values of their group, so equal values never make a part large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import counted, stored

#: Rows of a group that a task sorts.
SINGLE = 1_000_000


def _joined(df: DataFrame, few: DataFrame, key: list[str]) -> DataFrame:
    """df with few's further columns; nulls in the key are equal."""
    told = few.select(*[F.col(k).alias(f"_of_{k}") for k in key], *[c for c in few.columns if c not in key])
    return df.join(told, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key])).drop(*[f"_of_{k}" for k in key])


def ranged(df: DataFrame, by: list[str], order: str, parts: int) -> DataFrame:
    """df with _part: so many range partitions by (by, order) of about equal size, numbered in their order."""
    return stored(df.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: str, sums: list[str], last: list[str] = (), largest: int | None = None) -> DataFrame:
    """df (distinct, non-null ``order`` in each group) with {c}_before, the sum of c over the group's rows before, {c}_all, over all of them, and last_{c} of
    the row just before (null at the first).  largest: a bound of a group's rows, where it is known; else df is written once and counted."""
    if largest is None:
        df, largest = counted(df)
    if largest <= SINGLE:
        return _windows(df, by, order, sums, last).drop("_nth")
    rows = ranged(df, by, order, -(-2 * largest // SINGLE))
    key = [*by, "_part"]
    totals = rows.groupBy(*key).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums], *([F.max_by(F.struct(*last), order).alias("_end")] if last else []), F.count("*").alias("_rows"))
    outer = Window.partitionBy(*by)
    before = outer.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_base_{c}") for c in sums], *[F.sum(f"_sum_{c}").over(outer).alias(f"_total_{c}") for c in sums], *([F.lag("_end").over(outer.orderBy("_part")).alias("_end")] if last else []))
    out = _joined(_windows(rows, key, order, sums, last), totals, key)
    first = F.col("_nth") == 1
    return out.select(*df.columns, *[(F.col(f"_base_{c}") + F.col(f"{c}_before")).alias(f"{c}_before") for c in sums], *[F.col(f"_total_{c}").alias(f"{c}_all") for c in sums], *[F.when(first, F.col(f"_end.{c}")).otherwise(F.col(f"last_{c}")).alias(f"last_{c}") for c in last])


def _windows(df: DataFrame, by: list[str], order: str, sums: list[str], last: list[str]) -> DataFrame:
    """running within groups of one task, and _nth, a row's number in its group."""
    inner, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in sums], *[F.sum(c).over(whole).alias(f"{c}_all") for c in sums], *[F.lag(c).over(inner).alias(f"last_{c}") for c in last], F.row_number().over(inner).alias("_nth"))
