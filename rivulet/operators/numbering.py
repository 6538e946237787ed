"""Consecutive row numbers in a total order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.session import shared_folder


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df in sorted ranges, one a task, checkpointed: with _p, the number of a row's range, and _id, which ascends in the order."""
    shared_folder(df.sparkSession)
    ranged = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    return ranged.withColumn("_p", F.shiftright("_id", 33).cast("bigint"))


def with_offsets(ranged: DataFrame, counted: Column, name: str) -> tuple[DataFrame, int]:
    """ranged with `name`: the sum of `counted` (an aggregate) over the ranges before a row's, and the sum over all of them."""
    sums = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(counted.alias("n")).collect())  # one row a range
    starts, total = [], 0
    for p, n in sums:
        starts.append((p, total))
        total += n
    offsets = ranged.sparkSession.createDataFrame(starts, f"_p bigint, {name} bigint")
    return ranged.join(F.broadcast(offsets), "_p"), total


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with 0-based numbers in the order, and the number of rows."""
    rows, total = with_offsets(in_ranges(df, order), F.count(F.lit(1)), "_start")
    return rows.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_p", "_start", "_id"), total
