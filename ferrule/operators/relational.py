"""Relational idioms the library rests on: as-of and range joins, running quantities, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of the same group at or before it: one sort of the union, no pairs.

    The values come from one right row, nulls included; of right rows at the
    same place the one with the largest values counts. Rows of left that no right
    row precedes get nulls.
    """
    found = right.select(by, at, F.struct(*values).alias("_values"), F.lit(0).alias("_side"))
    rows = left.withColumn("_side", F.lit(1)).unionByName(found, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(at, "_side", "_values").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last("_values", ignorenulls=True).over(w)).where("_side = 1")
    return rows.select(*left.columns, *[F.col(f"_last.{v}").alias(f"asof_{v}") for v in values])


def range_join(df: DataFrame, edges: list[float], column: str) -> DataFrame:
    """df with ``band``: how many of the sorted edges are at or below the value."""
    from .evaluation import bin_of

    padded = [float("-inf"), *sorted(edges), float("inf")]
    return df.withColumn("band", bin_of(F.col(column), padded))


def tie_average_rank(value: str, by: list[str] | None = None) -> Column:
    w = W.partitionBy(*(by or [])).orderBy(value)
    same = W.partitionBy(*(by or []), value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0


def running_share(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """value's running sum as a share of its group's total."""
    w = W.partitionBy(by).orderBy(order)
    return df.withColumn("share", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum(value).over(W.partitionBy(by)))


def regression(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """(by..., slope, through_origin)."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), (F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("through_origin"))
