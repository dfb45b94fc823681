"""Plan fragments shared by the operators: ranks, top k, running sums and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_score(by: str | list[str] = "qid", score: str = "score", tie: str = "doc_id", digits: int = 9):
    """Best score first, ties (to ``digits`` places, so summing order never decides) by ascending id."""
    return W.partitionBy(by).orderBy(F.desc(F.round(score, digits)), tie)


def rank_of(by: str | list[str] = "qid", score: str = "score", tie: str = "doc_id") -> Column:
    return F.row_number().over(by_score(by, score, tie)).cast("bigint")


def top_k(scores: DataFrame, k: int, by: str | list[str] = "qid", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each group with their rank; Spark limits groups before the shuffle."""
    return scores.withColumn("rank", rank_of(by, score, tie)).where(F.col("rank") <= k)


def softmax(score: Column, by: str | list[str], tau: float = 1.0) -> Column:
    """exp((s - max) / tau) over its sum in the group."""
    w = W.partitionBy(by)
    e = F.exp((score - F.max(score).over(w)) / tau)
    return e / F.sum(e).over(w)


def log_sum_exp(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by..., lse), shifted by the maximum."""
    top = df.groupBy(*by).agg(F.max(score).alias("_m"))
    return df.join(top, by).groupBy(*by, "_m").agg((F.first("_m") + F.log(F.sum(F.exp(F.col(score) - F.col("_m"))))).alias("lse")).drop("_m")


def salted_sum(df: DataFrame, by: list[str], value: str, salts: int = 16) -> DataFrame:
    """Sum in two steps, for groups so large that one task's share of a key would be too much."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    return salted.groupBy(*by, "_salt").agg(F.sum(value).alias(value)).groupBy(*by).agg(F.sum(value).alias(value))


def numbered(df: DataFrame, by: str, order: str, name: str, buckets: int = 64) -> DataFrame:
    """df with its rows numbered from 0 in each group by ``order`` (a number), without one task for a group.

    Rows are numbered inside ranges of ``order`` cut at approximate quantiles, and
    a range goes on where those before it end.
    """
    bounds = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    inner = sorted(set(bounds))
    at = F.size(F.filter(F.array(*[F.lit(x) for x in inner]), lambda x: x <= F.col(order))) if inner else F.lit(0)
    placed = df.withColumn("_range", at)
    before = W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(by, "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(by, "_range").orderBy(order)) - 1
    return placed.withColumn(name, inside).join(starts, [by, "_range"]).withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")


def running_sums(df: DataFrame, order: str, values: dict[str, str], ties: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """df with running sums {new column: summed column} in ascending ``order`` (then ``ties``), without one task for all rows.

    Rows are dealt to ranges of ``order`` at approximate quantiles; sums run
    inside a range, and each range adds the total of those before it, of which
    there are at most ``buckets``. Rows of equal order share a range, so a value
    that most rows have still makes a large range: aggregate equal values first.
    """
    bounds = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    inner = sorted(set(bounds))
    at = F.lit(0) if not inner else F.size(F.filter(F.array(*[F.lit(b) for b in inner]), lambda b: b <= F.col(order)))
    placed = df.withColumn("_range", at)
    totals = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in values.items()])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in values])
    inside = W.partitionBy("_range").orderBy(order, *(ties or [])).rowsBetween(W.unboundedPreceding, 0)
    summed = placed.join(F.broadcast(starts), "_range")
    for n, c in values.items():
        summed = summed.withColumn(n, F.sum(c).over(inside) + F.col(f"_{n}"))
    return summed.drop("_range", *[f"_{n}" for n in values])
