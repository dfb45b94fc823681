"""Pairs of vectors from two modalities: (pair_id, x, y), x being the query's side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot
from .dense import centroid, knn, principal_axes, project


def _minus(a: str, b: str) -> Column:
    return F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda u, v: u - v)


def gap_vector(pairs: DataFrame) -> np.ndarray:
    """Mean of x - y: the distance and direction between the two modalities' centres."""
    return np.array(centroid(pairs.select(_minus("x", "y").alias("vec")), []).first()[0])


def alignment_parts(pairs: DataFrame) -> DataFrame:
    """(alignment, gap2, dispersion): mean squared difference as the squared gap plus the spread around it.

    Sums a coordinate: the mean of squares, and the square of the mean.
    """
    d = pairs.select(F.posexplode(_minus("x", "y")).alias("pos", "d"))
    each = d.groupBy("pos").agg(F.avg(F.col("d") * F.col("d")).alias("s"), F.avg("d").alias("m"))
    return each.agg(F.sum("s").alias("alignment"), F.sum(F.col("m") * F.col("m")).alias("gap2")).withColumn("dispersion", F.col("alignment") - F.col("gap2"))


def shifted(keys: DataFrame, gap: np.ndarray, alpha: float, vec: str = "vec") -> DataFrame:
    """Keys moved by alpha times the gap, lengths as they come."""
    g = F.array(*[F.lit(float(alpha * v)) for v in gap])
    return keys.withColumn(vec, F.zip_with(F.col(vec).cast("array<double>"), g, lambda u, v: u + v))


def pair_recall(pairs: DataFrame, alphas: list[float], k: int = 10, measure: str = "cosine") -> DataFrame:
    """(alpha, recall): share of pairs whose y is among the k best for x once the keys are moved; by dot product alpha changes nothing."""
    gap, out = gap_vector(pairs), None
    asked = pairs.select(F.col("pair_id").alias("qid"), F.col("x").alias("vec"))
    keys = pairs.select(F.col("pair_id").alias("doc_id"), F.col("y").alias("vec"))
    total = pairs.count()
    for alpha in alphas:
        found = knn(asked, shifted(keys, gap, alpha), k, measure, skip_self=False).where("qid = doc_id")
        row = found.agg((F.count("*") / total).alias("recall")).select(F.lit(float(alpha)).alias("alpha"), "recall")
        out = row if out is None else out.unionByName(row)
    return out


def pass_rates(pairs: DataFrame, alphas: list[float], theta: float) -> DataFrame:
    """(alpha, cosine, passed): mean cosine of true pairs and the share at or above theta once the keys are moved."""
    gap, out = gap_vector(pairs), None
    for alpha in alphas:
        row = shifted(pairs, gap, alpha, "y").select(cosine("x", "y").alias("c")).agg(F.avg("c").alias("cosine"), F.avg((F.col("c") >= theta).cast("double")).alias("passed"))
        row = row.select(F.lit(float(alpha)).alias("alpha"), "cosine", "passed")
        out = row if out is None else out.unionByName(row)
    return out


def mean_dot(pairs: DataFrame) -> DataFrame:
    """(dot): mean inner product of true pairs."""
    return pairs.agg(F.avg(dot("x", "y")).alias("dot"))


def cones(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, vec): both sides on the first two principal axes of all vectors."""
    both = pairs.select("pair_id", F.lit("x").alias("side"), F.col("x").alias("vec")).unionByName(pairs.select("pair_id", F.lit("y").alias("side"), F.col("y").alias("vec")))
    mean, _, axes = principal_axes(both)
    return project(both, axes[:2], mean)
