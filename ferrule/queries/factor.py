"""Queries over factors of the vectors' table: singular values, left factors, nested prefixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import factor as T
from ..operators.dense import knn
from .base import Book, n, r, rs, vector_queries, vectors

book = Book()
#: Prefixes and their weights in the joint objective.
SIZES, WEIGHTS = [8, 16, 32], [1.0, 0.5, 0.25]


@book.query()
def singular_spectrum(spark, d):
    """Singular values of the centred table, the share of its energy so far, and what is lost beyond each."""
    _, values, _ = T.singular_axes(vectors(spark, d))
    energy = values**2
    up = np.cumsum(energy)
    rows = [(i + 1, round(float(s), 6), round(float(u / up[-1]), 6), round(float(max(0.0, up[-1] - u)), 6)) for i, (s, u) in enumerate(zip(values, up, strict=True))]
    return spark.createDataFrame(rows, "component long, singular_value double, explained double, lost double")


@book.query()
def left_factors(spark, d):
    """Coordinates of every vector on the first four left singular axes."""
    mean, values, axes = T.singular_axes(vectors(spark, d))
    u = T.left_factors(vectors(spark, d).select("doc_id", "vec"), mean, values[:4], axes[:4])
    return u.select("doc_id", *[r(F.col("vec")[i]).alias(f"u{i + 1}") for i in range(4)])


@book.query()
def projection_distortion(spark, d):
    """How squared distances to the ten nearest shrink on the first k singular axes: mean, least and greatest ratio."""
    c, q = vectors(spark, d).select("doc_id", "vec"), vector_queries(spark, d).select("qid", "vec")
    mean, _, axes = T.singular_axes(c)
    near = knn(q, c, 10, "euclidean").select("qid", "doc_id", (-F.col("score")).alias("whole")).where("whole > 1e-12")
    out = None
    for k in (4, 16, 32):
        p = T.project(c, axes[:k], mean)
        pairs = near.join(p, "doc_id").join(p.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qv")), "qid")
        ratio = F.aggregate(F.zip_with("vec", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / F.col("whole")
        row = pairs.select(ratio.alias("x")).agg(F.lit(k).cast("bigint").alias("k"), r(F.avg("x")).alias("mean"), r(F.min("x")).alias("least"), r(F.max("x")).alias("greatest"))
        out = row if out is None else out.unionByName(row)
    return out


_ENERGY = "e AS (SELECT pos, sum(x * x) - sum(x) * sum(x) / count(*) AS e FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1)"
_LOSSES = f"WITH {_ENERGY}, s AS (SELECT unnest({SIZES})::BIGINT AS size, unnest({WEIGHTS}) AS weight), l AS (SELECT size, weight, sum(CASE WHEN pos >= size THEN e ELSE 0 END) AS loss FROM s, e GROUP BY ALL) "


@book.query(_LOSSES + f"SELECT size, {rs('loss')} AS loss, {rs('weight * loss')} AS weighted FROM l")
def prefix_losses(spark, d):
    """What prefixes of the vectors lose, all in one pass, and their parts of the joint objective."""
    weight = F.create_map(*[F.lit(x) for m, w in zip(SIZES, WEIGHTS, strict=True) for x in (m, w)])
    out = T.prefix_losses(vectors(spark, d), SIZES)
    return out.select(n("size").alias("size"), r("loss").alias("loss"), r(weight[F.col("size")] * F.col("loss")).alias("weighted"))


@book.query()
def nested_rotation(spark, d):
    """The joint objective as the table is, after one and two rounds of Jacobi turns, and on the best axes."""
    v = vectors(spark, d)
    turned = T.nested_rotation(v, SIZES, WEIGHTS, steps=2)[2]
    best = T.nested_rotation(v, SIZES, WEIGHTS)[2][-1]
    return spark.createDataFrame([(name, round(float(x), 6)) for name, x in zip(("as given", "turned once", "turned twice", "best axes"), [*turned, best], strict=True)], "axes string, loss double")
