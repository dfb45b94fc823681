"""Queries over fitted models: density ratios for shifted calibration, listwise Newton fits, contrastive encoders."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import fits as P
from ..operators import generation as G
from ..plans.durable import written
from .base import CLAIMS_SQL, Book, claims, r, rs, vectors
from .learning import _rows

book = Book()
ALPHA, TAU = 0.2, 0.1
#: How strongly deployment leans to low ranks: the ratio of the densities is exp(beta (rank - 1) / 9).
BETAS = [0.0, 0.5, 1.0, 2.0]


def _scored(spark, d):
    """Right claims by their score; a query's claims all calibrate or are all deployed."""
    rows = claims(spark, d).where("y = 1").select("qid", "doc_id", (1 - F.col("p")).alias("s"), ((F.col("rank") - 1) / 9).alias("v"))
    return rows.where("(qid div 20) % 2 = 0"), rows.where("(qid div 20) % 2 = 1")


@book.query(f"""WITH {CLAIMS_SQL}, f AS (SELECT qid, 1 - p AS s, (rank - 1) / 9 AS v, (qid // 20) % 2 AS held FROM claims WHERE y = 1), b AS (SELECT unnest({BETAS}) AS beta),
w AS (SELECT beta, s, held, exp(beta * v) AS w FROM f, b),
c AS (SELECT beta, s, sum(sum(w)) OVER (PARTITION BY beta ORDER BY s) AS up, sum(sum(1)) OVER (PARTITION BY beta ORDER BY s) AS low FROM w WHERE held = 0 GROUP BY beta, s),
t AS (SELECT beta, sum(w) FILTER (WHERE held = 0) AS t, count(*) FILTER (WHERE held = 0) AS k, avg(w) FILTER (WHERE held = 1) AS own FROM w GROUP BY 1),
q AS (SELECT beta, min(s) FILTER (WHERE low >= ceil({1 - ALPHA} * (k + 1))) AS plain, min(s) FILTER (WHERE up >= {1 - ALPHA} * (t + own) - 1e-12) AS weighted FROM c JOIN t USING (beta) GROUP BY 1)
SELECT beta, {rs('coalesce(sum(w) FILTER (WHERE plain IS NULL OR s <= plain) / sum(w), 0)')} AS plain_coverage, {rs('coalesce(sum(w) FILTER (WHERE weighted IS NULL OR s <= weighted) / sum(w), 0)')} AS weighted_coverage FROM w JOIN q USING (beta) WHERE held = 1 GROUP BY 1""")
def covariate_shift_coverage(spark, d):
    """Coverage of both quantiles on deployed claims that lean to low ranks by a known ratio."""
    source, target = (written(x) for x in _scored(spark, d))
    plain = G.conformal_quantile(source, ALPHA)
    out = None
    for beta in BETAS:
        w = F.exp(F.lit(beta) * F.col("v"))
        own = target.select(F.avg(w).alias("w")).first()["w"] or 0.0
        bound = G.weighted_conformal_quantile(source.withColumn("w", w), ALPHA, own)
        share = lambda q: F.coalesce(F.sum(F.when(F.col("s") <= q, F.col("w"))) / F.sum("w"), F.lit(0.0))
        row = target.withColumn("w", w).agg(F.lit(beta).alias("beta"), F.count("*").alias("k"), r(share(plain)).alias("plain_coverage"), r(share(bound)).alias("weighted_coverage")).where("k > 0").drop("k")
        out = row if out is None else out.unionByName(row)
    return out


@book.query()
def estimated_shift_coverage(spark, d):
    """The same with a ratio that is fitted: deployed are only the odd queries' claims from rank 4; covariates are rank and its square."""
    source, target = _scored(spark, d)
    x = F.array("v", F.col("v") * F.col("v"))
    source, target = written(source.withColumn("x", x)), written(target.where("v > 0.3").withColumn("x", x))
    weights, share = P.density_ratio(source, target, ridge=1e-3)
    ratio = P.ratio_of("x", weights, share)
    own = target.select(F.avg(ratio).alias("w")).first()["w"] or 0.0
    rows = []
    for name, q in (("plain", G.conformal_quantile(source, ALPHA)), ("fitted", G.weighted_conformal_quantile(source.withColumn("w", ratio), ALPHA, own))):
        covered = target.agg(F.coalesce(F.avg((F.col("s") <= q).cast("double")), F.lit(0.0)).alias("c")).first()["c"]
        rows.append((name, round(q, 6) if math.isfinite(q) else None, round(covered, 6), *[round(float(w), 6) for w in weights]))
    return spark.createDataFrame(rows, "method string, quantile double, coverage double, w_rank double, w_square double, intercept double")


@book.query()
def listwise_newton_fits(spark, d):
    """Mean loss (with ridge) before each Newton step on both listwise losses, and the weights at the end."""
    rows = written(_rows(spark, d))
    made = []
    for kind in ("permutation", "top_one"):
        w, history = P.fit_listwise_newton(rows, 3, kind)
        made += [(kind, i, round(float(f), 6), *[round(x, 5) for x in w]) for i, f in enumerate(history)]
    return spark.createDataFrame(made, "kind string, step long, loss double, w0 double, w1 double, w2 double")


def _halves(spark, d):
    """Pairs of the first and the last half of each vector; a batch is 64 consecutive ids."""
    return vectors(spark, d).select("doc_id", F.expr("doc_id div 64").alias("batch"), F.slice("vec", 1, 32).alias("a"), F.slice("vec", 33, 32).alias("b"))


_UNIT = "list_transform(list_slice(embedding, {x}, {z})::DOUBLE[], lambda t: t / sqrt(list_dot_product(list_slice(embedding, {x}, {z})::DOUBLE[], list_slice(embedding, {x}, {z})::DOUBLE[])))"


@book.query(f"""WITH p AS (SELECT vec_id // 64 AS batch, vec_id AS i, {_UNIT.format(x=1, z=32)} AS a, {_UNIT.format(x=33, z=64)} AS b FROM embeddings),
s AS (SELECT p.batch, p.i, q.i AS j, list_dot_product(p.a, q.b) / {TAU} AS s FROM p JOIN p q USING (batch)),
rw AS (SELECT batch, i, ln(sum(exp(s))) AS l FROM s GROUP BY ALL), cl AS (SELECT batch, j AS i, ln(sum(exp(s))) AS m FROM s GROUP BY ALL)
SELECT batch, count(*) AS pairs, {rs('avg((l + m) / 2 - s.s)')} AS loss FROM rw JOIN cl USING (batch, i) JOIN s ON s.batch = rw.batch AND s.i = rw.i AND s.j = rw.i GROUP BY 1""")
def batch_contrast(spark, d):
    """Symmetric in-batch loss of both halves of the vectors, as they are."""
    rows = _halves(spark, d)
    unit = lambda c: F.transform(F.col(c).cast("array<double>"), lambda t: t / F.sqrt(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda m, x: m + x * x)))
    made = rows.select("doc_id", "batch", unit("a").alias("a"), unit("b").alias("b"))
    pairs = made.select("batch", F.col("doc_id").alias("i"), "a").join(made.select("batch", F.col("doc_id").alias("j"), "b"), "batch")
    s = pairs.select("batch", "i", "j", (F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda m, x: m + x) / TAU).alias("s"))
    row = s.groupBy("batch", "i").agg(F.log(F.sum(F.exp("s"))).alias("l"), F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("own"))
    column = s.groupBy("batch", F.col("j").alias("i")).agg(F.log(F.sum(F.exp("s"))).alias("m"))
    return row.join(column, ["batch", "i"]).groupBy("batch").agg(F.count("*").alias("pairs"), r(F.avg((F.col("l") + F.col("m")) / 2 - F.col("own"))).alias("loss"))


@book.query()
def contrastive_fits(spark, d):
    """Loss of linear encoders of both halves, step by step, under the symmetric in-batch loss and under alignment with uniformity."""
    packed = P.packed_pairs(_halves(spark, d))
    rows = []
    for name, objective in (("symmetric", lambda a, b: P.symmetric_loss(a, b, TAU)), ("spread", lambda a, b: P.spread_loss(a, b, 0.5))):
        _, _, history = P.fit_encoders(packed, np.eye(32)[:16], np.eye(32)[:16], objective, steps=8, rate=0.5)
        rows += [(name, i, round(f, 6)) for i, f in enumerate(history)]
    return spark.createDataFrame(rows, "objective string, step long, loss double")
