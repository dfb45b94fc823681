"""Mined negatives, indexes that grow stale while the encoder moves, and transformed queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalize
from .dense import centroid, knn, recall_against


def false_negative_rate(mined: DataFrame, labels: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, rate): share of the ``depth`` nearest others that carry the anchor's own label.

    mined: (qid, doc_id, rank); labels: (doc_id, label).
    """
    own = labels.select(F.col("doc_id").alias("qid"), F.col("label").alias("_own"))
    same = mined.join(labels.select("doc_id", "label"), "doc_id").join(own, "qid").select("qid", "rank", (F.col("label") == F.col("_own")).cast("double").alias("same"))
    grid = same.withColumn("depth", F.explode(F.array(*[F.lit(int(k)) for k in depths]))).where("rank <= depth")
    return grid.groupBy("qid", "depth").agg(F.avg("same").alias("rate")).groupBy("depth").agg(F.avg("rate").alias("rate"))


def label_prior(labels: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(prior): chance that a random other item carries an anchor's label, from counts a label. All items are anchors unless some are given."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("total"))
    each = (labels if anchors is None else anchors).join(sizes, "label").crossJoin(F.broadcast(total))
    return each.agg(F.avg(F.try_divide(F.col("n") - 1, F.col("total") - 1)).alias("prior"))


def hardness_weights(scored: DataFrame, beta: float) -> DataFrame:
    """(qid, doc_id, w): softmax of beta s over a query's negatives; beta = 1/tau weighs them as the contrastive gradient does."""
    from ..plans.ranking import softmax

    return scored.where("positive = 0").select("qid", "doc_id", softmax(beta * F.col("s"), "qid").alias("w"))


# An encoder that moves from the vectors to their image under a rotation.
def drift(t: float, pace: float) -> float:
    """How far the encoder has come by step t: 0 at first, 1 in the end."""
    return 1 - math.exp(-t / pace)


def drifted(vectors: DataFrame, turn: np.ndarray | list[int], alpha: float, vec: str = "vec") -> DataFrame:
    """Unit vectors alpha of the way to their image; ``turn`` lists which coordinate each new one comes from."""
    c = F.col(vec).cast("array<double>")
    moved = F.array(*[(1 - alpha) * c[i] + alpha * c[int(j)] for i, j in enumerate(turn)])
    return vectors.withColumn(vec, moved).withColumn(vec, normalize(vec))


def staleness(queries: DataFrame, corpus: DataFrame, turn: list[int], steps: list[tuple[float, float]], k: int = 10, pace: float = 10.0) -> DataFrame:
    """(t, refreshed, overlap): shared part of the k nearest in an index encoded at step ``refreshed`` and in a fresh one, at step t."""
    out = None
    for t, refreshed in steps:
        now = drift(t, pace)
        asked = drifted(queries, turn, now)
        fresh, stale = (knn(asked, drifted(corpus, turn, a), k, "dot") for a in (now, drift(refreshed, pace)))
        row = recall_against(stale, fresh).agg(F.avg("recall").alias("overlap")).select(F.lit(float(t)).alias("t"), F.lit(float(refreshed)).alias("refreshed"), "overlap")
        out = row if out is None else out.unionByName(row)
    return out


def refresh_costs(overlaps: DataFrame, intervals: list[int], horizon: int) -> DataFrame:
    """(interval, overlap, cost): mean overlap over a horizon when the index is encoded again every so many steps, and encodings a step.

    ``overlaps`` (t, refreshed, overlap) holds every step with its last refresh.
    """
    steps = [(r, float(t), float(t - t % r)) for r in intervals for t in range(horizon)]
    plan = overlaps.sparkSession.createDataFrame(steps, "interval int, t double, refreshed double")
    return plan.join(overlaps, ["t", "refreshed"]).groupBy("interval").agg(F.avg("overlap").alias("overlap")).withColumn("cost", 1.0 / F.col("interval"))


# Transformed queries.
def off_axis(queries: DataFrame, axis: np.ndarray, theta: float) -> DataFrame:
    """Unit queries turned by theta towards the corpus' mean direction: less specific the larger the angle."""
    g = F.array(*[F.lit(float(v)) for v in axis])
    c = F.col("vec").cast("array<double>")
    mixed = F.zip_with(c, g, lambda u, v: math.cos(theta) * u + math.sin(theta) * v)
    return queries.withColumn("vec", mixed).withColumn("vec", normalize("vec"))


def mean_axis(corpus: DataFrame) -> np.ndarray:
    g = np.array(centroid(corpus.select("vec"), []).first()[0])
    return g / np.linalg.norm(g)


def feedback_centroids(queries: DataFrame, corpus: DataFrame, m: int = 5) -> DataFrame:
    """(qid, centroid): unit mean of a query's m nearest documents."""
    near = knn(queries, corpus, m, "cosine").select("qid", "doc_id").join(corpus.select("doc_id", "vec"), "doc_id")
    return centroid(near, ["qid"]).select("qid", normalize("centroid").alias("centroid"))


def interpolated(queries: DataFrame, centroids: DataFrame, alpha: float) -> DataFrame:
    """Queries moved alpha of the way to their centroid, at unit length."""
    mixed: Column = F.zip_with(F.col("vec").cast("array<double>"), "centroid", lambda u, v: (1 - alpha) * u + alpha * v)
    return queries.join(centroids, "qid").select("qid", mixed.alias("vec")).withColumn("vec", normalize("vec"))


def hypothetical_centroids(gold: DataFrame, misled: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(qid, centroid): the generated answer's direction, gold's (qid, centroid) or, for a share of the queries (by dice.mixed), misled's."""
    from ..functions.dice import PRIME, mixed

    other = misled.select("qid", F.col("centroid").alias("_other"))
    wrong = mixed("qid", F.lit(seed)) < math.ceil(share * PRIME)
    return gold.join(other, "qid", "left").select("qid", F.when(wrong & F.col("_other").isNotNull(), F.col("_other")).otherwise(F.col("centroid")).alias("centroid"))
