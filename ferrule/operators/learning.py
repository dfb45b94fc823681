"""Losses, gradients and fits of ranking and contrastive models as aggregations.

Rows are (qid, doc_id, x array, grade). A gradient is one vector sum, a Hessian
one sum of outer products, so the driver sees a few numbers a step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..plans.ranking import softmax


def z_score(column: str, by: str = "qid") -> Column:
    """Population z-score in the group; 0 without spread."""
    w = W.partitionBy(by)
    sd = F.stddev_pop(column).over(w)
    return F.when(sd == 0, 0.0).otherwise((F.col(column) - F.avg(column).over(w)) / sd)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def linear(weights: list[float], x: str = "x") -> Column:
    return dot(x, F.array(*[F.lit(float(w)) for w in weights]))


def preference_pairs(rows: DataFrame) -> DataFrame:
    """(qid, i, j, delta, gi, gj): documents of one query with a higher and a lower grade."""
    a = rows.select("qid", F.col("doc_id").alias("i"), F.col("x").alias("xi"), F.col("grade").alias("gi"))
    b = rows.select("qid", F.col("doc_id").alias("j"), F.col("x").alias("xj"), F.col("grade").alias("gj"))
    return a.join(b, "qid").where("gi > gj").select("qid", "i", "j", F.zip_with("xi", "xj", lambda u, v: u - v).alias("delta"), "gi", "gj")


def _vector_sum(df: DataFrame, weight: Column, vec: str) -> np.ndarray:
    parts = df.select(weight.alias("w"), F.posexplode(vec).alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    return np.array([r["s"] for r in parts.orderBy("pos").collect()])


def pairwise_loss(pairs: DataFrame, weights: list[float]) -> DataFrame:
    """(loss, n): sum of softplus(-w . delta)."""
    return pairs.agg(F.sum(softplus(-linear(weights, "delta"))).alias("loss"), F.count("*").alias("n"))


def pairwise_gradient(pairs: DataFrame, weights: list[float]) -> np.ndarray:
    return _vector_sum(pairs, -1 / (1 + F.exp(linear(weights, "delta"))), "delta")


def fit_pairwise(pairs: DataFrame, d: int, rounds: int = 8, ridge: float = 1e-3) -> list[float]:
    """Newton steps from zero on aggregated gradient and Hessian."""
    w = np.zeros(d)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(linear(w.tolist(), "delta")))
        g = pairwise_gradient(pairs, w.tolist()) + ridge * w
        outer = pairs.select((p * (1 - p)).alias("h"), F.posexplode("delta").alias("a", "u"), "delta").select("h", "a", "u", F.posexplode("delta").alias("b", "v"))
        rows = outer.groupBy("a", "b").agg(F.sum(F.col("h") * F.col("u") * F.col("v")).alias("s")).collect()
        hess = ridge * np.eye(d)
        for r in rows:
            hess[r["a"], r["b"]] += r["s"]
        step = np.linalg.solve(hess, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def swap_changes(rows: DataFrame, score: Column, k: int = 10) -> DataFrame:
    """(qid, i, j, change): |change of NDCG| if two documents of different grade swapped places, from ranks and grades alone."""
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round(score, 9)), "doc_id"))
    best = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "doc_id"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    disc = lambda c: F.when(F.col(c) <= k, 1 / F.log2(F.col(c) + 1.0)).otherwise(0.0)
    x = rows.withColumn("place", place).withColumn("best", best).withColumn("gain", gain)
    ideal = x.groupBy("qid").agg(F.sum(F.col("gain") * disc("best")).alias("ideal"))
    y = x.select("qid", "doc_id", "grade", "gain", disc("place").alias("disc"))
    a = y.select("qid", F.col("doc_id").alias("i"), F.col("grade").alias("gi"), F.col("gain").alias("ui"), F.col("disc").alias("di"))
    b = y.select("qid", F.col("doc_id").alias("j"), F.col("grade").alias("gj"), F.col("gain").alias("uj"), F.col("disc").alias("dj"))
    pairs = a.join(b, "qid").where("gi > gj").join(ideal, "qid")
    return pairs.select("qid", "i", "j", F.when(F.col("ideal") > 0, F.abs((F.col("ui") - F.col("uj")) * (F.col("di") - F.col("dj"))) / F.col("ideal")).otherwise(0.0).alias("change"))


def lambda_forces(rows: DataFrame, score: Column, k: int = 10, weighted: bool = True) -> DataFrame:
    """(qid, doc_id, force): each pair pulls its better document up and its worse one down, by its loss slope times the swap's change."""
    s = rows.select("qid", "doc_id", score.alias("s"))
    pairs = swap_changes(rows, score, k)
    full = pairs.join(s.select("qid", F.col("doc_id").alias("i"), F.col("s").alias("si")), ["qid", "i"]).join(s.select("qid", F.col("doc_id").alias("j"), F.col("s").alias("sj")), ["qid", "j"])
    pull = (F.col("change") if weighted else F.lit(1.0)) / (1 + F.exp(F.col("si") - F.col("sj")))
    f = full.withColumn("f", pull)
    up = f.select("qid", F.col("i").alias("doc_id"), F.col("f").alias("force"))
    return up.unionByName(f.select("qid", F.col("j").alias("doc_id"), (-F.col("f")).alias("force"))).groupBy("qid", "doc_id").agg(F.sum("force").alias("force"))


def fit_lambda(rows: DataFrame, d: int, rounds: int = 10, rate: float = 0.5) -> list[float]:
    """Gradient steps along the summed forces."""
    w = np.full(d, 1e-3)
    n = rows.select("qid").distinct().count()
    for _ in range(rounds):
        forces = lambda_forces(rows, linear(w.tolist())).join(rows.select("qid", "doc_id", "x"), ["qid", "doc_id"])
        w = w + rate * _vector_sum(forces, F.col("force"), "x") / max(1, n)
    return w.tolist()


def top_one_loss(rows: DataFrame, score: Column) -> DataFrame:
    """(qid, loss): cross entropy of softmax(scores) from softmax(gains)."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    x = rows.select("qid", softmax(gain, "qid").alias("p"), softmax(score, "qid").alias("q"))
    return x.groupBy("qid").agg(F.sum(-F.col("p") * F.log("q")).alias("loss"))


def permutation_loss(rows: DataFrame, score: Column) -> DataFrame:
    """(qid, loss): negative log-probability of the order by grade under successive softmax choices.

    The log-sum-exp over what is left is a suffix sum of exp(score - max).
    """
    order = W.partitionBy("qid").orderBy(F.desc("grade"), "doc_id").rowsBetween(0, W.unboundedFollowing)
    x = rows.withColumn("s", score).withColumn("top", F.max("s").over(W.partitionBy("qid")))
    rest = F.col("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top"))).over(order))
    return x.withColumn("l", rest - F.col("s")).groupBy("qid").agg(F.sum("l").alias("loss"))


def fit_listwise(rows: DataFrame, d: int, kind: str = "permutation", rounds: int = 30, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Gradient steps on the listwise losses: ``permutation`` (by grade) or ``top_one`` (of the gains).

    Either gradient is a sum of a number a row times its features: the
    softmax share a row has of what is left at each place, less what it should have.
    """
    w, n = np.zeros(d), max(1, rows.select("qid").distinct().count())
    order = W.partitionBy("qid").orderBy(F.desc("grade"), "doc_id")
    for _ in range(rounds):
        s = rows.withColumn("s", linear(w.tolist()))
        if kind == "top_one":
            pull = s.select("x", (softmax(F.col("s"), "qid") - softmax(F.pow(F.lit(2.0), F.col("grade")) - 1, "qid")).alias("g"))
        elif kind == "permutation":
            e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(W.partitionBy("qid"))))
            left = e.withColumn("left", F.sum("e").over(order.rowsBetween(0, W.unboundedFollowing)))
            pull = left.select("x", (F.col("e") * F.sum(1 / F.col("left")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).alias("g"))
        else:
            raise ValueError(f"unknown kind {kind}")
        w = w - rate * (_vector_sum(pull, F.col("g"), "x") / n + ridge * w)
    return w.tolist()


def fit_pointwise(rows: DataFrame, d: int, ridge: float = 1e-3) -> list[float]:
    """Weights and intercept (last) of the grades' least-squares fit, from one pass of sums."""
    wide = rows.select(F.concat(F.col("x"), F.array(F.lit(1.0))).alias("x"), F.col("grade").cast("double").alias("y"))
    b = _vector_sum(wide, F.col("y"), "x")
    outer = wide.select("x", F.posexplode("x").alias("i", "u")).select("i", "u", F.posexplode("x").alias("j", "v")).groupBy("i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("s"))
    a = ridge * np.eye(d + 1)
    for r in outer.collect():
        a[r["i"], r["j"]] += r["s"]
    return np.linalg.solve(a, b).tolist()


def margin_error(scored: DataFrame) -> DataFrame:
    """(qid, loss): squared error of all score margins between a student s and a teacher t, from sums alone.

    Over ordered pairs it is 2 n sum(e^2) - 2 (sum e)^2 with e = s - t.
    """
    e = F.col("s") - F.col("t")
    return scored.groupBy("qid").agg((2 * F.count("*") * F.sum(e * e) - 2 * F.pow(F.sum(e), 2)).alias("loss"))


# Contrastive losses over (qid, doc_id, s, positive).
def contrastive_loss(scored: DataFrame, tau: float = 0.1) -> DataFrame:
    """(qid, loss): log-sum-exp of all scores minus the positive's, over tau."""
    x = scored.withColumn("u", F.col("s") / tau).withColumn("m", F.max(F.col("s") / tau).over(W.partitionBy("qid")))
    return x.groupBy("qid").agg((F.first("m") + F.log(F.sum(F.exp(F.col("u") - F.col("m")))) - F.max(F.when(F.col("positive") == 1, F.col("u")))).alias("loss"))


def negative_weights(scored: DataFrame, tau: float = 0.1) -> DataFrame:
    """(qid, doc_id, w): share of the gradient each negative gets."""
    neg = scored.where("positive = 0")
    return neg.select("qid", "doc_id", softmax(F.col("s"), "qid", tau).alias("w"))


def hardness(scored: DataFrame, tau: float = 0.1) -> DataFrame:
    """(qid, entropy, top): entropy in nats of the negatives' weights, and the largest."""
    w = negative_weights(scored, tau)
    return w.groupBy("qid").agg(F.sum(F.when(F.col("w") > 0, -F.col("w") * F.log("w")).otherwise(0.0)).alias("entropy"), F.max("w").alias("top"))


def debiased_negatives(scored: DataFrame, tau: float, prior: float, beta: float = 0.0) -> DataFrame:
    """(qid, biased, debiased): mean of exp(s / tau) over all, and with the positives' share taken out (floored at exp(-1 / tau)).

    With beta above 0 the mean is weighted by exp(beta s).
    """
    g, w = F.exp(F.col("s") / tau), F.exp(beta * F.col("s"))
    agg = scored.groupBy("qid").agg((F.sum(g * w) / F.sum(w)).alias("biased"), F.avg(F.when(F.col("positive") == 1, g)).alias("pos"))
    return agg.select("qid", "biased", F.greatest((F.col("biased") - prior * F.col("pos")) / (1 - prior), F.exp(F.lit(-1.0 / tau))).alias("debiased"))
