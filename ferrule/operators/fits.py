"""Fits by one summed gradient (and curvature) a step: density ratios, listwise losses, contrastive encoders.

Every step is a scan in which each task returns one row of sums; these are added
up in one more step, so the driver gets FEW rows, however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import written
from .dense import _matrix

FEW = 8


def _row(total: np.ndarray | None):
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of ``part`` over all batches of ``rows``; None without a row."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch)
                total = own if total is None else total + own
        yield from _row(total)

    def add(batches):
        total = None
        for batch in batches:
            for own in batch.column(0):
                total = np.asarray(own.values) + (0 if total is None else total)
        yield from _row(total)

    found = [np.array(r["s"]) for r in rows.mapInArrow(run, "s array<double>").repartition(FEW).mapInArrow(add, "s array<double>").collect()]
    return sum(found) if found else None


# Density ratios.
def fit_logistic(rows: DataFrame, ridge: float = 1e-6, steps: int = 25, tol: float = 1e-10) -> np.ndarray:
    """Weights and intercept (last) of a logistic of y on x by Newton steps; rows (x array, y 0 or 1), one scan a step."""
    rows = written(rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null"))
    w = None
    for _ in range(steps):

        def part(batch, w=w):
            x = np.hstack([_matrix(batch.column(0)), np.ones((batch.num_rows, 1))])
            p = 0.5 * (1 + np.tanh(0.5 * (x @ (np.zeros(x.shape[1]) if w is None else w))))
            return np.concatenate([x.T @ (batch.column(1).to_numpy() - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        total = summed(rows, part)
        if total is None:
            return np.zeros(1)
        d = round((-1 + np.sqrt(1 + 4 * len(total))) / 2)
        w = np.zeros(d) if w is None else w
        move = np.linalg.solve(total[d:].reshape(d, d) + ridge * np.eye(d), total[:d] - ridge * w)
        w = w + move
        if np.abs(move).max() < tol:
            break
    return w


def density_ratio(source: DataFrame, target: DataFrame, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights (intercept last) and the share of the sizes for the ratio target / source of the densities of x: see ratio_of."""
    rows = written(source.select("x", F.lit(0).alias("y")).unionByName(target.select("x", F.lit(1).alias("y"))))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return fit_logistic(rows, ridge), n.get(0, 0) / max(1, n.get(1, 0))


def ratio_of(x: str, weights: np.ndarray, share: float):
    """The density ratio at column ``x``: the odds of the target, times the share of the sizes."""
    terms = [F.col(x)[i].cast("double") * float(w) for i, w in enumerate(weights[:-1])]
    return F.exp(sum(terms, F.lit(float(weights[-1])))) * share


# Listwise losses with curvature.
def _lists(rows: DataFrame) -> DataFrame:
    """(size, x, p): each query's rows in order of grade (then id), their features end to end and softmax of the gains; one row a query, written once."""
    ordered = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("grade")).alias("g"), "doc_id", "x"))).alias("l"))
    return written(ordered.select(F.size("l").alias("size"), F.flatten(F.transform("l", lambda r: r["x"].cast("array<double>"))).alias("x"), F.transform("l", lambda r: F.pow(F.lit(2.0), -r["g"]) - 1).alias("u")))


def list_moments(x: np.ndarray, gains: np.ndarray, w: np.ndarray, kind: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of one list (rows in order of grade): the curvature is a sum of covariances of the features under softmax."""
    s = x @ w
    e = np.exp(s - s.max())
    outer = x[:, :, None] * x[:, None, :]
    if kind == "top_one":
        q, p = e / e.sum(), np.exp(gains - gains.max())
        p = p / p.sum()
        mean = q @ x
        return float(-(p * np.log(q)).sum()), mean - p @ x, np.tensordot(q, outer, 1) - np.outer(mean, mean)
    if kind != "permutation":
        raise ValueError(f"unknown kind {kind}")
    tail = lambda v: np.cumsum(v[::-1], axis=0)[::-1]
    z = tail(e)
    mean = tail(e[:, None] * x) / z[:, None]
    second = tail(e[:, None, None] * outer) / z[:, None, None]
    return float((np.log(z) + s.max() - s).sum()), (mean - x).sum(axis=0), second.sum(axis=0) - mean.T @ mean


def fit_listwise_newton(rows: DataFrame, d: int, kind: str = "permutation", steps: int = 12, ridge: float = 1e-3, tol: float = 1e-10) -> tuple[list[float], list[float]]:
    """Weights and the mean loss (with ridge) before each step: Newton steps from suffix moments summed over all lists, one scan a step.

    A step that would raise the loss is halved. Lists are rows (qid, doc_id,
    grade, x); a list is held whole by a task, as its depth is bounded.
    """
    lists = _lists(rows)

    def moments(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batch):
            total = np.zeros(2 + d + d * d)
            for x, u in zip(batch.column(1), batch.column(2), strict=True):
                f, g, h = list_moments(np.asarray(x.values).reshape(-1, d), np.asarray(u.values), w, kind)
                total += np.concatenate([[1.0, f], g, h.ravel()])
            return total

        total = summed(lists, part)
        if total is None:
            return 0.0, np.zeros(d), np.eye(d)
        total = total[1:] / total[0]
        return float(total[0] + 0.5 * ridge * w @ w), total[1 : 1 + d] + ridge * w, total[1 + d :].reshape(d, d) + ridge * np.eye(d)

    w = np.zeros(d)
    f, g, h = moments(w)
    history = [f]
    for _ in range(steps):
        move = np.linalg.solve(h, -g)
        while True:
            new = moments(w + move)
            if new[0] <= f + 1e-12 or np.abs(move).max() < tol:
                break
            move = move / 2
        w = w + move
        f, g, h = new
        history.append(f)
        if np.abs(move).max() < tol:
            break
    return w.tolist(), history


# Contrastive encoders.
def packed_pairs(pairs: DataFrame) -> DataFrame:
    """(n, a, b): each batch of pairs (batch, a array, b array) as two matrices, written once; steps need no further shuffle. Batches are bounded by who makes them."""

    def pack(rows: pa.Table) -> pa.Table:
        a, b = _matrix(rows["a"]), _matrix(rows["b"])
        order = np.lexsort([*b.T[::-1], *a.T[::-1]])
        return pa.table({"n": pa.array([len(a)], pa.int32()), "a": [a[order].tobytes()], "b": [b[order].tobytes()]})

    rows = pairs.select("batch", F.col("a").cast("array<double>").alias("a"), F.col("b").cast("array<double>").alias("b")).where("a is not null and b is not null")
    return written(rows.groupBy("batch").applyInArrow(pack, "n int, a binary, b binary"))


def _softmax(s: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    top = s.max(axis=axis, keepdims=True)
    e = np.exp(s - top)
    z = e.sum(axis=axis, keepdims=True)
    return e / z, (top + np.log(z)).ravel()


def symmetric_loss(a: np.ndarray, b: np.ndarray, tau: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum over pairs of the mean cross entropy of finding each other in the batch, and its gradients at a and b."""
    s = a @ b.T / tau
    rows, row = _softmax(s, 1)
    columns, column = _softmax(s, 0)
    m = (rows + columns) / 2 - np.eye(len(a))
    return float(((row + column) / 2 - np.diag(s)).sum()), m @ b / tau, m.T @ a / tau


def spread_loss(a: np.ndarray, b: np.ndarray, weight: float, t: float = 2.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum over pairs of the squared distance plus ``weight`` times the log of the mean Gaussian potential of each side's batch, and its gradients."""
    gap = a - b
    f, ga, gb = float((gap * gap).sum()), 2 * gap, -2 * gap
    out = []
    for z, g in ((a, ga), (b, gb)):
        n = len(z)
        d = np.maximum((z * z).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * z @ z.T, 0)
        k = np.exp(-t * d)
        np.fill_diagonal(k, 0)
        if n > 1:
            mean = k.sum() / (n * (n - 1))
            f += weight * n * np.log(mean)
            g = g + weight * n * (-4 * t) * (k.sum(axis=1)[:, None] * z - k @ z) / k.sum()
        out.append(g)
    return f, out[0], out[1]


def encoder_gradients(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, objective: Callable) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of a batch and its gradients at both encoders; an encoding is a matrix product, scaled to length one."""
    made = []
    for v, m in ((x, left), (y, right)):
        z = v @ m.T
        n = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        made.append((z / n, n))
    (a, na), (b, nb) = made
    f, ga, gb = objective(a, b)
    back = lambda g, z, n: (g - (g * z).sum(axis=1, keepdims=True) * z) / n
    return f, back(ga, a, na).T @ x, back(gb, b, nb).T @ y


def contrastive_gradient(packed: DataFrame, left: np.ndarray, right: np.ndarray, objective: Callable) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs and its gradients at both encoders, from one scan; Gram blocks are formed in tasks, a batch at a time."""

    def part(batch):
        total = np.zeros(2 + left.size + right.size)
        for n, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            f, g, h = encoder_gradients(np.frombuffer(a).reshape(n, -1), np.frombuffer(b).reshape(n, -1), left, right, objective)
            total += np.concatenate([[n, f], g.ravel(), h.ravel()])
        return total

    total = summed(packed, part)
    if total is None:
        return 0.0, np.zeros_like(left), np.zeros_like(right)
    g = total[1:] / total[0]
    return float(g[0]), g[1 : 1 + left.size].reshape(left.shape), g[1 + left.size :].reshape(right.shape)


def fit_encoders(packed: DataFrame, left: np.ndarray, right: np.ndarray, objective: Callable, steps: int = 10, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Encoders after ``steps`` of descent and the loss before each and after the last; a step that raises the loss is taken back and the rate halved."""
    f, g, h = contrastive_gradient(packed, left, right, objective)
    history = [f]
    for _ in range(steps):
        new = left - rate * g, right - rate * h
        found = contrastive_gradient(packed, *new, objective)
        if found[0] <= f:
            left, right = new
            f, g, h = found
        else:
            rate /= 2
        history.append(f)
    return left, right, history
