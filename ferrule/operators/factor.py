"""Factors of tall tables: QR in a tree, singular values, nested prefixes.

Only d x d triangles travel: a task folds its rows into one triangle, and
triangles are stacked and folded again, FAN at a time, until one is left. The
singular values are those of the last triangle, so no square of the condition
number enters, unlike with second moments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import _matrix, column_means, project

#: Triangles folded by one task of a round.
FAN = 8


def _fold(r: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """The triangle of the rows of r and x, with a diagonal that isn't negative."""
    q = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
    sign = np.where(np.diag(q) < 0, -1.0, 1.0)
    return q * sign[:, None]


def _send(r: np.ndarray | None):
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r.shape[0]], pa.int32()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["rows", "r"])


def tall_triangle(df: DataFrame, vec: str = "vec", mean: np.ndarray | None = None) -> np.ndarray:
    """R of the QR factors of the rows of ``vec`` (minus ``mean``): R'R is their second moment. Null vectors are left out; no row gives a 0 x 0 matrix."""
    kind = "rows int, r array<double>"

    def rows(batches):
        r = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                r = _fold(r, x if mean is None else x - mean)
        yield from _send(r)

    def stacked(batches):
        r = None
        for batch in batches:
            for n, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                r = _fold(r, np.asarray(flat.values).reshape(n, -1))
        yield from _send(r)

    source = df.select(F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    parts = source.mapInArrow(rows, kind)
    left = source.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInArrow(stacked, kind)
    r = None
    for row in parts.collect():  # FAN triangles at most
        r = _fold(r, np.array(row["r"]).reshape(row["rows"], -1))
    return np.empty((0, 0)) if r is None else r


def singular_axes(df: DataFrame, vec: str = "vec", centred: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean (zero if not ``centred``), singular values (descending) and right axes (rows) of the table; an axis' largest entry is positive."""
    mean = column_means(df, vec)
    mean = mean if centred else np.zeros_like(mean)
    _, values, axes = np.linalg.svd(tall_triangle(df, vec, mean), full_matrices=False)
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return mean, values, axes * sign[:, None]


def left_factors(df: DataFrame, mean: np.ndarray, values: np.ndarray, axes: np.ndarray, vec: str = "vec") -> DataFrame:
    """The rows with ``vec`` replaced by their row of U: coordinates on the axes over the singular values, 0 where that is 0."""
    over = np.where(values > values.max(initial=0) * 1e-12, 1 / np.maximum(values, 1e-300), 0.0)
    return project(df, axes * over[:, None], mean, vec)


# Nested prefixes.
def nested_weights(sizes: list[int], weights: list[float], d: int) -> np.ndarray:
    """How much the square of each coordinate counts: a coordinate is lost by every prefix that ends before it."""
    return np.array([sum(w for m, w in zip(sizes, weights, strict=True) if m <= j) for j in range(d)])


def prefix_losses(df: DataFrame, sizes: list[int], vec: str = "vec") -> DataFrame:
    """(size, loss): of all prefixes together, in one pass, what the coordinates beyond them hold (squared, about the mean)."""
    at = df.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"))
    held = at.select("pos", (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("e"))
    return held.select(F.explode(F.array(*[F.lit(m) for m in sizes])).alias("size"), "pos", "e").groupBy("size").agg(F.sum(F.when(F.col("pos") >= F.col("size"), F.col("e")).otherwise(0.0)).alias("loss"))


def nested_rotation(df: DataFrame, sizes: list[int], weights: list[float], vec: str = "vec", steps: int = 0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Mean, rotation (rows are the new axes) and the joint loss before and after: sum of weight times what a prefix of the rotated vectors loses.

    The triangle of one pass holds all that any rotation's losses need. The
    loss is the trace of R E R' with the energy E and weights that rise along
    the axes, so descending axes of E are the best there is (``steps`` 0); or
    ``steps`` of Jacobi turns from ``start`` lower it one pair of axes a time.
    """
    mean = column_means(df, vec)
    r = tall_triangle(df, vec, mean)
    d = len(mean)
    count = nested_weights(sizes, weights, d)

    def loss(turn: np.ndarray) -> float:
        return float(count @ ((r @ turn.T) ** 2).sum(axis=0))

    turn = np.eye(d) if start is None else start.copy()
    history = [loss(turn)]
    if not steps:
        axes = np.linalg.svd(r)[2]
        turn = axes * np.sign(axes[np.arange(d), np.abs(axes).argmax(axis=1)])[:, None]
        history.append(loss(turn))
    for _ in range(steps):
        y = r @ turn.T
        for i in range(d - 1):
            for j in range(i + 1, d):
                if count[i] != count[j]:
                    a, b, c = y[:, i] @ y[:, i], y[:, j] @ y[:, j], y[:, i] @ y[:, j]
                    t = 0.5 * np.arctan2(2 * c, a - b)  # the axis of most energy comes first
                    cos, sin = np.cos(t), np.sin(t)
                    turn[[i, j]] = np.array([[cos, sin], [-sin, cos]]) @ turn[[i, j]]
                    y[:, [i, j]] = y[:, [i, j]] @ np.array([[cos, -sin], [sin, cos]])
        history.append(loss(turn))
    return mean, turn, history
