"""Spectral communities by edge joins, and what a predicate leaves connected of a stored search graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import discard, written
from .ann import assign, lloyd, seed_codebook
from .fits import summed
from .graphs import both_ways, components, degrees


def _turned(k: int, matrix: np.ndarray, names: str = "y") -> list:
    """Columns x0.. of the rows times ``matrix``."""
    return [sum((F.col(f"{names}{i}") * float(matrix[i, j]) for i in range(1, k)), F.col(f"{names}0") * float(matrix[0, j])).alias(f"x{j}") for j in range(k)]


def spectral_axes(nodes: DataFrame, edges: DataFrame, k: int, rounds: int = 40, tol: float = 1e-7, extra: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(node, x0..), written, and the k largest eigenvalues (descending) of the normalised adjacency of weighted ``edges`` (src, dst, w).

    Orthogonal iteration: a round is a join of edges and coordinates, a sum a
    node and k x k sums that the driver turns into the next rotation. The
    iterated matrix is (1 + A') / 2, whose eigenvalues aren't negative. Nodes
    without an edge keep the value 0 (of A'). ``extra`` more axes are iterated
    and left out at the end, so it converges by the gap to the one after these.
    Ends when the values move less than ``tol``.
    """
    wanted, k = k, k + extra
    strength = degrees(edges).select("node", "strength")
    both = both_ways(edges)
    scaled = both.join(strength.withColumnsRenamed({"node": "src", "strength": "ss"}), "src").join(strength.withColumnsRenamed({"node": "dst", "strength": "ds"}), "dst")
    links = written(scaled.groupBy("src", "dst").agg(F.sum(F.col("w") / F.sqrt(F.col("ss") * F.col("ds"))).alias("w")))
    start = [((F.pmod(F.xxhash64("node", F.lit(j)), F.lit(1 << 20)) + 0.5) / (1 << 20) - 0.5).alias(f"x{j}") for j in range(k)]
    now = written(nodes.select("node").distinct().select("node", *start))
    count = now.count()
    k = min(k, count)
    if not k:
        return now, np.zeros(0)
    values = np.zeros(k)
    for _ in range(rounds):
        spread = links.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("w") * F.col(f"x{j}")).alias(f"z{j}") for j in range(k)])
        moved = now.join(spread, "node", "left").select("node", *[f"x{j}" for j in range(k)], *[((F.col(f"x{j}") + F.coalesce(f"z{j}", F.lit(0.0))) / 2).alias(f"y{j}") for j in range(k)])
        held = written(moved)

        def part(batch, k=k):
            own = np.stack([batch.column(i).to_numpy() for i in range(2 * k)], axis=1)
            return (own.T @ own).ravel()

        sums = summed(held.select(*[f"{p}{j}" for p in "xy" for j in range(k)]), part).reshape(2 * k, 2 * k)
        xx, xy, yy = sums[:k, :k], sums[:k, k:], sums[k:, k:]
        # the best values within the span of x, and the basis of y that is orthonormal and in their order
        low = np.linalg.cholesky(xx + 1e-14 * np.trace(xx) * np.eye(k))
        inner = np.linalg.solve(low, np.linalg.solve(low, (xy + xy.T) / 2).T)
        ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
        mixed = np.linalg.solve(low.T, turn[:, ::-1])
        size = mixed.T @ yy @ mixed
        root = np.linalg.cholesky(size + 1e-14 * np.trace(size) * np.eye(k))
        new = written(held.select("node", *_turned(k, mixed @ np.linalg.inv(root).T)))
        discard(held)
        discard(now)
        now, before, values = new, values, 2 * ritz[::-1] - 1
        if np.abs(values - before)[:wanted].max() < tol:
            break
    discard(links)
    return now.select("node", *[f"x{j}" for j in range(min(k, wanted))]), values[:wanted]


def spectral_communities(nodes: DataFrame, edges: DataFrame, k: int, rounds: int = 40, starts: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(node, label) by k-means of the nodes' unit coordinates on the first k axes (the best of several starts), and the eigenvalues."""
    axes, values = spectral_axes(nodes, edges, k, rounds)
    k = len(values)
    if not k:
        return axes.select("node", F.lit(0).cast("bigint").alias("label")), values
    norm = F.sqrt(sum((F.col(f"x{j}") * F.col(f"x{j}") for j in range(1, k)), F.col("x0") * F.col("x0")))
    rows = written(axes.select(F.col("node").alias("doc_id"), F.transform(F.array(*[f"x{j}" for j in range(k)]), lambda x: F.try_divide(x, norm)).alias("vec")).select("doc_id", F.transform("vec", lambda x: F.coalesce(x, F.lit(0.0))).alias("vec")))
    best = None
    for s in range(starts):
        book, history = lloyd(rows, seed_codebook(rows, k, seed=s), 12)
        if best is None or history[-1] < best[0] - 1e-9:
            best = (history[-1], book)
    return written(assign(rows, best[1]).select(F.col("doc_id").alias("node"), F.col("cell").alias("label"))), values


# Connectivity.
def stored_links(stored: DataFrame) -> DataFrame:
    """(src, dst, w) of the bottom layer of stored search graphs, either way once."""
    e = stored.select("doc_id", F.explode(F.col("links")[0]).alias("other")).where("doc_id <> other")
    return e.select(F.least("doc_id", "other").alias("src"), F.greatest("doc_id", "other").alias("dst")).distinct().withColumn("w", F.lit(1.0))


def predicate_connectivity(nodes: DataFrame, edges: DataFrame, predicates: dict[str, object]) -> DataFrame:
    """(predicate, nodes, edges, components, giant): the part of the graph whose nodes satisfy each predicate (a column over ``nodes``).

    One run of components serves all predicates: a node is a row for each
    predicate it satisfies. giant is the share of these nodes in the largest
    component; a predicate that no node satisfies has no row.
    """
    names = list(predicates)
    kept = written(nodes.select("node", F.explode(F.filter(F.array(*[F.when(predicates[p], F.lit(i)) for i, p in enumerate(names)]), lambda i: i.isNotNull())).alias("i")))
    key = lambda node: (F.col(node) * len(names) + F.col("i")).alias(node)
    ends = [kept.select(F.col("node").alias(c), "i") for c in ("src", "dst")]
    inside = written(edges.select("src", "dst").join(ends[0], "src").join(ends[1], ["dst", "i"]))
    found = components(kept.select(key("node")), inside.select(key("src"), key("dst")))
    each = found.select(F.pmod("node", F.lit(len(names))).alias("i"), "component").groupBy("i", "component").agg(F.count("*").alias("n"))
    sizes = each.groupBy("i").agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("giant"))
    counted = sizes.join(inside.groupBy(F.col("i").cast("bigint").alias("i")).agg(F.count("*").alias("edges")), "i", "left")
    return counted.select(F.element_at(F.array(*[F.lit(p) for p in names]), (F.col("i") + 1).cast("int")).alias("predicate"), "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "components", "giant")
