"""Small models on bounded matrices: low-rank students, ridge scorers, realisability, contrastive descent, boosted trees.

The matrices (queries by documents of one pool, or one batch) are bounded by
their caller; the boosted trees' statistics come from aggregations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import lambda_forces


# Low rank.
def best_rank(scores: np.ndarray, d: int) -> np.ndarray:
    u, s, v = np.linalg.svd(scores, full_matrices=False)
    return (u[:, :d] * s[:d]) @ v[:d]


def dual_encoder(scores: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and document vectors whose inner products are the best rank-d approximation."""
    u, s, v = np.linalg.svd(scores, full_matrices=False)
    root = np.sqrt(s[:d])
    return u[:, :d] * root, v[:d].T * root


def relative_error(scores: np.ndarray, approx: np.ndarray) -> float:
    return float(np.linalg.norm(scores - approx) / np.linalg.norm(scores))


def margin_student(teacher: np.ndarray, d: int) -> np.ndarray:
    """Best rank d of the teacher without each query's mean: only margins matter."""
    return best_rank(teacher - teacher.mean(axis=1, keepdims=True), d)


def margin_loss(student: np.ndarray, teacher: np.ndarray) -> float:
    """Squared error of all ordered score margins of each query."""
    e = (student - teacher) - (student - teacher).mean(axis=1, keepdims=True)
    return float(2 * student.shape[1] * (e * e).sum())


def top_recall(scores: np.ndarray, gold: np.ndarray, k: int) -> float:
    order = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :k]
    return float((order == gold[:, None]).any(axis=1).mean())


# Pair scorers.
def relu_features(x: np.ndarray, n: int, seed: int, gamma: float = 1.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.maximum(x @ (rng.normal(size=(x.shape[1], n)) * gamma) + rng.uniform(-1, 1, n), 0.0)


def fit_ridge(x: np.ndarray, y: np.ndarray, n: int, seed: int, gamma: float = 1.0, lam: float = 1e-6):
    """A joint scorer of pair features: ridge regression on random features; returns a function."""
    phi = relu_features(x, n, seed, gamma)
    w = np.linalg.solve(phi.T @ phi + lam * np.eye(n), phi.T @ y)
    return lambda z: relu_features(z, n, seed, gamma) @ w


def pool_outcomes(order: np.ndarray, rerank: np.ndarray, gold: np.ndarray, k: int) -> dict[str, int]:
    """What ranking the first k again does to the top place: fixed, kept, broke, missed."""
    out = dict.fromkeys(("fixed", "kept", "broke", "missed"), 0)
    for row, score, truth in zip(order, rerank, gold, strict=True):
        pool = row[:k]
        was, now = row[0] == truth, pool[np.argmax(score[pool])] == truth
        out["kept" if was and now else "broke" if was else "fixed" if now else "missed"] += 1
    return out


# What inner products of few dimensions can realise.
def hadamard(k: int) -> np.ndarray:
    i = np.arange(1 << k)
    return 1 - 2 * (np.bitwise_count(i[:, None] & i[None, :]) % 2).astype(int)


def sign_rank_floor(pattern: np.ndarray) -> float:
    """sqrt(mn) over the spectral norm: no fewer dimensions realise the signs."""
    return float(np.sqrt(pattern.size) / np.linalg.norm(pattern, 2))


def realize_signs(pattern: np.ndarray, d: int, restarts: int = 4, steps: int = 400, rate: float = 0.5, seed: int = 0) -> float:
    """Best share of signs that rank-d factors got right, by descent on softplus margins."""
    best = 0.0
    for r in range(restarts):
        rng = np.random.default_rng(seed + r)
        x, y = rng.normal(size=(pattern.shape[0], d)), rng.normal(size=(pattern.shape[1], d))
        for _ in range(steps):
            g = -pattern / (1 + np.exp(np.clip(pattern * (x @ y.T), -30, 30)))
            x, y = x - rate * g @ y / len(y), y - rate * g.T @ x / len(x)
        best = max(best, float((np.sign(x @ y.T) == pattern).mean()))
        if best == 1.0:
            break
    return best


def pair_queries(n: int) -> np.ndarray:
    """One query for each pair of n documents: a hard case for single vectors."""
    rows = [(i, j) for i in range(n) for j in range(i + 1, n)]
    out = -np.ones((len(rows), n), int)
    for r, (i, j) in enumerate(rows):
        out[r, [i, j]] = 1
    return out


# Contrastive descent on the sphere (one batch).
def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def contrastive_descent(z: np.ndarray, pair: np.ndarray, tau: float = 0.2, steps: int = 200, rate: float = 0.5) -> tuple[np.ndarray, list[float]]:
    """Gradient steps of the in-batch contrastive loss; returns points and losses."""
    z, losses = _unit(z), []
    n = len(z)
    for _ in range(steps):
        s = z @ z.T / tau
        np.fill_diagonal(s, -np.inf)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        losses.append(float(-np.log(p[np.arange(n), pair] + 1e-300).mean()))
        p[np.arange(n), pair] -= 1
        z = _unit(z - rate * (p + p.T) @ z / (tau * n))
    return z, losses


def alignment(z: np.ndarray, pair: np.ndarray) -> float:
    return float(((z - z[pair]) ** 2).sum(axis=1).mean())


def uniformity(z: np.ndarray, t: float = 2.0) -> float:
    d = ((z[:, None] - z[None, :]) ** 2).sum(axis=2)
    return float(np.log(np.exp(-t * d[~np.eye(len(z), dtype=bool)]).mean()))


def information_bound(rho: float, negatives: int, batches: int = 4000, seed: int = 0) -> float:
    """ln(N + 1) minus the mean contrastive loss of the optimal critic on Gaussian pairs: at most their information."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(batches, 1))
    y = np.concatenate([rho * x + np.sqrt(1 - rho * rho) * rng.normal(size=x.shape), rng.normal(size=(batches, negatives))], axis=1)
    s = (2 * rho * x * y - rho * rho * (x * x + y * y)) / (2 * (1 - rho * rho))
    top = s.max(axis=1, keepdims=True)
    loss = (top[:, 0] + np.log(np.exp(s - top).sum(axis=1))) - s[:, 0]
    return float(np.log(negatives + 1) - loss.mean())


# Boosted trees on lambda forces.
class Stump:
    """feature <= threshold ? left : right."""

    def __init__(self, feature: int, threshold: float, left: float, right: float):
        self.feature, self.threshold, self.left, self.right = feature, threshold, left, right

    def column(self, x: str = "x") -> Column:
        return F.when(F.col(x)[self.feature] <= self.threshold, float(self.left)).otherwise(float(self.right))


def fit_stump(rows: DataFrame, d: int, edges: list[list[float]]) -> Stump:
    """Best split of the forces by squared error, from one sum and count a feature and bin."""
    from .evaluation import bin_of

    bins = F.array(*[F.struct(F.lit(j).alias("j"), bin_of(F.col("x")[j], [float("-inf"), *edges[j], float("inf")]).alias("b")) for j in range(d)])
    sums = rows.select("force", F.explode(bins).alias("e")).groupBy("e.j", "e.b").agg(F.sum("force").alias("s"), F.count("*").alias("n")).collect()
    best, chosen = -np.inf, None
    for j in range(d):
        s, n = np.zeros(len(edges[j]) + 1), np.zeros(len(edges[j]) + 1)
        for r in sums:
            if r["j"] == j:
                s[r["b"]], n[r["b"]] = r["s"], r["n"]
        left, ln = np.cumsum(s)[:-1], np.cumsum(n)[:-1]
        right, rn = s.sum() - left, n.sum() - ln
        gain = np.where((ln > 0) & (rn > 0), left**2 / np.maximum(ln, 1) + right**2 / np.maximum(rn, 1), -np.inf)
        if len(gain) and gain.max() > best + 1e-12:
            i = int(gain.argmax())
            best, chosen = gain[i], Stump(j, np.nextafter(edges[j][i], -np.inf), left[i] / ln[i], right[i] / rn[i])
    return chosen or Stump(0, 0.0, 0.0, 0.0)


class Tree:
    """Splits and values of nodes numbered as in a heap: node i has the children 2i (at or below the threshold) and 2i + 1."""

    def __init__(self, splits: dict[int, tuple[int, float]], values: dict[int, float]):
        self.splits, self.values = splits, values

    def node(self, x: str = "x", at: int = 1) -> Column:
        """The leaf a row comes to."""
        if at not in self.splits:
            return F.lit(at)
        feature, threshold = self.splits[at]
        return F.when(F.col(x)[feature] <= threshold, self.node(x, 2 * at)).otherwise(self.node(x, 2 * at + 1))

    def column(self, x: str = "x", at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(float(self.values.get(at, 0.0)))
        feature, threshold = self.splits[at]
        return F.when(F.col(x)[feature] <= threshold, self.column(x, 2 * at)).otherwise(self.column(x, 2 * at + 1))


def fit_tree(rows: DataFrame, d: int, edges: list[list[float]], depth: int = 2, least: int = 1) -> Tree:
    """A regression tree of the forces by squared error: a level costs one sum and count a node, feature and bin.

    A node is split where that lowers the error most and leaves at least
    ``least`` rows on either side.
    """
    from .evaluation import bin_of

    tree, open_nodes = Tree({}, {}), [1]
    bins = F.array(*[F.struct(F.lit(j).alias("j"), bin_of(F.col("x")[j], [float("-inf"), *edges[j], float("inf")]).alias("b")) for j in range(d)])
    for _ in range(depth):
        placed = rows.select("force", tree.node().alias("node"), F.explode(bins).alias("e")).where(F.col("node").isin(open_nodes))
        sums = placed.groupBy("node", "e.j", "e.b").agg(F.sum("force").alias("s"), F.count("*").alias("n")).collect()
        made = []
        for node in open_nodes:
            best, chosen = -np.inf, None
            for j in range(d):
                s, n = np.zeros(len(edges[j]) + 1), np.zeros(len(edges[j]) + 1)
                for r in sums:
                    if r["node"] == node and r["j"] == j:
                        s[r["b"]], n[r["b"]] = r["s"], r["n"]
                if n.sum():
                    tree.values.setdefault(node, s.sum() / n.sum())
                left, ln = np.cumsum(s)[:-1], np.cumsum(n)[:-1]
                right, rn = s.sum() - left, n.sum() - ln
                fits = (ln >= least) & (rn >= least)
                gain = np.where(fits, left**2 / np.maximum(ln, 1) + right**2 / np.maximum(rn, 1), -np.inf) - (s.sum() ** 2 / n.sum() if n.sum() else 0.0)
                if len(gain) and gain.max() > max(best, 0.0) + 1e-12:
                    i = int(gain.argmax())
                    best, chosen = gain[i], (j, float(np.nextafter(edges[j][i], -np.inf)), left[i] / ln[i], right[i] / rn[i])
            if chosen:
                tree.splits[node] = chosen[:2]
                tree.values[2 * node], tree.values[2 * node + 1] = chosen[2:]
                made += [2 * node, 2 * node + 1]
        open_nodes = made
        if not made:
            break
    return tree


def fit_boosted(rows: DataFrame, d: int, rounds: int = 10, rate: float = 0.1, bins: int = 16, depth: int = 1) -> list[Stump | Tree]:
    """Boosting: each round a stump (or a tree of ``depth`` levels) is fitted to the forces of the scores so far. rows: (qid, doc_id, x, grade)."""
    quantiles = rows.agg(*[F.percentile(F.col("x")[j], [i / bins for i in range(1, bins)]).alias(f"q{j}") for j in range(d)]).first()
    edges = [sorted(set(quantiles[f"q{j}"])) for j in range(d)]
    stumps: list[Stump | Tree] = []
    for _ in range(rounds):
        forces = lambda_forces(rows, boosted_score(stumps, rate)).join(rows.select("qid", "doc_id", "x"), ["qid", "doc_id"])
        stumps.append(fit_stump(forces, d, edges) if depth == 1 else fit_tree(forces, d, edges, depth))
    return stumps


def boosted_score(stumps: list[Stump | Tree], rate: float = 0.1) -> Column:
    out = F.lit(0.0)
    for s in stumps:
        out = out + rate * s.column()
    return out
