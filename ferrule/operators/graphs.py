"""Entity graphs and segmentation.

Edges are (src, dst, w), each undirected edge once with src < dst. Labels are
(node, label).
"""

from __future__ import annotations

from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.durable import discard, written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength)."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def degree_statistics(edges: DataFrame) -> DataFrame:
    """(nodes, mean_degree, kappa, threshold): kappa = <k^2>/<k>; below a retention of 1 / (kappa - 1) a random graph falls apart."""
    k = F.col("degree").cast("double")
    s = degrees(edges).agg(F.count("*").alias("nodes"), F.avg(k).alias("mean_degree"), (F.avg(k * k) / F.avg(k)).alias("kappa"))
    return s.withColumn("threshold", F.try_divide(F.lit(1.0), F.col("kappa") - 1))


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(q): weight inside communities against the expectation from strengths."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("la")), labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    inside = edges.join(a, "src").join(b, "dst").where("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("w").alias("inside"))
    strength = degrees(edges).join(labels, "node").groupBy("label").agg(F.sum("strength").alias("total"))
    m = edges.agg(F.sum("w").alias("m"))
    parts = strength.join(inside, "label", "left").crossJoin(F.broadcast(m))
    return parts.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - gamma * F.pow(F.col("total") / (2 * F.col("m")), 2)).alias("q"))


def aggregate_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Communities as nodes: (src, dst, w) with src <= dst, loops being the weight inside."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("la")), labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    joined = edges.join(a, "src").join(b, "dst").select(F.least("la", "lb").alias("src"), F.greatest("la", "lb").alias("dst"), "w")
    return joined.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable. Each round every node takes its neighbours' least label, then its label's label."""
    links = written(both_ways(edges.withColumn("w", F.lit(1.0)) if "w" not in edges.columns else edges).select("src", "dst"))
    now = written(nodes.select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        near = links.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        low = now.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("low"), "label")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = written(low.join(jump, "low", "left").select("node", F.coalesce("next", "low").alias("new"), "label"))
        changed = new.where("new <> label").limit(1).count()
        discard(now)
        now = new.select("node", F.col("new").alias("label"))
        if not changed:
            discard(links)
            return now.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def label_spread(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): communities by rounds in which every second node (by hash) takes the heaviest label around it, ties to the smaller."""
    links, now = written(both_ways(edges)), written(nodes.select("node", F.col("node").alias("label")))
    for step in range(2 * rounds):
        votes = links.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("w").alias("v"))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.round("v", 9), F.col("label"))).alias("best"))
        turn = F.pmod(F.xxhash64("node", F.lit(step // 2)), F.lit(2)) == step % 2
        new = written(now.join(best, "node", "left").select("node", F.when(turn, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label")))
        discard(now)
        now = new
    discard(links)
    return now


def local_moves(edges: DataFrame, labels: DataFrame, gamma: float = 1.0, rounds: int = 6, within: DataFrame | None = None) -> DataFrame:
    """(node, label): rounds in which every second node (by hash) goes to the community around it of the largest modularity gain.

    A node that gains nothing stays, equal gains go to the smaller label. With
    ``within`` (node, label) communities are refined instead: a node moves only
    inside its label there, only while it is alone, and only next to nodes that
    do not move in this round, so refined communities stay connected.
    """
    links = both_ways(edges.where("src <> dst"))
    if within is not None:
        side = lambda c, name: within.select(F.col("node").alias(c), F.col("label").alias(name))
        links = links.join(side("src", "_a"), "src").join(side("dst", "_b"), "dst").where("_a = _b").drop("_a", "_b")
    links, strength = written(links), written(degrees(edges).select("node", "strength"))
    two_m = 2 * (edges.agg(F.sum("w")).first()[0] or 0.0)
    now, still = written(labels.select("node", "label")), 0
    for step in range(2 * rounds):
        turn = lambda c: F.pmod(F.xxhash64(c, F.lit(step // 2)), F.lit(2)) == step % 2  # noqa: B023, E731
        own = now.join(strength, "node", "left").fillna(0.0, ["strength"])
        total = own.groupBy("label").agg(F.sum("strength").alias("total"), F.count("*").alias("size"))
        near = links.where(~turn("dst")) if within is not None else links
        around = near.where(turn("src")).join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("w").alias("k"))
        stay = own.where(turn("node")).select("node", "label", F.lit(0.0).alias("k"))
        options = around.unionByName(stay).groupBy("node", "label").agg(F.sum("k").alias("k"))
        judged = options.join(own.select("node", F.col("label").alias("own"), "strength"), "node").join(total, "label")
        if within is not None:
            alone = own.join(total.where("size = 1").select("label"), "label", "left_semi").select("node")
            judged = judged.join(alone, "node", "left_semi")
        rest = F.col("total") - F.when(F.col("label") == F.col("own"), F.col("strength")).otherwise(0.0)
        gain = F.round(F.col("k") - gamma * F.col("strength") * rest / two_m, 9)
        best = judged.groupBy("node").agg(F.min_by("label", F.struct((-gain).alias("g"), (F.col("label") != F.col("own")).alias("moves"), F.col("label"))).alias("best"))
        new = written(now.join(best, "node", "left").select("node", F.coalesce("best", "label").alias("label"), F.col("label").alias("before")))
        still = 0 if new.where("label <> before").limit(1).count() else still + 1
        discard(now)
        now = new.select("node", "label")
        if still == 2:
            break
    discard(links)
    discard(strength)
    return now


def communities(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, refined: bool = True, levels: int = 10) -> tuple[DataFrame, list[tuple[int, float]]]:
    """hierarchy(), in the end with every community cut in its connected pieces if ``refined``."""
    found, history = hierarchy(nodes, edges, gamma, refined, levels)
    if refined:
        side = lambda c, name: found.select(F.col("node").alias(c), F.col("label").alias(name))
        inside = edges.join(side("src", "_a"), "src").join(side("dst", "_b"), "dst").where("_a = _b").select("src", "dst", "w")
        found = components(nodes, inside).withColumnRenamed("component", "label")
    return found, history


def hierarchy(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, refined: bool = True, levels: int | None = 10, first: DataFrame | None = None) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(node, label), and of each level the number of communities and the modularity.

    Every level moves nodes, makes its communities the nodes of a smaller graph and
    goes on there until modularity no longer rises, or ``levels`` (None: any
    number) are done. ``refined``
    aggregates by communities refined inside the moved ones, which start the
    next level together. The first level's moves don't depend on it: ``first``
    has them if local_moves() was run already.
    """
    whole = written(nodes.select("node", F.col("node").alias("label")))  # of each node of the graph, its node on this level
    graph, start, history = written(edges), None, []
    best, found = -1.0, whole
    for _ in count() if levels is None else range(levels):
        own = written(whole.select(F.col("label").alias("node")).distinct())
        alone = own.select("node", F.col("node").alias("label"))
        moved = first if first is not None and not history else local_moves(graph, alone if start is None else start, gamma)
        named = written(whole.withColumnRenamed("label", "at").join(moved.withColumnRenamed("node", "at"), "at").select("node", "label"))
        q = modularity(edges, named, gamma).first()[0] or 0.0
        if q <= best + 1e-9:
            break
        best, found = q, named
        history.append((named.select("label").distinct().count(), q))
        parts = moved if not refined else local_moves(graph, alone, gamma, within=moved)
        start = None if not refined else written(parts.withColumnRenamed("label", "part").join(moved, "node").groupBy(F.col("part").alias("node")).agg(F.min("label").alias("label")))
        graph = written(aggregate_graph(graph, parts))
        whole = written(whole.withColumnRenamed("label", "at").join(parts.withColumnRenamed("node", "at"), "at").select("node", "label"))
    return found, history


# Small graphs on the driver or inside one group: adjacency matrices.
def dense_modularity(a: np.ndarray, labels: np.ndarray, gamma: float = 1.0) -> float:
    two_m, k = a.sum(), a.sum(axis=1)
    same = labels[:, None] == labels[None, :]
    return float(((a - gamma * np.outer(k, k) / two_m) * same).sum() / two_m)


def louvain_moves(a: np.ndarray, labels: np.ndarray | None = None, gamma: float = 1.0) -> np.ndarray:
    """Nodes in order move to the neighbouring community of the largest gain until none gains."""
    n, two_m, k = len(a), a.sum(), a.sum(axis=1)
    labels = np.arange(n) if labels is None else labels.copy()
    moved = True
    while moved:
        moved = False
        for i in range(n):
            own = labels[i]
            labels[i] = -1
            best, most = own, -np.inf
            for c in sorted({own, *labels[a[i] > 0].tolist()} - {-1}):
                members = labels == c
                gain = a[i, members].sum() - gamma * k[i] * k[members].sum() / two_m
                if gain > most + 1e-12 or (abs(gain - most) <= 1e-12 and c == own):
                    best, most = c, gain
            labels[i] = best
            moved |= best != own
    return np.unique(labels, return_inverse=True)[1]


def louvain(a: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Moves, then the same on the graph of communities, until nothing changes."""
    whole, small = np.arange(len(a)), a.astype(float)
    while True:
        part = louvain_moves(small, None, gamma)
        whole = part[whole]
        h = np.eye(part.max() + 1)[part]
        if len(h) == h.shape[1]:
            return whole
        small = h.T @ small @ h


def split_disconnected(a: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Communities cut into their connected pieces."""
    out, name = -np.ones(len(a), int), 0
    for i in range(len(a)):
        if out[i] < 0:
            todo = [i]
            out[i] = name
            while todo:
                j = todo.pop()
                for k in np.flatnonzero((a[j] > 0) & (labels == labels[i]) & (out < 0)):
                    out[k] = name
                    todo.append(int(k))
            name += 1
    return out


def leiden(a: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Louvain with every community connected."""
    return split_disconnected(a, louvain(a, gamma))


def spectral_halves(a: np.ndarray, tol: float = 1e-9) -> np.ndarray | None:
    """Signs of the leading eigenvector of the modularity matrix; None if the graph does not divide."""
    k = a.sum(axis=1)
    values, vectors = np.linalg.eigh(a - np.outer(k, k) / a.sum())
    if values[-1] <= tol:
        return None
    v = vectors[:, -1]
    return (v * np.sign(v[np.abs(v).argmax()]) > 0).astype(int)


def best_halves(a: np.ndarray) -> np.ndarray:
    """Exhaustive division of at most 16 nodes."""
    n = len(a)
    if n > 16:
        raise ValueError("exhaustive division is for at most 16 nodes")
    options = (np.isin(np.arange(n), (0, *s)).astype(int) for r in range(n) for s in combinations(range(1, n), r))
    return max(options, key=lambda x: (round(dense_modularity(a, x), 12)))


def label_overlap(truth: np.ndarray, found: np.ndarray) -> float:
    """Share of nodes that lie in their found community's most frequent true one."""
    return sum(np.bincount(truth[found == c]).max() for c in np.unique(found)) / len(truth)


# Segmentation of ordered sentence vectors (doc_id, pos, vec).
def segment_costs(x: np.ndarray) -> np.ndarray:
    """cost[i, j]: length minus the length of the summed unit vectors of sentences i to j - 1."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    p = np.vstack([np.zeros(x.shape[1]), np.cumsum(unit, axis=0)])
    span = np.arange(len(p))[None, :] - np.arange(len(p))[:, None]
    return np.where(span > 0, span - np.linalg.norm(p[None, :, :] - p[:, None, :], axis=2), np.inf)


def best_segments(x: np.ndarray, k: int) -> list[int]:
    """Starts of the k segments of least summed cost; the lowest start wins ties."""
    n, cost = len(x), segment_costs(x)
    k = min(k, n)
    best, back = cost[0].copy(), []
    for _ in range(k - 1):
        total = np.round(best[:, None] + cost, 12)
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    cuts, at = [], n
    for step in reversed(back):
        at = int(step[at])
        cuts.append(at)
    return [0, *reversed(cuts)]


def segment(sentences: DataFrame, k: int) -> DataFrame:
    """(doc_id, segment, start, length): optimal segmentation of each document (its sentences are one group)."""

    def one(key, group):
        order = np.argsort(group.column("pos").to_numpy())
        x = np.array(group.column("vec").to_pylist(), float)[order]
        starts = best_segments(x, k)
        ends = [*starts[1:], len(x)]
        m = len(starts)
        return pa.table({"doc_id": pa.array([key[0].as_py()] * m, pa.int64()), "segment": pa.array(range(m), pa.int64()), "start": pa.array(starts, pa.int64()), "length": pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64())})

    return sentences.select("doc_id", "pos", "vec").groupBy("doc_id").applyInArrow(one, "doc_id bigint, segment bigint, start bigint, length bigint")


def gap_dissimilarity(sentences: DataFrame, window: int = 3) -> DataFrame:
    """(doc_id, pos, gap): 1 - cosine of the mean vectors of the ``window`` sentences before and from pos on."""
    wide = sentences.select("doc_id", "pos", F.posexplode("vec").alias("i", "x"))
    w = W.partitionBy("doc_id", "i").orderBy("pos")
    means = wide.withColumn("a", F.avg(F.col("x").cast("double")).over(w.rowsBetween(-window, -1))).withColumn("b", F.avg(F.col("x").cast("double")).over(w.rowsBetween(0, window - 1)))
    s = means.groupBy("doc_id", "pos").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.where("aa is not null").select("doc_id", "pos", F.when((F.col("aa") < 1e-24) | (F.col("bb") < 1e-24), 1.0).otherwise(1 - F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("gap"))


def fixed_boundaries(sentences: DataFrame, k: int) -> DataFrame:
    """(doc_id, pos): where k pieces of about equal length begin, the first left out; texts of fewer than k sentences have none."""
    size = sentences.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    at = F.explode(F.array(*[F.bround(F.col("n") * i / F.lit(float(k))).cast("bigint") for i in range(1, k)])) if k > 1 else None
    return size.select("doc_id", at.alias("pos")) if k > 1 else size.select("doc_id", F.col("n").alias("pos")).limit(0)


def greedy_boundaries(sentences: DataFrame, k: int, window: int = 3) -> DataFrame:
    """(doc_id, pos): the k - 1 highest gaps of each document."""
    r = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.round("gap", 9)), "pos"))
    return gap_dissimilarity(sentences, window).withColumn("r", r).where(F.col("r") < k).select("doc_id", "pos")


def boundary_f1(found: list[int], truth: list[int], tol: int = 1) -> float:
    """Boundaries match within tol, each true one once."""
    left, hit = sorted(truth), 0
    for b in sorted(found):
        near = [t for t in left if abs(t - b) <= tol]
        if near:
            left.remove(min(near, key=lambda t: (abs(t - b), t)))
            hit += 1
    p, r = hit / len(found) if found else 0.0, hit / len(truth) if truth else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0
