"""Hard negatives by vantage-point trees over norm-augmented vectors.

A row x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared
norm, so all rows have one length; with an anchor q (whose further coordinate
is 0) the distance is |q|^2 + M - 2 q.x, and the highest inner product is the
nearest neighbour. A window of scores is an annulus around the anchor.

The space is cut twice. A tree grown on a bounded sample has at most LEAVES
leaves and deals the rows to leaves; the rows of a leaf lie in blocks of bounded
size, each with a vantage-point tree of its own, built once. What a tree knows
are the least and greatest distance of a leaf's members from each vantage point
above it, and from these the least and greatest score an anchor can meet there.

Anchors first ask the leaf that may hold their best score. What they find there
bounds where better rows can be, and only the leaves that reach into the
remaining annulus are asked next. In a block the leaves are visited nearest
first, until the k-th row found is better than any that is left.

Rows that share label and vector are one entry with the least ids that any
answer could name, and anchors that share them ask once, so groups of copies
cost what one row costs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, join_dealt, release

#: Most leaves of the tree of a dimension, and most dimensions with a tree.
LEAVES, DIMENSIONS = 1024, 64
#: Most bytes of vectors in a block and of the sample the trees are grown on, and most anchors that meet a block at once.
BLOCK_BYTES, SAMPLE_BYTES, ASKED = 4 << 20, 32 << 20, 8192
#: Members of a block's leaf.
MEMBERS = 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Node:
    """A split: members within ``radius`` of the vantage point go left."""

    vantage: np.ndarray
    radius: float
    left: Node | int
    right: Node | int


def whole_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v has floor(scale * x) of every component.

    Null ids, labels, vectors and null or non-finite components take no part.
    Of rows with one vec_id the one with the smallest label and vector is kept.
    """
    bounded_batches(vectors.sparkSession)
    e = F.col("embedding").cast("array<double>")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), e.alias("e")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(scale))).alias("v"))
    twice = cut(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if twice.isEmpty():
        return rows
    one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    return rows.join(twice, "vec_id", "left_anti").unionByName(one)


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """(label, v, ids): one row for each label and vector, with its ``keep`` least ids; no answer of at most that many rows can name another."""
    least = rows.withColumn("_at", F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))).where(F.col("_at") <= keep)
    return least.groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _norm2(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _apart(x: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Distances of augmented rows from the augmented points ``v``."""
    a, b = _norm2(x), _norm2(v)
    up = np.sqrt(np.maximum(most - a, 0))[:, None] - np.sqrt(np.maximum(most - b, 0))[None, :]
    return np.sqrt(np.maximum(a[:, None] + b[None, :] - 2 * (x @ v.T) + up * up, 0))


def grow(x: np.ndarray, most: float, leaves: int) -> Node | int:
    """A tree with at most ``leaves`` leaves (numbered from 0) over sample rows; medians split, so leaves hold about as many."""
    made = iter(range(leaves))
    dice = np.random.default_rng(7)

    def split(rows: np.ndarray, parts: int):
        if parts > 1 and len(rows) > 2:
            v = x[rows[dice.integers(len(rows))]]
            d = _apart(x[rows], v[None, :], most)[:, 0]
            radius = float(np.median(d))
            low = d <= radius
            if 0 < low.sum() < len(rows):
                return Node(v, radius, split(rows[low], parts // 2), split(rows[~low], parts - parts // 2))
        return next(made)

    return split(np.arange(len(x)), leaves)


def deal(tree: Node | int, x: np.ndarray, most: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each row its leaf and its distances from the vantage points on the way there."""
    leaf, way = np.zeros(len(x), np.int32), [np.empty(0)] * len(x)

    def go(node, rows, before):
        if isinstance(node, int):
            leaf[rows] = node
            for i, r in enumerate(rows.tolist()):
                way[r] = before[i]
            return
        d = _apart(x[rows], node.vantage[None, :], most)
        low = d[:, 0] <= node.radius
        before = np.hstack([before, d])
        go(node.left, rows[low], before[low])
        go(node.right, rows[~low], before[~low])

    go(tree, np.arange(len(x)), np.empty((len(x), 0)))
    return leaf, way


def ways(tree: Node | int, before: tuple = ()) -> dict[int, tuple]:
    """Of each leaf the vantage points above it."""
    if isinstance(tree, int):
        return {tree: before}
    return ways(tree.left, (*before, tree.vantage)) | ways(tree.right, (*before, tree.vantage))


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


class Index:
    """The entries in blocks with their trees, as written, and what is known of each leaf of the upper trees."""

    def __init__(self, reps: DataFrame, leaves: int | None = None):
        size = F.size("v")
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        self.most = float(reps.agg(F.coalesce(F.max(norm), F.lit(0.0))).first()[0]) * (1 + 1e-12)
        dims = reps.groupBy(size.alias("dim")).count().orderBy(F.desc("count"), "dim").limit(DIMENSIONS).collect()
        plan = []
        for r in dims:
            block = max(MEMBERS, BLOCK_BYTES // (8 * max(1, r["dim"])))
            parts = leaves or max(1, min(LEAVES, 1 << math.ceil(math.log2(max(1.0, r["count"] / block)))))
            wanted = min(16 * parts, SAMPLE_BYTES // len(dims) // (8 * max(1, r["dim"])))
            plan.append((r["dim"], parts, min(1.0, wanted / r["count"]) * float(1 << 63)))
        self.trees: dict[int, Node | int] = {}
        if any(parts > 1 for _, parts, _ in plan):
            bounds = reps.sparkSession.createDataFrame([(d, b) for d, parts, b in plan if parts > 1], "dim int, bound double")
            sample = reps.withColumn("dim", size).join(F.broadcast(bounds), "dim").where(F.shiftrightunsigned(F.xxhash64("v", "label"), 1) <= F.col("bound")).select("dim", "v").toArrow()
            of = np.asarray(sample["dim"])
            for d, parts, _ in plan:
                if d and parts > 1 and (of == d).any():
                    x = _vectors(sample["v"].filter(pa.array(of == d))).astype(float)
                    self.trees[d] = grow(x[np.lexsort(x.T[::-1])], self.most, parts)
        self.blocks = self._written(reps)
        self.leaves = self._known()

    def _written(self, reps: DataFrame) -> DataFrame:
        trees, most = self.trees, self.most

        def dealt(batches):
            for batch in batches:
                size = np.diff(np.asarray(batch.column(1).offsets))
                leaf, way = np.zeros(batch.num_rows, np.int32), [np.empty(0)] * batch.num_rows
                for d in np.unique(size).tolist():
                    if d in trees:
                        at = np.flatnonzero(size == d)
                        leaf[at], own = deal(trees[d], _vectors(batch.column(1).take(pa.array(at))).astype(float), most)
                        for i, w in zip(at.tolist(), own, strict=True):
                            way[i] = w
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(way, pa.list_(pa.float64()))], names=["label", "v", "ids", "leaf", "way"])

        rows = cut(reps.select("label", "v", "ids").mapInArrow(dealt, "label bigint, v array<bigint>, ids array<bigint>, leaf int, way array<double>").withColumn("dim", F.size("v")))
        # a leaf's rows are dealt to blocks by hash; leaves are few (bounded), so their counts go to every task
        room = F.greatest(F.lit(MEMBERS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.lit(1), F.col("dim")))))
        counts = rows.groupBy("dim", "leaf").count().select("dim", "leaf", F.ceil(F.col("count") / room).cast("int").alias("blocks"))
        rows = rows.join(counts, ["dim", "leaf"]).withColumn("block", F.expr("cast(pmod(xxhash64(label, v), blocks) as int)"))
        schema = "dim int, leaf int, block int, blocks int, n int, v binary, label binary, held array<array<bigint>>, starts array<int>, vantage array<array<int>>, least array<array<double>>, greatest array<array<double>>, near array<double>, far array<double>"
        return cut(rows.select("dim", "leaf", "block", "blocks", "label", "v", "ids", "way").groupBy("dim", "leaf", "block").applyInArrow(lambda t: _block(t, most), schema))

    def _known(self) -> dict[tuple[int, int], tuple]:
        """(blocks, least and greatest distances on the way) of each leaf."""
        found: dict[tuple[int, int], tuple] = {}
        pairs = self.blocks.select("dim", "leaf", "blocks", F.posexplode_outer(F.arrays_zip("near", "far")).alias("at", "d"))
        for r in pairs.groupBy("dim", "leaf", "blocks", "at").agg(F.min("d.near").alias("near"), F.max("d.far").alias("far")).where(F.col("dim").isin(list(self.trees))).orderBy("dim", "leaf", "at").collect():
            old = found.get((r["dim"], r["leaf"]), (r["blocks"], [], []))
            found[r["dim"], r["leaf"]] = (r["blocks"], [*old[1], r["near"]], [*old[2], r["far"]]) if r["at"] is not None else old
        return found


def _block(rows: pa.Table, most: float) -> pa.Table:
    """One row: the members of a block in the order of its tree's leaves, and the tree."""
    x = _vectors(rows["v"])
    order = np.lexsort([*x.T[::-1], np.asarray(rows["label"])]) if x.shape[1] else np.argsort(np.asarray(rows["label"]), kind="stable")
    x = x[order]
    y = x.astype(float)
    dice = np.random.default_rng(11)
    parts: list[tuple[np.ndarray, tuple]] = []

    def split(members: np.ndarray, above: tuple) -> None:
        if len(members) > MEMBERS:
            v = members[dice.integers(len(members))]
            d = _apart(y[members], y[v][None, :], most)[:, 0]
            low = d <= np.median(d)
            if 0 < low.sum() < len(members):
                split(members[low], (*above, v))
                split(members[~low], (*above, v))
                return
        parts.append((members, above))

    split(np.arange(len(x)), ())
    turned = np.concatenate([m for m, _ in parts])
    place = np.empty(len(x), np.int64)
    place[turned] = np.arange(len(x))
    apart = [_apart(y[m], y[list(a)], most) if a else np.empty((len(m), 0)) for m, a in parts]
    way = rows["way"].combine_chunks()
    steps = np.asarray(way.flatten()).reshape(len(x), -1) if len(x) else np.empty((0, 0))
    first = rows.slice(0, 1)
    made = {
        "dim": first["dim"], "leaf": first["leaf"], "block": first["block"], "blocks": first["blocks"], "n": [len(x)],
        "v": [x[turned].tobytes()], "label": [np.asarray(rows["label"])[order][turned].astype(np.int64).tobytes()],
        "held": [rows["ids"].combine_chunks().take(pa.array(order[turned])).to_pylist()],
        "starts": [np.concatenate([[0], np.cumsum([len(m) for m, _ in parts])]).tolist()],
        "vantage": [[place[list(a)].tolist() for _, a in parts]],
        "least": [[d.min(axis=0).tolist() for d in apart]], "greatest": [[d.max(axis=0).tolist() for d in apart]],
        "near": [steps.min(axis=0).tolist()], "far": [steps.max(axis=0).tolist()],
    }
    kinds = {"n": pa.int32(), "v": pa.binary(), "label": pa.binary(), "held": pa.list_(pa.list_(pa.int64())), "starts": pa.list_(pa.int32()), "vantage": pa.list_(pa.list_(pa.int32())), "near": pa.list_(pa.float64()), "far": pa.list_(pa.float64())}
    kinds |= dict.fromkeys(("least", "greatest"), pa.list_(pa.list_(pa.float64())))
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, kinds[n]) for n, c in made.items()], names=list(made))


def _reach(q2: np.ndarray, d: np.ndarray, least: np.ndarray, greatest: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that members can have whose distances from vantage points lie in the given bounds; d are the anchors' distances from these points."""
    slack = 1e-6 * np.sqrt(most + q2)[:, None] + 1e-9
    if d.shape[1]:
        near = np.maximum(np.maximum(d - greatest, least - d).max(axis=1)[:, None] - slack, 0)
        far = (d + greatest).min(axis=1)[:, None] + slack
    else:
        near, far = np.zeros((len(d), 1)), np.full((len(d), 1), np.inf)
    return ((q2 + most)[:, None] - far * far)[:, 0] / 2 - 0.5, ((q2 + most)[:, None] - near * near)[:, 0] / 2 + 0.5


_ASKED = "anchor bigint, win bigint, label bigint, v array<bigint>, lo bigint, hi bigint, kth bigint"
_NAMES = ["anchor", "win", "label", "v", "lo", "hi", "kth"]


def _routed(asked: DataFrame, index: Index, best: bool) -> DataFrame:
    """``asked`` with the blocks to ask: those of the leaf that may hold the best score in the window, or those of all others that may hold one as good as kth."""
    trees, leaves, most = index.trees, index.leaves, index.most
    known = {d: [(leaf, *leaves[d, leaf], np.array(above)) for leaf, above in ways(tree).items() if (d, leaf) in leaves] for d, tree in trees.items()}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.diff(np.asarray(batch.column(3).offsets))
            lo, hi, kth = (np.asarray(batch.column(i).fill_null(_LEAST)).astype(float) for i in (4, 5, 6))
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                if d not in known:  # one leaf
                    if best:
                        yield _sent(batch, at, np.zeros(len(at), np.int32), None)
                    continue
                q = _vectors(batch.column(3).take(pa.array(at))).astype(float)
                q2 = _norm2(q)
                tops, alive = np.empty((len(at), len(known[d]))), np.empty((len(at), len(known[d])), bool)
                for j, (_, _, near, far, above) in enumerate(known[d]):
                    apart = np.sqrt(np.maximum(q2[:, None] + most - 2 * (q @ above.T), 0)) if len(above) else np.empty((len(q), 0))
                    low, top = _reach(q2, apart, np.array(near), np.array(far), most)
                    alive[:, j] = (low <= hi[at]) & (top >= np.maximum(lo[at], kth[at]))
                    tops[:, j] = np.where((low <= hi[at]) & (top >= lo[at]), np.minimum(top, hi[at]), -np.inf)
                first = tops.argmax(axis=1)
                for j, (leaf, blocks, *_) in enumerate(known[d]):
                    own = np.flatnonzero((first == j) & (tops[:, j] > -np.inf) if best else alive[:, j] & (first != j))
                    if len(own):
                        yield _sent(batch, at[own], np.full(len(own), leaf, np.int32), blocks)
        release()

    found = asked.select(_NAMES).mapInArrow(run, _ASKED + ", dim int, leaf int, blocks int")
    # a dimension without a tree has one leaf, whose number of blocks Spark looks up
    rest = index.blocks.where(~F.col("dim").isin(list(trees))).select("dim", F.col("blocks").alias("own")).distinct()
    found = found.join(rest, "dim", "left").withColumn("blocks", F.coalesce("blocks", "own")).drop("own")
    return found.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")


def _sent(batch: pa.RecordBatch, at: np.ndarray, leaf: np.ndarray, blocks: int | None) -> pa.RecordBatch:
    part = batch.take(pa.array(at))
    size = pa.array(np.diff(np.asarray(part.column(3).offsets)).astype(np.int32))
    return pa.RecordBatch.from_arrays([*part.columns, size, pa.array(leaf), pa.array([blocks] * len(at), pa.int32())], names=[*_NAMES, "dim", "leaf", "blocks"])


def _product(x: np.ndarray, q: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Exact inner products of rows of whole vectors: by floating point while it can't round, else by integers."""
    bound = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * x.shape[1]
    if bound < 1 << 53:
        y, z = q.astype(float), x.astype(float)
        return lambda some, part: (y[some] @ z[part].T).astype(np.int64)
    if bound > _MOST:
        raise OverflowError("inner products may pass 64 bits")
    return lambda some, part: q[some] @ x[part].T


@dataclass
class Search:
    """Asked rows that meet one block: the vector each has (``which`` of q), its label, window and bound, and what the tree says of each leaf."""

    q: np.ndarray
    which: np.ndarray
    label: np.ndarray
    floor: np.ndarray
    hi: np.ndarray
    low: np.ndarray
    top: np.ndarray


def nearest_first(block: dict, ask: Search, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked row, score, id): of each asked row the first k wanted members with a score from floor to hi.

    Every row goes through the leaves by the greatest score they can hold in its
    window, one, two, four, ... at a time, and ends where no leaf left can hold
    one as good as its k-th. Rows that are at the same leaf take it together.
    """
    product = _product(block["v"], ask.q)
    floor = ask.floor.copy()
    reach = (ask.low <= ask.hi[:, None]) & (ask.top >= floor[:, None])
    turn = np.argsort(np.argsort(np.where(reach, -np.minimum(ask.top, ask.hi[:, None]), np.inf), axis=1, kind="stable"), axis=1, kind="stable")
    who, score, name = (np.empty(0, np.int64) for _ in range(3))
    at, step = 0, 1
    while at < turn.shape[1]:
        need = reach & (turn >= at) & (turn < at + step) & (ask.top >= floor[:, None])
        found = []
        for j in np.flatnonzero(need.any(axis=0)).tolist():
            rows = np.flatnonzero(need[:, j])
            part = slice(block["starts"][j], block["starts"][j + 1])
            some, back = np.unique(ask.which[rows], return_inverse=True)
            s = product(some, part)[back]
            good = (s >= floor[rows, None]) & (s <= ask.hi[rows, None]) & ((block["label"][part][None, :] == ask.label[rows, None]) == same)
            i, m = np.nonzero(good)
            found.append((rows[i], s[i, m], m + part.start))
        if found:
            row, value, member = (np.concatenate(c) for c in zip(*found, strict=True))
            held = block["held"][member]
            there = np.arange(held.shape[1])[None, :] < block["holds"][member][:, None]
            times = block["holds"][member]
            who, score, name = np.append(who, np.repeat(row, times)), np.append(score, np.repeat(value, times)), np.append(name, held[there])
            order = np.lexsort((name, -score, who))
            who, score, name = who[order], score[order], name[order]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            who, score, name, place = (c[place < k] for c in (who, score, name, place))
            last = place == k - 1
            floor[who[last]] = np.maximum(floor[who[last]], score[last])
        at, step = at + step, 2 * step
    return who, score, name


def _answers(asked: pa.Table, blocks: pa.Table, same: bool, k: int, most: float) -> pa.Table:
    found: list[tuple] = []
    if asked.num_rows and blocks.num_rows:
        row = blocks.slice(0, 1).to_pylist()[0]
        n = row["n"]
        holds = np.array([len(h) for h in row["held"]])
        held = np.zeros((n, max(1, int(holds.max()))), np.int64)
        held[np.arange(held.shape[1])[None, :] < holds[:, None]] = np.concatenate(row["held"])
        block = {"v": np.frombuffer(row["v"], np.int64).reshape(n, -1), "label": np.frombuffer(row["label"], np.int64), "starts": row["starts"], "held": held, "holds": holds}
        points = sorted({p for above in row["vantage"] for p in above})
        column = {p: i for i, p in enumerate(points)}
        bounds = [([column[p] for p in a], np.array(s), np.array(g)) for a, s, g in zip(row["vantage"], row["least"], row["greatest"], strict=True)]
        anchors, wins = np.asarray(asked["anchor"]), np.asarray(asked["win"])
        _, one, which = np.unique(anchors, return_index=True, return_inverse=True)
        q = _vectors(asked["v"].take(pa.array(one)))
        y = q.astype(float)
        q2 = _norm2(y)
        apart = np.sqrt(np.maximum(q2[:, None] + most - 2 * (y @ block["v"][points].astype(float).T), 0)) if points else np.empty((len(q), 0))
        low, top = (np.stack(c, axis=1) for c in zip(*(_reach(q2, apart[:, a], s, g, most) for a, s, g in bounds), strict=True))
        label, hi = np.asarray(asked["label"]), np.asarray(asked["hi"])
        floor = np.maximum(np.asarray(asked["lo"]), np.asarray(asked["kth"].fill_null(_LEAST)))
        for at in range(0, len(which), 1024):
            p = slice(at, at + 1024)
            i, score, name = nearest_first(block, Search(q, which[p], label[p], floor[p], hi[p], low[which[p]], top[which[p]]), same, k)
            found.append((anchors[p][i], wins[p][i], score, name))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.empty(0, np.int64)] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "win", "score", "id"])


def _ask(routed: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """What the blocks answer. Anchors that meet one block are dealt in parts of at most ASKED, the block goes to each part."""
    keys, most = ["dim", "leaf", "block"], index.most
    rows = cut(routed)
    counts = rows.groupBy(keys).count().withColumn("parts", F.ceil(F.col("count") / ASKED).cast("int")).drop("count")
    dealt = rows.join(counts, keys).withColumn("part", F.expr("cast(pmod(xxhash64(anchor, win), parts) as int)")).drop("parts")
    blocks = index.blocks.join(counts, keys).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    keys = [*keys, "part"]
    return dealt.groupBy(keys).cogroup(blocks.groupBy(keys)).applyInArrow(lambda a, b: _answers(a, b, same, k, most), "anchor bigint, win bigint, score bigint, id bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)


def best_scores(asked: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """(anchor, win, score, id, at): of each asked row the first k rows of the same label (or of all others) with a score in [lo, hi], by score and then id."""
    asked = cut(asked)
    near = cut(_first(_ask(_routed(asked.withColumn("kth", F.lit(None).cast("bigint")), index, True), index, same, k), k))
    bound = near.where(F.col("at") == k).select("anchor", "win", F.col("score").alias("kth"))
    rest = _ask(_routed(asked.join(bound, ["anchor", "win"], "left"), index, False), index, same, k)
    return cut(_first(near.select("anchor", "win", "score", "id").unionByName(rest), k))


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, leaves: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows of ``vectors`` (vec_id, label, embedding).

    Every component x becomes floor(scale * x) and a score is the inner product
    with the anchor, an exact 64-bit integer (larger ones are an error); higher
    scores come first, ties by smaller vec_id. An anchor (``is_anchor`` over
    vec_id) has as positives its first rows of the same label, and for each the
    first k rows of other labels with low * positive <= 100 * negative <= high *
    positive. Only vectors of one dimension meet.

    Rows with a null id, label or vector or a null or non-finite component take
    no part; of rows with one vec_id the one with the smallest label and vector
    does; empty vectors have the score 0. Further columns are not looked at, an
    empty table or one without anchors gives no rows.

    Bounded: the sample of the upper tree (SAMPLE_BYTES) and LEAVES * DIMENSIONS
    leaf summaries on the driver; a block (BLOCK_BYTES) and ASKED anchors in a
    task. Anchors of equal label and vector ask once.
    """
    rows = cut(whole_vectors(vectors, scale))
    anchors = rows.where(is_anchor)
    index = Index(cut(entries(rows, max(positives + 1, k))), leaves)
    groups = cut(anchors.groupBy("label", "v").agg(F.min("vec_id").alias("anchor"), F.count("*").alias("n")))
    bounds = [F.lit(_LEAST).alias("lo"), F.lit(_MOST).alias("hi")]
    near = best_scores(groups.select("anchor", F.lit(0).cast("bigint").alias("win"), "label", "v", *bounds), index, True, positives + 1)
    # the window of scores: ceil(low * p / 100) to floor(high * p / 100)
    windows = near.select("anchor", F.col("score").alias("win")).distinct()
    windows = windows.withColumn("lo", F.expr(f"-((-{low} * win - pmod(-{low} * win, 100)) div 100)")).withColumn("hi", F.expr(f"({high} * win - pmod({high} * win, 100)) div 100")).where("lo <= hi")
    asked = windows.join(groups.select("anchor", "label", "v"), "anchor").select("anchor", "win", "label", "v", "lo", "hi")
    far = best_scores(asked, index, False, k)
    ranked = far.groupBy("anchor", "win").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score"))).alias("list")).groupBy("anchor").agg(F.collect_list(F.struct("win", "list")).alias("negatives"))
    firsts = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score"))).alias("positives"))
    results = cut(groups.join(firsts, "anchor").join(ranked, "anchor").select("label", "v", "n", "positives", "negatives"))
    each = join_dealt(anchors.select("vec_id", "label", "v"), results, ["label", "v"], ["vec_id"]).select("vec_id", "positives", "negatives")
    own = each.select(F.col("vec_id").alias("anchor_id"), "negatives", F.explode(F.slice(F.filter("positives", lambda p: p["id"] != F.col("vec_id")), 1, positives)).alias("p"))
    lists = F.expr("get(filter(negatives, x -> x.win = p.score), 0).list")
    out = own.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode(lists).alias("m"))
    return out.select("anchor_id", "positive_id", F.col("m.at").cast("int").alias("rank"), F.col("m.id").alias("negative_id"), "positive_score", F.col("m.score").alias("negative_score"))
