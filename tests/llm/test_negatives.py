"""Hard negatives against brute force: ties, copies, several dimensions, windows, and trees of every depth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, score string, win long, anchor string"


def brute_force(rows, every, positives=5, k=5, low=80, high=100, scale=256):
    known = {}
    for vec_id, label, e in rows:
        if vec_id is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = (label, [math.floor(scale * x) for x in e])
        known[vec_id] = min(known.get(vec_id, row), row)
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, m == label) for b, (m, w) in known.items() if b != a and len(w) == len(v))
        for s, p, _ in [r for r in ranked if r[2]][:positives]:
            inside = [(n, b) for n, b, own in ranked if not own and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, i + 1, b, -s, -n) for i, (n, b) in enumerate(inside[:k])]
    return sorted(out)


def hostile(seed, n=400, dims=6):
    """Few values, so scores tie; groups of copies over labels; nulls and rows of other dimensions."""
    dice = np.random.default_rng(seed)
    rows = [(i, int(dice.integers(4)), (dice.integers(-3, 4, dims) / 8).tolist()) for i in range(n)]
    hot = rows[3][2]
    rows += [(n + i, 1, hot) for i in range(n // 2)] + [(2 * n + i, 2, hot) for i in range(20)]
    rows += [(3 * n + i, i % 3, (dice.integers(1, 9, 3) / 16).tolist()) for i in range(60)]
    rows += [(3 * n + 100, 1, []), (3 * n + 101, 2, []), (3 * n + 110, 1, [0.0] * dims), (3 * n + 120, 2, [float("nan")] * dims), (3 * n + 130, 2, [float("inf")] + [1.0] * (dims - 1))]
    return [*rows, (3 * n + 140, None, hot), (3 * n + 150, 1, None), (None, 1, hot), (3 * n + 160, 1, [None] * dims), rows[0], rows[10], (10, 3, hot)]


def found(spark, rows, every, **more):
    df = spark.createDataFrame([(*r, "s", 1, "a") for r in rows], SCHEMA)
    got = negatives.mine_hard_negatives(df, F.col("vec_id") % every == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("leaves", [None, 7])
def test_against_brute_force(spark, leaves):
    rows = hostile(4)
    want = brute_force(rows, 10)
    assert want
    assert found(spark, rows, 10, leaves=leaves) == want


def test_other_windows_and_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 2048)  # many blocks a leaf
    monkeypatch.setattr(negatives, "ASKED", 3)  # many parts a block
    rows = hostile(5, n=500)
    assert found(spark, rows, 20, positives=3, k=2, low=20, high=95, leaves=3) == brute_force(rows, 20, 3, 2, 20, 95)


def test_nothing_to_find(spark):
    assert found(spark, [], 10) == []
    assert found(spark, [(1, 1, [1.0]), (2, 2, [1.0])], 10) == []
    assert found(spark, [(10, 1, [1.0]), (2, 2, [1.0])], 10) == []  # no positive
    assert found(spark, [(10, 1, [1.0]), (2, 1, [-1.0]), (3, 2, [-0.9])], 10) == []  # no window below zero
    assert found(spark, [(10, 1, [1.0]), (2, 1, [0.0]), (3, 2, [0.0])], 10) == [(10, 2, 1, 3, 0, 0)]


def test_large_components_are_exact():
    q = np.array([(1 << 30) + 1, 3, 5], np.int64)
    x = np.array([[(1 << 30) + 7, 1, 1], [1, 1, 1]], np.int64)
    assert negatives._product(x, q[None, :])(slice(None), slice(None)).tolist() == [[int(a) for a in (x.astype(object) @ q.astype(object))]]
    with pytest.raises(OverflowError):
        negatives._product(x << 5, q[None, :] << 5)


def test_bounds_hold_for_every_member():
    """No member of a leaf has a score outside what the tree says of its leaf; few leaves are visited for near neighbours."""
    dice = np.random.default_rng(1)
    centres = dice.normal(size=(12, 16))
    x = np.floor(64 * (centres[dice.integers(12, size=3000)] + 0.05 * dice.normal(size=(3000, 16)))).astype(np.int64)
    most = float((x * x).sum(axis=1).max())
    tree = negatives.grow(x[:800].astype(float), most, 32)
    leaf, way = negatives.deal(tree, x.astype(float), most)
    above = negatives.ways(tree)
    q = x[:40].astype(float)
    q2 = (q * q).sum(axis=1)
    touched = 0
    for j in np.unique(leaf):
        members = np.flatnonzero(leaf == j)
        steps = np.stack([way[m] for m in members])
        v = np.array(above[int(j)])
        low, top = negatives._reach(q2, np.sqrt(np.maximum(q2[:, None] + most - 2 * q @ v.T, 0)), steps.min(axis=0), steps.max(axis=0), most)
        scores = q @ x[members].T.astype(float)
        assert (scores <= top[:, None]).all() and (scores >= low[:, None]).all()
        touched += (top >= np.sort(q @ x.T.astype(float), axis=1)[:, -6]).sum()
    assert touched < 0.6 * 40 * len(np.unique(leaf))
