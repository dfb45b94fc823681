"""Pivots: their number, and the share of near pairs that meet in a list whatever it is."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import embeddings


def test_pivots_do_not_grow_with_the_table(spark):
    ids = spark.range(70_000).select(F.col("id").alias("rep"))
    reps = ids.select("rep", F.array(*(F.rand(i) - 0.5 for i in range(8))).alias("embedding"))
    assert {d: len(v) for d, v in embeddings.choose_pivots(reps).items()} == {8: 512}


def test_pivots_grow_with_the_root_of_large_tables():
    assert [embeddings.pivots_for(n) for n in (0, 70_000, 1 << 18, 1 << 20, 1 << 22, 1 << 40)] == [512, 512, 1024, 2048, 4096, 16_384]


def pairs_at(cosine, n, d, rng):
    x, away = rng.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * away


@pytest.mark.parametrize("d", [64, 256, 768])
@pytest.mark.parametrize("size", [512, 4096, 16_384])
def test_recall_at_the_threshold(d, size):
    rng = np.random.default_rng(d + size)
    x, y = pairs_at(0.95, 1000, d, rng)
    pivots = embeddings._unit(rng.normal(size=(size, d)))
    a, b = (embeddings.list_keys(embeddings.ordered_pivots(v, pivots)) for v in (x, y))
    unlike = np.unpackbits((embeddings._signs(x) ^ embeddings._signs(y)).view(np.uint8), axis=1).sum(axis=1)
    met = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)) & (unlike <= embeddings.most_unlike(0.95))
    assert met.mean() >= 0.9


def test_recall_through_the_operator(spark):
    rng = np.random.default_rng(3)
    x, y = pairs_at(0.951, 1500, 64, rng)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))] + [(5000, [1.0] * 3), (5001, [1.0, 1.0, 1.01]), (5002, [2.0]), (5003, [-1.0]), (5004, [0.0, -0.0]), (None, [2.0])]
    got = {r["vec_id"]: r for r in embeddings.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i]["component_id"] == got[i + 1500]["component_id"] for i in range(1500)) >= 0.95 * 1500
    assert got[5001]["component_id"] == 5000 and got[5003]["n_links"] == got[5002]["n_links"] == got[5004]["n_links"] == got[None]["n_links"] == 0


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LIST", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(0, 0.08, 64)).tolist()) for i in range(300)]
    got = {r["vec_id"]: tuple(r)[1:3] for r in embeddings.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert got == {i: (int((v[i] @ v.T >= 0.95).sum()) - 1, 0) for i in range(300)}


def test_many_pivots_of_many_dimensions_take_little_memory():
    """Growth of a process that orders 16,384 pivots of 768 dimensions for 4096 vectors, beside the pivots themselves."""
    code = """
import resource, numpy as np
from ferrule.llm import embeddings
rng = np.random.default_rng(1)
pivots = rng.normal(size=(16_384, 768)).astype(np.float32)
x = rng.normal(size=(4096, 768))
embeddings.ordered_pivots(x[:8], pivots)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
near = embeddings.ordered_pivots(x, pivots)
assert near.shape == (4096, embeddings.NEAREST)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 100


def test_pivots_of_all_dimensions_are_bounded(spark, monkeypatch):
    """Dimensions beyond the bound get no pivots of their own, and their vectors are still linked."""
    monkeypatch.setattr(embeddings, "PIVOT_BYTES", 512 * 6 * 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(100 + i, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [(200, rows[0][1]), (201, [x * 1.001 for x in rows[45][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(embeddings.choose_pivots(df.selectExpr("vec_id as rep", "embedding"))) == {6}
    got = {r["vec_id"]: r for r in embeddings.embedding_near_duplicates(df).collect()}
    assert got[200]["component_id"] == 0 and got[201]["component_id"] == 105 and got[105]["n_links"] >= 1
