"""Factors of tall tables against numpy on the whole table."""

import numpy as np
import pytest

from ferrule import registry
from ferrule.operators import factor

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id long, vec array<double>").repartition(parts)


def test_singular_values_and_axes_of_the_whole_table(spark, whole):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet").selectExpr("vec_id as doc_id", "embedding as vec")
    mean, values, axes = factor.singular_axes(df.repartition(70))  # three rounds of the tree
    centred = whole - whole.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.abs(values - s).max() < 1e-9 and np.abs(mean - whole.mean(axis=0)).max() < 1e-12
    assert np.abs(np.abs((axes * v).sum(axis=1)) - 1).max() < 1e-9
    u = np.array([r["vec"] for r in factor.left_factors(df, mean, values, axes).orderBy("doc_id").collect()])
    assert np.abs(u @ np.diag(values) @ axes - centred).max() < 1e-9
    assert np.abs(u.T @ u - np.eye(len(values))).max() < 1e-9
    got = registry.QUERIES["singular_spectrum"](spark, FOLDER).collect()
    assert [r["singular_value"] for r in got] == pytest.approx(s.tolist(), abs=1e-6) and got[-1]["lost"] == 0


def test_ill_conditioned_tables_keep_their_small_values(spark):
    """A singular value 1e-10 of the largest is lost in second moments, not here."""
    rng = np.random.default_rng(2)
    u, v = np.linalg.qr(rng.normal(size=(300, 5)))[0], np.linalg.qr(rng.normal(size=(5, 5)))[0]
    s = np.array([1.0, 1e-2, 1e-5, 1e-8, 1e-10])
    _, values, _ = factor.singular_axes(table(spark, u * s @ v), centred=False)
    assert np.allclose(values, s, rtol=1e-4)


def test_few_rows_and_no_rows(spark):
    x = np.array([[1.0, 2.0, 3.0]])
    assert np.allclose(factor.tall_triangle(table(spark, x)), x)
    assert factor.tall_triangle(table(spark, x[:0])).shape == (0, 0)
    assert np.allclose(np.linalg.svd(factor.tall_triangle(table(spark, np.vstack([x] * 9), 12)))[1][0], np.linalg.norm(np.vstack([x] * 9)))


def test_prefix_losses_and_rotations(spark, whole):
    x = whole[:, :6]
    df, sizes, weights = table(spark, x), [1, 2, 4], [1.0, 0.5, 2.0]
    centred = x - x.mean(axis=0)
    losses = {r["size"]: r["loss"] for r in factor.prefix_losses(df, sizes).collect()}
    assert losses == pytest.approx({m: float((centred[:, m:] ** 2).sum()) for m in sizes})

    def joint(turn):
        y = centred @ turn.T
        return sum(w * ((centred - y[:, :m] @ turn[:m]) ** 2).sum() for m, w in zip(sizes, weights, strict=True))

    _, turn, (before, after) = factor.nested_rotation(df, sizes, weights)
    assert before == pytest.approx(joint(np.eye(6))) and after == pytest.approx(joint(turn)) and np.allclose(turn @ turn.T, np.eye(6))
    _, jacobi, history = factor.nested_rotation(df, sizes, weights, steps=6)
    assert history == sorted(history, reverse=True) and history[-1] == pytest.approx(joint(jacobi))
    assert history[-1] == pytest.approx(after, rel=1e-6)
    for seed in range(20):  # no other rotation is better
        assert joint(np.linalg.qr(np.random.default_rng(seed).normal(size=(6, 6)))[0]) >= after - 1e-9


def test_queries_of_the_module_equal_numpy(spark, whole):
    centred = whole - whole.mean(axis=0)
    r = {row["axes"]: row["loss"] for row in registry.QUERIES["nested_rotation"](spark, FOLDER).collect()}
    s = np.linalg.svd(centred, compute_uv=False)
    assert r["best axes"] == pytest.approx(sum(w * (s[m:] ** 2).sum() for m, w in zip([8, 16, 32], [1, 0.5, 0.25], strict=True)), abs=1e-5)
    assert r["as given"] > r["turned once"] > r["turned twice"] >= r["best axes"] - 1e-6
    rows = {row["k"]: row for row in registry.QUERIES["projection_distortion"](spark, FOLDER).collect()}
    assert 0 <= rows[4]["least"] <= rows[4]["mean"] < rows[16]["mean"] < rows[32]["mean"] <= rows[32]["greatest"] <= 1
