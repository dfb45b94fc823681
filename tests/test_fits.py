"""Fits by summed gradients: against finite differences, plain numpy and optimality on whole tables."""

import numpy as np
import pytest

from ferrule import registry
from ferrule.operators import fits

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    return np.array([r["embedding"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()], np.float64)


def test_logistic_is_optimal_and_ratios_are_of_densities(spark):
    rng = np.random.default_rng(1)
    x0, x1 = rng.normal(size=(3000, 1)), rng.normal(0.5, 1.0, size=(1000, 1))
    df = lambda x: spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(5)
    w, share = fits.density_ratio(df(x0), df(x1), ridge=1e-9)
    x, y = np.vstack([x0, x1]), np.repeat([0.0, 1.0], [3000, 1000])
    z = np.hstack([x, np.ones((4000, 1))])
    assert np.abs(z.T @ (y - 1 / (1 + np.exp(-z @ w)))).max() < 1e-5 and share == 3
    # of two normals a half apart the log ratio is x / 2 - 1 / 8
    assert w[0] == pytest.approx(0.5, abs=0.1) and w[1] + np.log(3) == pytest.approx(-0.125, abs=0.1)
    got = df(x0[:5]).select(fits.ratio_of("x", w, share).alias("r")).collect()
    assert sorted(r["r"] for r in got) == pytest.approx(sorted((3 * np.exp(x0[:5] @ w[:1] + w[1])).tolist()))
    assert fits.fit_logistic(spark.createDataFrame([], "x array<double>, y int")).tolist() == [0.0]


@pytest.mark.parametrize("kind", ["permutation", "top_one"])
def test_list_moments_against_finite_differences(kind):
    rng = np.random.default_rng(2)
    x, gains, w = rng.normal(size=(7, 3)), np.array([7.0, 3, 3, 1, 0, 0, 0]), rng.normal(size=3)
    f, g, h = fits.list_moments(x, gains, w, kind)
    for i in range(3):
        e = 1e-6 * np.eye(3)[i]
        up, down = fits.list_moments(x, gains, w + e, kind), fits.list_moments(x, gains, w - e, kind)
        assert (up[0] - down[0]) / 2e-6 == pytest.approx(g[i], abs=1e-6)
        assert (up[1] - down[1]) / 2e-6 == pytest.approx(h[i], abs=1e-6)
    s = x @ w
    brute = sum(np.log(np.exp(s[i:]).sum()) - s[i] for i in range(7)) if kind == "permutation" else -(np.exp(gains) / np.exp(gains).sum() * (s - np.log(np.exp(s).sum()))).sum()
    assert f == pytest.approx(brute)


@pytest.mark.parametrize("kind", ["permutation", "top_one"])
def test_newton_fit_of_all_lists_is_optimal(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(q, i, int(rng.integers(4)), rng.normal(size=2).tolist()) for q in range(40) for i in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame(rows, "qid long, doc_id long, grade int, x array<double>").repartition(6)
    w, history = fits.fit_listwise_newton(df, 2, kind, ridge=1e-2)
    total = np.zeros(2)
    for q in range(40):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        total += fits.list_moments(np.array([r[3] for r in own]), np.array([2.0 ** r[2] - 1 for r in own]), np.array(w), kind)[1]
    assert np.abs(total / 40 + 1e-2 * np.array(w)).max() < 1e-8
    assert all(b <= a + 1e-12 for a, b in zip(history, history[1:], strict=False))


@pytest.mark.parametrize("name", ["symmetric", "spread"])
def test_contrastive_gradient_against_all_pairs(spark, whole, name):
    """The summed gradient of all batches is that of the loss over all pairs, by finite differences."""
    objective = (lambda a, b: fits.symmetric_loss(a, b, 0.3)) if name == "symmetric" else (lambda a, b: fits.spread_loss(a, b, 0.7))
    x = whole[:90]
    rows = [(i // 40, row[:5].tolist(), row[5:9].tolist()) for i, row in enumerate(x)]
    packed = fits.packed_pairs(spark.createDataFrame(rows, "batch long, a array<double>, b array<double>").repartition(3))
    rng = np.random.default_rng(4)
    left, right = rng.normal(size=(3, 5)), rng.normal(size=(3, 4))

    def loss(m, k):
        total = 0.0
        for at in (0, 40, 80):
            a, b = x[at : at + 40, :5] @ m.T, x[at : at + 40, 5:9] @ k.T
            a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
            if name == "symmetric":
                s = a @ b.T / 0.3
                total += sum(0.5 * (np.log(np.exp(s[i]).sum()) + np.log(np.exp(s[:, i]).sum())) - s[i, i] for i in range(len(a)))
            else:
                total += ((a - b) ** 2).sum()
                for z in (a, b):
                    n = len(z)
                    total += 0.7 * n * np.log(np.mean([np.exp(-2 * ((z[i] - z[j]) ** 2).sum()) for i in range(n) for j in range(n) if i != j]))
        return total / 90

    f, g, h = fits.contrastive_gradient(packed, left, right, objective)
    assert f == pytest.approx(loss(left, right))
    for i, j in [(0, 0), (1, 2), (2, 3)]:
        e = np.zeros((3, 5))
        e[i, j] = 1e-5
        assert (loss(left + e, right) - loss(left - e, right)) / 2e-5 == pytest.approx(g[i, j], abs=1e-6)
        assert (loss(left, right + e[:, :4]) - loss(left, right - e[:, :4])) / 2e-5 == pytest.approx(h[i, j], abs=1e-6)
    _, _, history = fits.fit_encoders(packed, left, right, objective, steps=6, rate=0.5)
    assert history[-1] < history[0] and all(b <= a for a, b in zip(history, history[1:], strict=False))


def test_queries_of_the_module(spark):
    rows = registry.QUERIES["contrastive_fits"](spark, FOLDER).collect()
    for name in ("symmetric", "spread"):
        own = [r["loss"] for r in sorted(rows, key=lambda r: r["step"]) if r["objective"] == name]
        assert len(own) == 9 and own[-1] < own[0]
    fitted = {r["method"]: r for r in registry.QUERIES["estimated_shift_coverage"](spark, FOLDER).collect()}
    assert fitted["fitted"]["w_rank"] + fitted["fitted"]["w_square"] > 0 and fitted["fitted"]["coverage"] >= fitted["plain"]["coverage"]
    newton = [r for r in registry.QUERIES["listwise_newton_fits"](spark, FOLDER).collect()]
    assert {r["kind"] for r in newton} == {"permutation", "top_one"}
