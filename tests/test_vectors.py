"""Unit lengths and orthogonal parts: equal to numpy, and worked out once a row."""

import time

import numpy as np
from pyspark.sql import functions as F

from ferrule.functions.vectors import blend, normalize, orthogonal_part


def test_a_row_costs_as_much_as_its_vector_is_long(spark):
    x = np.random.default_rng(0).normal(size=(40, 2, 256))
    x[7, 0] = 0
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(x)], "i long, a array<double>, b array<double>")
    start = time.monotonic()
    got = df.select(orthogonal_part("a", "b").alias("o"), normalize("a").alias("n"), blend("a", "b", 0.25).alias("m")).orderBy("i").collect()
    assert time.monotonic() - start < 30  # minutes, when a row's product was worked out again for every coordinate
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    for (a, b), row in zip(x, got, strict=True):
        for found, true in ((row["o"], unit(a - (a @ b) * b)), (row["n"], unit(a)), (row["m"], unit(0.75 * a + 0.25 * b))):
            np.testing.assert_allclose(found, true, atol=1e-12)


def test_nulls_stay(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [tuple(r) for r in df.select(normalize("a"), orthogonal_part("a", "b")).collect()] == [(None, None), ([], [])]
    assert df.select(normalize(F.col("b"))).first()[0] is not None
