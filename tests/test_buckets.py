"""Cells and hash buckets: rankings and sizes equal to all pairs, without a row a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import ann, dense
from ferrule.queries import ann as ann_queries


def no_pairs(*sides):
    raise AssertionError("queries and vectors are joined by bucket")


@pytest.fixture
def points(spark):
    x = np.random.default_rng(6).integers(-3, 4, (240, 3)).astype(float)  # many ties and copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>").repartition(3)
    return x, df, df.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "qid")


def best(x, near, k):
    """(qid, doc_id, rank) of the k nearest rows for which near(qid, doc_id)."""
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return sorted((q, j, r + 1) for q in range(0, len(x), 5) for r, j in enumerate(sorted((j for j in range(len(x)) if j != q and near(q, j)), key=lambda j, q=q: (d[q, j], j))[:k]))


@pytest.mark.parametrize("most", [1000, 7])  # all queries at once, and in blocks
def test_cells_against_all_pairs(spark, monkeypatch, points, most):
    monkeypatch.setattr(ann, "MOST_BUCKET_QUERIES", most, raising=False)
    monkeypatch.setattr(dense, "TILE_ROWS", 16)
    monkeypatch.setattr(ann, "squared_distance", no_pairs, raising=False)  # a distance a joined pair is what took the time
    x, df, queries = points
    book = x[:6]
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    cell, probes = d.argmin(axis=1), np.argsort(d, axis=1, kind="stable")[:, :2]
    near = lambda q, j: cell[j] in probes[q]
    assert sorted((r["qid"], r["doc_id"], r["rank"]) for r in ann.probe(queries, df, book, 2, 7).collect()) == best(x, near, 7)
    sizes = {q: sum(near(q, j) for j in range(len(x)) if j != q) for q in range(0, len(x), 5)}
    assert dict(ann.probed(queries, df, book, 2).collect()) == {q: n for q, n in sizes.items() if n}


def test_a_query_alone_in_its_cells_is_not_counted(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [10.0]), (2, [10.5]), (None, [0.1]), (3, None)], "doc_id long, vec array<double>")
    queries = df.where("doc_id < 2").withColumnRenamed("doc_id", "qid")
    assert [tuple(r) for r in ann.probed(queries, df, np.array([[0.0], [10.0]]), 1).collect()] == [(1, 1)]


def test_fraction_counts_cells_without_distances_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(ann, "squared_distance", no_pairs, raising=False)
    v = ann_queries.vectors(spark, "/root/testdata/sf0.01").select("doc_id", F.col("vec").cast("array<double>")).orderBy("doc_id").collect()
    x = np.array([r[1] for r in v])
    d = np.round(((x[:, None, :] - x[None, :16, :]) ** 2).sum(axis=2), 9)
    cell, probes = d.argmin(axis=1), np.argsort(d, axis=1, kind="stable")[:, :4]
    shares = [(np.isin(cell, probes[i]).sum() - (cell[i] in probes[i])) / len(x) for i, r in enumerate(v) if r[0] % 20 == 0]
    got = ann_queries.candidate_fraction(spark, "/root/testdata/sf0.01").first()["fraction"]
    assert got == pytest.approx(np.mean([s for s in shares if s]), abs=1e-6)


@pytest.mark.parametrize("most", [1000, 7])
def test_hash_tables_against_all_pairs(spark, monkeypatch, points, most):
    monkeypatch.setattr(ann, "MOST_BUCKET_QUERIES", most, raising=False)
    monkeypatch.setattr(ann, "squared_distance", no_pairs, raising=False)
    x, df, queries = points
    planes = [ann.hyperplanes(3, 3, seed=t) for t in range(3)]
    sig = np.stack([(np.round(x @ h.T, 9) >= 0) @ (1 << np.arange(3)) for h in planes], axis=1)
    got = ann.hash_topk(queries, df, planes, 7).collect()
    assert sorted((r["qid"], r["doc_id"], r["rank"]) for r in got) == best(x, lambda q, j: (sig[q] == sig[j]).any(), 7)


def test_hash_query_joins_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(ann, "squared_distance", no_pairs, raising=False)
    found = ann_queries.hash_table_topk(spark, "/root/testdata/sf0.01")
    assert "Join" not in found._jdf.queryExecution().toString()
    assert found.where("rank = 1").count() > 0
