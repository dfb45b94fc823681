"""Spectral axes against numpy, planted communities, and connectivity against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule import registry
from ferrule.operators import ann, spectral


def planted(seed, sizes, inside, between):
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, [(i, j, 1.0) for i in range(len(of)) for j in range(i) if rng.random() < (inside if of[i] == of[j] else between)]


def test_axes_and_values_against_eigh(spark):
    _, edges = planted(1, [12, 13, 14], 0.7, 0.05)
    n = 40  # one node has no edge
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    axes, values = spectral.spectral_axes(nodes, df, 3, rounds=25, tol=1e-9)
    a = np.zeros((n, n))
    for i, j, w in edges:
        a[i, j] += w
        a[j, i] += w
    d = np.where(a.sum(axis=1) > 0, a.sum(axis=1), 1.0)
    full, vectors = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    assert np.allclose(values, full[::-1][:3], atol=1e-6)
    x = np.array([[r[f"x{j}"] for j in range(3)] for r in axes.orderBy("node").collect()])
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-6)
    assert np.allclose(np.abs((x * vectors[:, ::-1][:, :3]).sum(axis=0)), 1, atol=1e-3)


def test_planted_communities_are_found(spark):
    of, edges = planted(2, [20, 25, 30], 0.5, 0.02)
    labels, _ = spectral.spectral_communities(spark.createDataFrame([(i,) for i in range(75)], "node long"), spark.createDataFrame(edges, "src long, dst long, w double"), 3, rounds=12)
    found = {r["node"]: r["label"] for r in labels.collect()}
    assert len({(int(of[i]), found[i]) for i in range(75)}) == 3
    assert spectral.spectral_communities(spark.createDataFrame([], "node long"), spark.createDataFrame([], "src long, dst long, w double"), 3)[0].count() == 0


def plain(nodes, edges):
    left, sizes = set(nodes), []
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while left:
        todo, own = [left.pop()], 1
        while todo:
            for y in near.get(todo.pop(), ()):
                if y in left:
                    left.discard(y)
                    todo.append(y)
                    own += 1
        sizes.append(own)
    return sizes


def test_stored_graph_under_predicates_against_a_plain_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(6))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>, label int")
    stored = ann.store_graph(df.select("doc_id", "vec"), 4)
    links = spectral.stored_links(stored)
    edges = [(r["src"], r["dst"]) for r in links.collect()]
    assert len(edges) == len(set(edges)) and all(a < b for a, b in edges)
    own = {(min(r["doc_id"], o), max(r["doc_id"], o)) for r in stored.collect() for o in r["links"][0]}
    assert set(edges) == own
    predicates = {"few": F.col("label") == 0, "half": F.col("label") < 3, "all": F.lit(True), "none": F.col("label") > 9}
    got = {r["predicate"]: r for r in spectral.predicate_connectivity(df.select(F.col("doc_id").alias("node"), "label"), links, predicates).collect()}
    for name, keep in (("few", lambda x: x == 0), ("half", lambda x: x < 3), ("all", lambda x: True)):
        nodes = [i for i, _, x in rows if keep(x)]
        inside = [(a, b) for a, b in edges if keep(rows[a][2]) and keep(rows[b][2])]
        sizes = plain(nodes, inside)
        assert (got[name]["nodes"], got[name]["edges"], got[name]["components"]) == (len(nodes), len(inside), len(sizes))
        assert got[name]["giant"] == pytest.approx(max(sizes) / len(nodes))
    assert set(got) == {"few", "half", "all"}


def test_queries_of_the_module(spark):
    rows = registry.QUERIES["spectral_communities"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 10 and max(r["eigenvalue"] for r in rows) == pytest.approx(1, abs=0.03) and rows[0]["q"] > 0.2
    found = registry.QUERIES["search_graph_connectivity"](spark, "/root/testdata/sf0.001").collect()
    whole = {r["links"]: r for r in found if r["predicate"] == "100 %"}
    assert whole[8]["giant"] >= whole[4]["giant"] > 0.5 and whole[8]["edges"] > whole[4]["edges"]
