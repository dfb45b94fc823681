"""Queries run a search, or a scan, once however often they read what it found; equal queries share one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import ann, dense, graphs
from ferrule.queries import base, codes, information, sampling
from ferrule.queries import graphs as graph_queries

FOLDER = "/root/testdata/sf0.01"


def told(df, seen):
    """The rows of df, counted in the accumulator when they are read."""

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(tell, df.schema)


def test_cell_sums_scan_once(spark):
    rng = np.random.default_rng(3)
    x, book = rng.normal(size=(200, 4)), rng.normal(size=(5, 4))
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(3)
    sums, counts, total = ann.cell_sums(told(df, seen), book)
    assert seen.value == 200
    apart = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    cell = apart.argmin(axis=1)
    assert counts.tolist() == np.bincount(cell, minlength=5).tolist()
    assert np.allclose(sums, [x[cell == k].sum(axis=0) for k in range(5)])
    assert total == pytest.approx(apart.min(axis=1).sum())


def test_hierarchy_of_both_methods_moves_the_first_level_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    of = np.repeat(np.arange(4), 8)
    links = [(i, j, 1.0) for i in range(32) for j in range(i + 1, 32) if rng.random() < (0.7 if of[i] == of[j] else 0.06)]
    edges, nodes = spark.createDataFrame(links, "src long, dst long, w double"), spark.range(32).select(F.col("id").alias("doc_id"))
    monkeypatch.setattr(graph_queries, "_edges", lambda spark, d: edges)
    monkeypatch.setattr(graph_queries, "vectors", lambda spark, d: nodes)
    want = [(name, i, n, round(q, 6)) for name, refined in (("plain", False), ("refined", True)) for i, (n, q) in enumerate(graphs.communities(nodes.withColumnRenamed("doc_id", "node"), edges, refined=refined, levels=3)[1])]
    moves, cut = [], []
    local_moves = graphs.local_moves
    monkeypatch.setattr(graphs, "local_moves", lambda e, labels, *more, **named: moves.append(labels.where("node <> label").count() == 0 and "within" not in named and labels.count() == 32) or local_moves(e, labels, *more, **named))
    monkeypatch.setattr(graphs, "components", lambda *a: cut.append(a))
    assert [tuple(r) for r in graph_queries.community_hierarchy(spark, "").collect()] == want
    assert sum(moves) == 1 and not cut  # the pieces of the last communities are not part of the result


@pytest.mark.parametrize(("module", "name"), [(information, "conditional_information"), (codes, "compressed_maxsim_topk")])
def test_neighbours_are_searched_once(spark, monkeypatch, module, name):
    seen, search = spark.sparkContext.accumulator(0), module.knn
    monkeypatch.setattr(module, "knn", lambda q, c, *more: search(q, told(c.select("doc_id", "vec"), seen), *more))
    assert getattr(module, name)(spark, FOLDER).collect()
    assert seen.value == base.vectors(spark, FOLDER).count()


def test_equal_queries_ask_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (60, 3)).astype(float)  # many ties
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>").repartition(3)
    vec = {i: x[i % 3].tolist() for i in range(0, 60, 4)}  # ids of the corpus, three different vectors
    queries = spark.createDataFrame([*vec.items(), (1000, [1.0, 0.0, 2.0]), (1001, None)], "qid long, vec array<double>")
    for metric in dense.METRICS:
        want = sorted((r["qid"], r["doc_id"], r["rank"]) for r in dense.knn(queries, corpus, 7, metric).collect())
        assert sorted((r["qid"], r["doc_id"], r["rank"]) for r in dense.knn_of_equals(queries, corpus, 7, metric).collect()) == want
    asked, search = [], dense.knn
    monkeypatch.setattr(dense, "knn", lambda q, *more, **named: asked.append(q.count()) or search(q, *more, **named))
    monkeypatch.setattr(sampling, "knn", dense.knn)
    assert sampling.hypothetical_answers(spark, FOLDER).count() == 3
    labels = base.vector_queries(spark, FOLDER).select("qlabel").distinct().count()
    assert len(asked) == 3 and max(asked) <= 2 * labels
