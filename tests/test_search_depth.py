"""Queries ask the exact search for no more rows than they read, and read what it found once."""

import random

import pytest

from ferrule.queries import ann, base, evaluation, generation, graphs

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture
def asked(monkeypatch):
    found = []

    def told(queries, corpus, k, *more):
        found.append(k)
        return search(queries, corpus, k, *more)

    search = base.knn
    monkeypatch.setattr(base, "knn", told)
    return found


def test_claims_search_one_leg_to_their_own_depth(spark, asked):
    got = base.claims(spark, FOLDER)
    assert asked == [10]
    deep = base.run(spark, FOLDER).where("leg = 'full' AND rank <= 10")
    assert sorted(got.select("qid", "doc_id", "rank").collect()) == sorted(deep.select("qid", "doc_id", "rank").collect())


def test_edges_search_to_their_own_depth(spark, asked):
    got = graphs._edges(spark, FOLDER).groupBy().sum("w").first()[0]
    assert asked == [5, 5, 5]
    assert got == pytest.approx(sum(1 / r["rank"] for r in base.run(spark, FOLDER).where("rank <= 5").collect()))


@pytest.mark.parametrize(("module", "name"), [(evaluation, "recalibration"), (generation, "conformal_quantile")])
def test_claims_are_worked_out_once(spark, monkeypatch, module, name):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = random.Random(4)
    rows = [(20 * (i // 10), i, i % 10 + 1, rng.random(), rng.randrange(2)) for i in range(200)]
    kind = "qid long, doc_id long, rank long, p double, y int"
    monkeypatch.setattr(module, "claims", lambda spark, d: spark.createDataFrame(rows, kind).mapInArrow(tell, kind))
    assert getattr(module, name)(spark, "").collect()
    assert seen.value == len(rows)


def test_graphs_are_searched_once(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    def told(queries, stored, k, width):
        def tell(batches):
            for batch in batches:
                asked.add(batch.num_rows)
                yield batch

        found = search(queries, stored, k, width)
        return found.mapInArrow(tell, found.schema)

    search = ann.A.search_graph
    monkeypatch.setattr(ann.A, "search_graph", told)
    monkeypatch.setattr(ann, "vectors", lambda spark, d: base.vectors(spark, d).where("doc_id < 200"))
    monkeypatch.setattr(ann, "vector_queries", lambda spark, d: base.vector_queries(spark, d).where("qid < 200"))
    assert len(ann.graph_search_recall(spark, FOLDER).collect()) == 4
    assert asked.value == 4 * 10 * 10  # four searches of ten queries for ten rows each
