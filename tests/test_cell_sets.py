"""Cascades over the sets of cells that documents own: equal to those over all documents, and as many rows as there are sets."""

import numpy as np

from ferrule.operators import cascade as C
from ferrule.operators import dense
from ferrule.plans.ranking import top_k


def test_sets_against_documents(spark):
    rng = np.random.default_rng(3)
    book = rng.normal(size=(6, 4))
    base = rng.normal(size=(25, 3, 4))
    x = np.concatenate([base, base, base[:9]])[rng.permutation(59)]  # copies: equal scores
    docs = spark.createDataFrame([(i, t, v.tolist()) for i, doc in enumerate(x) for t, v in enumerate(doc[: 1 + i % 3])], "doc_id long, dtok int, dvec array<double>")
    queries = docs.where("doc_id % 5 = 0").selectExpr("doc_id as qid", "dtok as qtok", "dvec as qvec")
    scores, cells = C.token_scores(queries, book), C.token_cells(docs, book)
    every = C.probe_candidates(scores, cells, 1)
    assert sorted(C.candidate_counts(scores, cells, 1).collect()) == sorted(every.groupBy("qid").count().collect())
    plain = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    for k in (1, 4, 100):
        assert plain(C.centroid_topk(scores, cells, 1, k)) == plain(top_k(C.centroid_scores(scores, cells, every), k))


def test_copies_add_no_pairs(spark):
    cells = spark.createDataFrame([(i, i % 4) for i in range(4000)], "doc_id long, cell long")
    assert sorted(map(tuple, C.cell_sets(cells, 2).select("first", "n", "docs").collect())) == [(i, 1000, [i, i + 4]) for i in range(4)]


def test_equal_queries_meet_the_sets_once(spark):
    scores = spark.createDataFrame([(q, t, c, float((q * 7 + t * 3 + c * 5) % 4)) for q in range(0, 600) for t in range(2) for c in range(5)], "qid long, qtok int, cell long, s double")
    cells = spark.createDataFrame([(i, (i * i + j) % 5) for i in range(200) for j in range(1 + i % 2)], "doc_id long, cell long")
    asked, sets = C.probed_cells(scores, 1).select("probed").distinct(), C.cell_sets(cells)
    assert asked.count() <= 4 and C.met_sets(asked, sets).count() <= 4 * sets.count()  # 600 queries met them before
    every = C.probe_candidates(scores, cells, 1)
    assert sorted(C.candidate_counts(scores, cells, 1).collect()) == sorted(every.groupBy("qid").count().collect())


def test_late_interaction_with_every_document(spark, monkeypatch):
    monkeypatch.setattr(dense, "MOST_COLLECTED", 4)  # several blocks of queries and tiles
    monkeypatch.setattr(dense, "TILE_ROWS", 8)
    monkeypatch.setattr(dense, "TILE_SCORES", 20)
    x = np.random.default_rng(4).integers(-2, 3, (40, 4, 3)).astype(float)
    docs = spark.createDataFrame([(i, t, v.tolist()) for i, doc in enumerate(x) for t, v in enumerate(doc[: 1 + i % 4])], "doc_id long, dtok int, dvec array<double>")
    queries = docs.where("doc_id % 4 = 2").selectExpr("doc_id as qid", "dtok as qtok", "dvec as qvec")
    pairs = queries.select("qid").distinct().crossJoin(docs.select("doc_id").distinct()).where("qid <> doc_id")
    plain = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    expected = plain(top_k(dense.maxsim(queries, docs, pairs), 5))
    assert len(expected) == 50 and plain(dense.maxsim_topk(queries, docs, 5)) == expected
