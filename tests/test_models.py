import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import cascade as C
from ferrule.operators import dense, evaluation
from ferrule.operators import models as M
from ferrule.plans.ranking import top_k


def test_low_rank_students():
    rng = np.random.default_rng(0)
    t = rng.normal(size=(12, 9)) + 5 * rng.normal(size=(12, 1))
    q, d = M.dual_encoder(t, 4)
    assert np.allclose(q @ d.T, M.best_rank(t, 4)) and M.relative_error(t, M.best_rank(t, 9)) < 1e-12
    s = M.margin_student(t, 3)
    brute = sum(((s[i, a] - s[i, b]) - (t[i, a] - t[i, b])) ** 2 for i in range(12) for a in range(9) for b in range(9))
    assert math.isclose(M.margin_loss(s, t), brute, rel_tol=1e-9)
    assert M.margin_loss(s, t) <= M.margin_loss(M.best_rank(t, 3), t) + 1e-9
    assert M.top_recall(np.eye(3), np.array([0, 1, 0]), 1) == pytest.approx(2 / 3)


def test_pair_scorer_and_outcomes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = x[:, 0] * x[:, 1]
    f = M.fit_ridge(x, y, 200, 0)
    z = rng.normal(size=(300, 4))
    assert np.corrcoef(f(z), z[:, 0] * z[:, 1])[0, 1] > 0.8
    out = M.pool_outcomes(np.array([[0, 1], [1, 0], [0, 1], [1, 0]]), np.array([[1, 0], [1, 0], [0, 1], [0, 1.0]]), np.zeros(4, int), 2)
    assert out == {"fixed": 1, "kept": 1, "broke": 1, "missed": 1}


def test_realisability():
    h = M.hadamard(3)
    assert np.allclose(h @ h.T, 8 * np.eye(8)) and math.isclose(M.sign_rank_floor(h), math.sqrt(8))
    assert M.realize_signs(2 * np.eye(5, dtype=int) - 1, 3, steps=800) == 1.0
    assert M.pair_queries(4).shape == (6, 4) and (M.pair_queries(4).sum(axis=1) == 0).all()


def test_contrastive_descent():
    rng = np.random.default_rng(2)
    pair = np.array([1, 0, 3, 2, 5, 4, 7, 6])
    z0 = rng.normal(size=(8, 3))
    z, losses = M.contrastive_descent(z0, pair)
    assert losses[-1] < losses[0] and M.alignment(z, pair) < 0.2 and M.uniformity(z) < 0
    bound = M.information_bound(0.9, 200)
    assert 0.5 < bound <= -0.5 * math.log(1 - 0.81) + 0.1


def test_boosted_ranker_improves(spark):
    rng = np.random.default_rng(3)
    rows = []
    for q in range(6):
        for i in range(12):
            x = rng.normal(size=2)
            rows.append((q, i, x.tolist(), 2 if x[0] > 0.3 else 0))
    df = spark.createDataFrame(rows, "qid long, doc_id long, x array<double>, grade int").cache()
    stumps = M.fit_boosted(df, 2, 4)
    assert stumps[0].feature == 0
    qrels = df.where("grade > 0").select("qid", "doc_id", "grade")

    def quality(k):
        run = top_k(df.select("qid", "doc_id", M.boosted_score(stumps[:k]).alias("score")), 12).withColumn("leg", F.lit("x"))
        return evaluation.ndcg(run, qrels).agg(F.avg("ndcg")).first()[0]

    assert quality(4) > quality(0) and quality(4) > 0.9


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3, 6))
    docs = spark.createDataFrame([(i, j, x[i, j].tolist()) for i in range(60) for j in range(3)], "doc_id long, dtok int, dvec array<double>")
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("dtok").alias("qtok"), F.col("dvec").alias("qvec"))
    return x, docs, queries


def test_token_cascade(spark, tokens):
    x, docs, queries = tokens
    book = x[:3].reshape(-1, 6)
    exact = {q: np.argsort(-np.array([(x[q] @ x[i].T).max(axis=1).sum() for i in range(60)]), kind="stable")[:5].tolist() for q in (0, 20, 40)}
    found: dict = {}
    for r in C.token_cascade(queries, docs, book, nprobe=9, keep=60, k=5).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["doc_id"])
    assert found == exact
    fast = C.token_cascade(queries, docs, book, nprobe=3, keep=20, k=5)
    truth = spark.createDataFrame([(q, i) for q, v in exact.items() for i in v], "qid long, doc_id long")
    assert C.stage_retention(fast, truth, 5).first()[0] > 0.4
    cells, scores = C.token_cells(docs, book), C.token_scores(queries, book)
    centred = C.centroid_scores(scores, cells, C.probe_candidates(scores, cells, 9))
    rough = {(r["qid"], r["doc_id"]): r["score"] for r in centred.collect()}
    bound = {(r["qid"], r["doc_id"]): r["bound"] for r in C.score_error_bound(centred, queries, docs, book).collect()}
    for (q, i), s in rough.items():
        assert abs(s - (x[q] @ x[i].T).max(axis=1).sum()) <= bound[q, i] + 1e-9


def test_budget_and_dependence():
    curves = {"a": [(0, 0.2), (1, 0.8), (2, 0.9)], "b": [(0, 0.5), (1, 0.6), (2, 0.61)]}
    assert C.allocate_budget(curves, 0) == {"a": 0, "b": 0} and C.allocate_budget(curves, 1) == {"a": 1, "b": 0}
    best = max(itertools.product(range(3), repeat=2), key=lambda p: curves["a"][p[0]][1] * curves["b"][p[1]][1] if sum(p) <= 2 else 0)
    assert tuple(C.allocate_budget(curves, 2).values()) == best
    one = C.dependent_cascade(0.8, 0.8, 0.9)
    assert one["joint"] > one["independent"] + 0.05
    assert abs(C.dependent_cascade(0.8, 0.8, 0.0)["joint"] - 0.64) < 0.02


def test_small_world():
    contacts = C.ring_contacts(200, 1.0)
    hops = [C.greedy_hops(0, t, contacts) for t in range(0, 200, 10)]
    assert hops[0] == 0 and max(hops) <= 100 and np.mean(hops) < 50


def test_walk_reads_new_documents(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 5)))], "doc_id long, vec array<double>")
    rows = C.reformulated_walk(df.where("doc_id < 3").select(F.col("doc_id").alias("qid"), "vec"), df, 3).collect()
    for q in range(3):
        read = [r["doc_id"] for r in sorted((r for r in rows if r["qid"] == q), key=lambda r: r["hop"])]
        assert len(read) == 3 == len(set(read)) and q not in read
    assert dense.knn(df.select(F.col("doc_id").alias("qid"), "vec"), df, 1).count() == 50


def test_retained_component(spark):
    nodes = spark.range(30).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(29)], "src long, dst long, w double")
    assert tuple(C.retained_component(nodes, edges, 1.0).first()) == (30, 30)
    kept, largest = C.retained_component(nodes, edges, 0.5).first()
    assert largest <= kept < 30


def test_trees_of_two_levels(spark):
    rng = np.random.default_rng(21)
    x = rng.random((400, 2))
    force = np.where(x[:, 0] > 0.5, np.where(x[:, 1] > 0.5, 13.0, 9.0), np.where(x[:, 1] > 0.3, 0.5, -2.0))
    df = spark.createDataFrame([(i, v.tolist(), float(f)) for i, (v, f) in enumerate(zip(x, force, strict=True))], "doc_id long, x array<double>, force double")
    edges = [[i / 10 for i in range(1, 10)]] * 2
    error = {}
    for depth in (1, 2):
        tree = M.fit_tree(df, 2, edges, depth)
        error[depth] = df.select(F.avg(F.pow(F.col("force") - tree.column(), 2))).first()[0]
    stump = M.fit_stump(df, 2, edges)
    assert np.isclose(error[1], df.select(F.avg(F.pow(F.col("force") - stump.column(), 2))).first()[0])
    assert error[2] < 0.01 < error[1] and len(tree.splits) == 3
    assert M.fit_tree(df.withColumn("force", F.lit(1.0)), 2, edges, 2).splits == {}
