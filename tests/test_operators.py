"""Operators that no SQL checks, against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import agreement, ann, crossmodal, dense, evaluation, forward, fusion, generation, graphs, information, learning, lexical, principle
from ferrule.operators import relational as relational_ops
from ferrule.plans import ranking
from ferrule.sources import tables


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>").repartition(4)


def brute_knn(x, qs, k, metric):
    if metric == "euclidean":
        s = -((x[qs][:, None, :] - x[None, :, :]) ** 2).sum(2)
    else:
        u = x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" else x
        s = u[qs] @ u.T
    s[np.arange(len(qs)), qs] = -np.inf
    return {q: np.argsort(-s[i], kind="stable")[:k].tolist() for i, q in enumerate(qs)}


@pytest.mark.parametrize("metric", dense.METRICS)
@pytest.mark.parametrize("limit", [4_000_000, 10])
def test_knn_both_plans(spark, cloud, metric, limit, monkeypatch):
    x, df = cloud
    monkeypatch.setattr(dense, "MOST_BROADCAST_VALUES", limit)
    qs = list(range(0, 300, 20))
    queries = df.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec")
    found = {}
    for r in dense.knn(queries, df, 5, metric, block=4 if limit == 10 else 4096).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["doc_id"])
    assert found == brute_knn(x, qs, 5, metric)


def test_knn_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, vec array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0])], "doc_id long, vec array<double>")
    ask = some.select(F.col("doc_id").alias("qid"), "vec")
    assert dense.knn(ask, empty, 3).count() == 0 and dense.knn(ask.where("false"), some, 3).count() == 0
    rows = dense.knn(ask.where("qid = 4"), some, 3).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in rows] == [(1, 0.0), (2, 0.0)]  # ties by id, zero vectors score 0


def test_principal_axes(cloud):
    x, df = cloud
    mean, values, axes = dense.principal_axes(df)
    expected = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(mean, x.mean(0)) and np.allclose(values, expected)
    residual = (x - mean) - (x - mean) @ axes[:3].T @ axes[:3]
    assert math.isclose(dense.reconstruction_error(df, axes, mean, 3), (residual**2).sum(), rel_tol=1e-9)
    assert np.allclose(dense.random_rotation(6) @ dense.random_rotation(6).T, np.eye(6))
    for family in ("gaussian", "rademacher", "sparse"):
        a = dense.random_projection(2000, 500, family, seed=1)
        assert abs((a @ np.ones(2000)) @ (a @ np.ones(2000)) / 2000 - 1) < 0.3
    assert 5 < dense.intrinsic_dimension(df) < 12


def test_lloyd_never_rises_and_equals_numpy(cloud):
    x, df = cloud
    book, history = ann.lloyd(df, x[:5].copy(), 8)
    assert all(a >= b - 1e-9 for a, b in itertools.pairwise(history))
    own = x[:5].copy()
    for _ in range(len(history)):
        code, _ = ann.nearest_codes(x, own)
        own = np.array([x[code == c].mean(0) if (code == c).any() else own[c] for c in range(5)])
    assert np.allclose(book, own)
    assert len(ann.seed_codebook(df, 7)) == 7


def test_product_codes_and_tables(cloud):
    x, df = cloud
    books = [x[:6, :4], x[:6, 4:]]
    codes = ann.product_codes(x, books)
    again = ann.product_decode(codes, books)
    table = ann.distance_table(x[9], books)
    assert np.allclose(table[[0, 1], codes].sum(1), ((again - x[9]) ** 2).sum(1))
    assert np.isclose(ann.encode(df, books).agg(F.sum("error")).first()[0], ((x - again) ** 2).sum())
    turn = ann.parametric_rotation(np.arange(8, 0, -1.0), np.eye(8), 2)
    assert np.allclose(turn @ turn.T, np.eye(8))
    r = ann.procrustes(x.T @ (x @ dense.random_rotation(8, 3).T))
    assert np.allclose(r, dense.random_rotation(8, 3))
    with pytest.raises(ValueError):
        ann.subspaces(8, 3)


def test_search_in_blocks(cloud, monkeypatch):
    _, df = cloud
    monkeypatch.setattr(ann, "MOST_QUERIES", 4)
    queries = df.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec")
    assert ann.graph_search(queries, df, 3, 300, shard_rows=100).select("qid").distinct().count() == 15


@pytest.mark.parametrize("layered", [False, True])
def test_proximity_graph(cloud, layered):
    x, _ = cloud
    graph = ann.ProximityGraph(x, m=6, layered=layered)
    hits = 0
    for q in range(0, 300, 10):
        truth = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:5].tolist()
        hits += len({i for _, i in graph.search(x[q], 5, 80)} & set(truth))
    assert hits / 150 > 0.97
    live = np.arange(300) % 3 == 0
    assert all(live[i] for _, i in graph.search(x[1], 5, 100, live))
    gone = set(range(0, 300, 2))
    graph.delete(gone)
    hits = 0
    rest = np.array([i for i in range(300) if i not in gone])
    for q in range(1, 300, 10):
        truth = rest[np.argsort(((x[rest] - x[q]) ** 2).sum(1), kind="stable")[:5]].tolist()
        found = {i for _, i in graph.search(x[q], 5, 80)}
        assert not found & gone
        hits += len(found & set(truth))
    assert hits / 150 > 0.9


def test_consensus():
    rng = np.random.default_rng(3)
    for _ in range(20):
        rankings = [rng.permutation(5).tolist() for _ in range(3)]
        order, cost = fusion.kemeny_order(rankings)
        every = [sum(fusion.kendall_distance(list(p), r) for r in rankings) for p in itertools.permutations(range(5))]
        assert cost == min(every) == sum(fusion.kendall_distance(order, r) for r in rankings)
        foot = fusion.footrule_order(rankings)
        spread = lambda o: sum(abs(o.index(i) - r.index(i)) for r in rankings for i in range(5))
        assert spread(foot) == min(spread(list(p)) for p in itertools.permutations(range(5)))
    assert fusion.markov_chain_order([[1, 2, 3]] * 3) == [1, 2, 3]
    assert fusion.sliding_window_order(list(range(30)), lambda v: v, 10, 5, 1)[0] == 29
    with pytest.raises(ValueError):
        fusion.kemeny_order([list(range(9))])


def test_paired_tests(spark):
    d = [0.3, -0.1, 0.25, 0.4, 0.05, -0.2, 0.5]
    df = spark.createDataFrame(list(enumerate(d)), "qid long, d double")
    t = evaluation.paired_t(df)
    assert math.isclose(t["t"], np.mean(d) / (np.std(d, ddof=1) / math.sqrt(7)))
    sums = [abs(sum(s * v for s, v in zip(signs, d, strict=True))) for signs in itertools.product((1, -1), repeat=7)]
    assert evaluation.permutation_p(df) == sum(s >= abs(sum(d)) - 1e-12 for s in sums) / 128
    assert abs(evaluation.permutation_p(df, draws=4000, exact_up_to=3) - evaluation.permutation_p(df)) < 0.05
    one = evaluation.paired_t(df.limit(1))
    assert (one["t"], one["p"]) == (0.0, 1.0)
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.random.default_rng(0).normal(size=200))], "qid long, v double")
    assert abs(evaluation.bootstrap_se(values, "v", 400) - 1 / math.sqrt(200)) < 0.02
    assert evaluation.separation_n(0.5, 0.4, 0.2, 0.2) == math.ceil((1.96 * 0.4 / 0.1) ** 2)


def test_adjustments(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    rows = evaluation.adjusted_p(spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "test string, p double")).collect()
    got = {r["test"]: (r["bonferroni"], r["holm"], r["bh"]) for r in rows}
    assert np.allclose(got["3"], (0.02, 0.02, 0.02)) and np.allclose(got["0"], (0.04, 0.03, 0.02))
    assert np.allclose(got["2"], (0.12, 0.06, 0.04)) and np.allclose(got["1"], (0.16, 0.06, 0.04))


def test_calibrators(spark):
    rng = np.random.default_rng(1)
    s = rng.random(2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * s - 2)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "p double, y int")
    a, b = evaluation.platt(df)
    assert abs(a - 3) < 0.6 and abs(b + 2) < 0.5
    t, v = evaluation.isotonic(df)
    assert t == sorted(t) and v == sorted(v)
    step = df.select(evaluation.apply_isotonic(F.col("p"), t, v).alias("p"), "y")
    assert evaluation.brier(step).first()[0] <= evaluation.brier(df).first()[0]


def test_observer_error_finds_good_judges(spark):
    rng = np.random.default_rng(2)
    truth, accuracy = rng.integers(0, 2, 300), [0.92, 0.85, 0.8, 0.78, 0.65]
    rows = [(i, j, int(t if rng.random() < a else 1 - t)) for i, t in enumerate(truth.tolist()) for j, a in enumerate(accuracy)]
    post, judges = agreement.observer_error(spark.createDataFrame(rows, "item long, judge long, value int"), 30)
    found = {r["item"]: r["p"] > 0.5 for r in post.collect()}
    votes = np.zeros(300)
    for i, _, v in rows:
        votes[i] += v
    agreed = np.mean((votes >= 3) == truth)
    assert np.mean([found[i] == t for i, t in enumerate(truth)]) >= agreed
    assert judges[0][0] > judges[4][0]


def test_selection():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sim = np.maximum(x @ x.T, 0)
    value = lambda s: information.facility_value(s, sim)
    lazy = information.greedy(value, 9, 4)
    plain: list[int] = []
    while len(plain) < 4:
        plain.append(max((i for i in range(9) if i not in plain), key=lambda i: (round(value([*plain, i]), 12), -i)))
    best = information.best_subset(value, 9, 4)
    assert lazy == plain and value(lazy) >= (1 - 1 / math.e) * value(best)
    assert information.marginal_relevance(np.array([3.0, 2.9, 1.0]), np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1.0]]), 2, 0.2) == [0, 2]
    assert information.log_det_value([0, 1], np.eye(3)) == pytest.approx(2 * math.log(2))


def test_rankers_learn(spark):
    rng = np.random.default_rng(5)
    rows = []
    for q in range(8):
        for i in range(10):
            x = rng.normal(size=2)
            rows.append((q, i, x.tolist(), int(np.clip(round(1.5 + x[0]), 0, 3))))
    df = spark.createDataFrame(rows, "qid long, doc_id long, x array<double>, grade int").cache()
    w = learning.fit_pairwise(learning.preference_pairs(df), 2, 5)
    assert w[0] > 3 * abs(w[1])
    before = learning.pairwise_loss(learning.preference_pairs(df), [0.0, 0.0]).first()["loss"]
    assert learning.pairwise_loss(learning.preference_pairs(df), w).first()["loss"] < before
    force = learning.fit_lambda(df, 2, 4)
    assert force[0] > abs(force[1])


def test_graph_algorithms():
    a = np.zeros((8, 8))
    for g in ((0, 1, 2, 3), (4, 5, 6, 7)):
        for i, j in itertools.combinations(g, 2):
            a[i, j] = a[j, i] = 1
    a[3, 4] = a[4, 3] = 1
    halves = np.array([0] * 4 + [1] * 4)
    for found in (graphs.louvain(a), graphs.leiden(a), graphs.spectral_halves(a), graphs.best_halves(a)):
        assert graphs.label_overlap(halves, found) == 1.0
    assert graphs.dense_modularity(a, halves) == pytest.approx(graphs.dense_modularity(a, graphs.louvain(a)))
    assert graphs.spectral_halves(np.ones((4, 4)) - np.eye(4)) is None
    assert graphs.split_disconnected(np.zeros((3, 3)), np.zeros(3, int)).tolist() == [0, 1, 2]


def test_components_of_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 500]], "node long")
    got = {r["node"]: r["component"] for r in graphs.components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 500: 500}


def test_segmentation():
    rng = np.random.default_rng(6)
    for _ in range(20):
        x, k = rng.normal(size=(9, 3)), 3
        cost = graphs.segment_costs(x)
        best = min(cost[0, a] + cost[a, b] + cost[b, 9] for a, b in itertools.combinations(range(1, 9), 2))
        s = [*graphs.best_segments(x, k), 9]
        assert sum(cost[a, b] for a, b in itertools.pairwise(s)) == pytest.approx(best)
    assert graphs.boundary_f1([3, 7], [4, 20]) == 0.5 and graphs.boundary_f1([], []) == 0.0


def test_conformal(spark):
    s = spark.createDataFrame([(float(i),) for i in range(1, 10)], "s double")
    assert generation.conformal_quantile(s, 0.2) == 8.0 and generation.conformal_quantile(s, 0.01) == math.inf
    w = s.withColumn("w", F.lit(1.0))
    assert generation.weighted_conformal_quantile(w, 0.2, 1.0) == 8.0


def test_as_of_and_bands(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "k int, t int, v string")
    got = {(r["k"], r["t"]): r["asof_v"] for r in relational_ops.as_of(left, right, "k", "t", ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}
    x = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 7.0)], "x double")
    assert [r["band"] for r in relational_ops.range_join(x, [0.0, 1.0], "x").orderBy("x").collect()] == [0, 1, 1, 2, 2]


def test_plans(spark):
    df = spark.createDataFrame([("a", 1.0)] * 50 + [("b", 2.0)], "k string, v double")
    assert {r["k"]: r["v"] for r in ranking.salted_sum(df, ["k"], "v").collect()} == {"a": 50.0, "b": 2.0}
    lse = ranking.log_sum_exp(spark.createDataFrame([("a", 1000.0), ("a", 1000.0)], "k string, s double"), ["k"], "s").first()["lse"]
    assert math.isclose(lse, 1000 + math.log(2))


def test_running_sums(spark):
    rng = np.random.default_rng(7)
    x, v = rng.integers(0, 40, 500), rng.integers(0, 9, 500)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, v, strict=True))], "id long, x double, v long").repartition(3)
    for buckets in (1, 7, 64):
        got = {r["id"]: (r["up"], r["i"]) for r in ranking.running_sums(df.withColumn("one", F.lit(1)), "x", {"up": "v", "i": "one"}, ["id"], buckets).collect()}
        order = np.lexsort((np.arange(500), x))
        sums = np.cumsum(v[order])
        assert got == {int(i): (int(sums[k]), k + 1) for k, i in enumerate(order)}
    assert ranking.running_sums(df.where("false"), "x", {"up": "v"}).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: x\n---\nbody\n")
    (tmp_path / "b.md").write_text("no header")
    rows = {r["body"]: r["header"] for r in tables.front_matter(spark, str(tmp_path)).collect()}
    assert rows == {"body\n": "title: x", "no header": None}
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    degrees, bad = tables.prerequisite_graph(nodes, edges)
    assert {r["id"]: (r["out_degree"], r["in_degree"]) for r in degrees.collect()} == {"a": (2, 0), "b": (0, 1)} and bad.count() == 1
    tables.write_table(nodes, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_lexical_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta"), (4, "Alpha alpha")], "doc_id long, text string")
    index = lexical.build_index(docs)
    assert index.stats.first()["n"] == 4 and index.stats.first()["avgdl"] == 1.0
    ask = lexical.query_terms(spark.createDataFrame([(1, "ALPHA unknown")], "qid long, text string"))
    assert [r["doc_id"] for r in lexical.bm25_rank(index, ask).orderBy("rank").collect()] == [4, 3]
    for method, param in (("dirichlet", 100.0), ("jm", 0.5), ("none", 0.0)):
        assert lexical.ql_scores(index, ask, method, param).count() == 2
    with pytest.raises(ValueError):
        lexical.ql_scores(index, ask, "other", 0.0)


def test_pruned_rankings_equal_exhaustive_ones(spark):
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=60))) for i in range(1500)], "doc_id long, text string")
    ask = lexical.query_terms(spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=8))) for i in range(30)] + [(99, "w399"), (100, "nothing")], "qid long, text string"))
    index = lexical.stored_index(docs)
    exhaustive = {(r["qid"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in lexical.bm25_rank(index, ask, 10).collect()}
    all_scored = lexical.bm25_scores(index, ask).count()
    scored = []
    for pruned in (lexical.wand_topk(index, ask, 10), lexical.block_max_topk(index, ask, 10, 50)):
        rows = pruned.collect()
        assert {(r["qid"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in rows} == exhaustive
        scored.append(sum({r["qid"]: r["scored"] for r in rows}.values()))
    assert scored[1] <= scored[0] < all_scored / 4


def test_saved_index_ranks_alike(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 4)} gamma{i % 3}") for i in range(30)], "doc_id long, text string")
    index = lexical.build_index(docs)
    lexical.save_index(index, str(tmp_path / "index"))
    again = lexical.load_index(spark, str(tmp_path / "index"))
    ask = lexical.query_terms(spark.createDataFrame([(1, "beta gamma1"), (2, "gamma2")], "qid long, text string"))
    rows = [sorted((r["qid"], r["doc_id"], round(r["score"], 9)) for r in lexical.bm25_rank(i, ask, 30).collect()) for i in (index, again)]
    assert rows[0] == rows[1] and len(rows[0]) > 20


def test_rotations_and_weighted_codebooks(spark):
    rng = np.random.default_rng(12)
    mix = rng.normal(size=(8, 8))
    x = rng.normal(size=(400, 8)) * np.array([4, 3, 2, 1, 0.5, 0.5, 0.2, 0.1]) @ mix
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>").repartition(3)
    turn, books, history = ann.train_rotated(df, 8, 2, 8, rounds=4)
    assert np.allclose(turn @ turn.T, np.eye(8)) and all(b <= a + 1e-6 for a, b in zip(history, history[1:])) and history[-1] < history[0]
    code = ann.product_decode(ann.product_codes(x @ turn.T, books), books)
    assert ((x @ turn.T - code) ** 2).sum() <= history[-1] + 1e-6
    for eta in (1.0, 5.0):
        book, falls = ann.anisotropic_lloyd(df, x[:6], eta, 5)
        assert all(b <= a + 1e-6 for a, b in zip(falls, falls[1:]))
        far = ann.anisotropic_distances(x, book, eta)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        r = x[0] - book[2]
        along = (r @ unit[0]) ** 2
        assert np.isclose(far[0, 2], eta * along + (r @ r - along))
    plain, _ = ann.lloyd(df, x[:6], 5)
    same, _ = ann.anisotropic_lloyd(df, x[:6], 1.0, 5)
    assert np.allclose(plain, same)


def test_stored_graphs_and_deletion(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist(), i % 3 > 0) for i, v in enumerate(x)], "doc_id long, vec array<double>, live boolean")
    queries = df.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec")
    stored = ann.store_graph(df, shard_rows=150)
    assert stored.count() == 300 and stored.where("entry").count() == stored.select("shard").distinct().count() == 2
    direct, again = ann.graph_search(queries, df, 5, 200, shard_rows=150), ann.search_graph(queries, stored, 5, 200)
    key = lambda f: {(r["qid"], r["rank"]): r["doc_id"] for r in f.collect()}
    exact = key(dense.knn(queries, df, 5, "euclidean"))
    assert key(direct) == key(again) and sum(key(again)[k] == v for k, v in exact.items()) >= 0.95 * len(exact)
    left = df.where("live")
    truth = key(dense.knn(queries, left, 5, "euclidean"))
    repaired = ann.delete_from_graph(stored, df.where("not live"))
    links = {j for r in repaired.collect() for layer in r["links"] for j in layer}
    assert repaired.count() == 200 and all(j % 3 for j in links)
    for found in (ann.search_graph(queries, repaired, 5, 200), ann.search_graph(queries, ann.store_graph(df, shard_rows=150, live="live"), 5, 200)):
        assert sum(key(found).get(k) == v for k, v in truth.items()) >= 0.95 * len(truth)
    assert ann.search_graph(queries, ann.delete_from_graph(stored, df), 5).count() == 0


def planted(seed=1, groups=4, size=25, inside=0.4, across=0.02):
    import random

    rng = random.Random(seed)
    n = groups * size
    edges = [(i, j, 1.0) for i in range(n) for j in range(i + 1, n) if rng.random() < (inside if i // size == j // size else across)]
    return n, size, edges


def test_communities_of_a_planted_graph(spark):
    n, size, edges = planted()
    nodes, e = spark.range(n).select(F.col("id").alias("node")), spark.createDataFrame(edges, "src long, dst long, w double")
    truth = graphs.modularity(e, nodes.select("node", F.floor(F.col("node") / size).alias("label"))).first()[0]
    for refined in (False, True):
        labels, history = graphs.communities(nodes, e, refined=refined)
        found = {r["node"]: r["label"] for r in labels.collect()}
        assert len(found) == n and history == sorted(history, key=lambda h: h[1])
        shared = np.array([found[i] for i in range(n)])
        assert graphs.label_overlap(np.arange(n) // size, np.unique(shared, return_inverse=True)[1]) >= 0.95
        assert graphs.modularity(e, labels).first()[0] >= truth - 0.02
        if refined:  # every community is connected
            inside = [(a, b) for a, b, _ in edges if found[a] == found[b]]
            label = {i: i for i in range(n)}
            for _ in range(n):
                for a, b in inside:
                    label[a] = label[b] = min(label[a], label[b])
            assert len(set(label.values())) == len(set(found.values()))


def test_listwise_and_pointwise_fits(spark):
    rng = np.random.default_rng(3)
    rows = [(q, i, rng.normal(size=2).tolist()) for q in range(30) for i in range(6)]
    rows = [(q, i, x, int(np.clip(round(1.5 + 1.2 * x[0] - 0.4 * x[1]), 0, 3))) for q, i, x in rows]
    df = spark.createDataFrame(rows, "qid long, doc_id long, x array<double>, grade long").cache()
    for kind, loss in (("permutation", learning.permutation_loss), ("top_one", learning.top_one_loss)):
        w = learning.fit_listwise(df, 2, kind)
        before, after = (loss(df, learning.linear(v)).agg(F.sum("loss")).first()[0] for v in ([0.0, 0.0], w))
        nudged = min(loss(df, learning.linear([w[0] + a, w[1] + b])).agg(F.sum("loss")).first()[0] for a, b in ((0.3, 0), (-0.3, 0), (0, 0.3), (0, -0.3)))
        assert after < 0.8 * before and w[0] > 0 > w[1] and nudged > after - 1.0
    with pytest.raises(ValueError):
        learning.fit_listwise(df, 2, "other", 1)
    x, y = np.array([[*r[2], 1.0] for r in rows]), np.array([r[3] for r in rows], float)
    assert np.allclose(learning.fit_pointwise(df, 2), np.linalg.solve(x.T @ x + 1e-3 * np.eye(3), x.T @ y))


def test_as_of_takes_one_row_whole(spark):
    left = spark.createDataFrame([("a", 5), ("a", 0), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 7, 1), ("a", 3, None, 2)], "k string, t int, v int, w int")
    got = {(r["k"], r["t"]): (r["asof_v"], r["asof_w"]) for r in relational_ops.as_of(left, right, "k", "t", ["v", "w"]).collect()}
    assert got == {("a", 5): (None, 2), ("a", 0): (None, None), ("b", 9): (None, None)}


def test_isotonic_is_exact_and_pooled_in_ranges(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.normal(0, 3, 3000), 6)
    y = (rng.random(3000) < 1 / (1 + np.exp(-p))).astype(int)
    t, v = evaluation.isotonic(spark.createDataFrame(list(zip(p.tolist(), y.tolist(), strict=True)), "p double, y int"))
    blocks = []
    for s in np.unique(p):
        blocks.append([s, float(y[p == s].sum()), float((p == s).sum())])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, b, n = blocks.pop()
            blocks[-1][1] += b
            blocks[-1][2] += n
    assert t == [b[0] for b in blocks] and np.allclose(v, [b[1] / b[2] for b in blocks])


def test_paired_bootstrap_and_decay(spark):
    rng = np.random.default_rng(6)
    hard = rng.normal(0.5, 0.2, 60)
    rows = [("then", i, float(x)) for i, x in enumerate(hard)] + [("now", i, float(x - 0.02 + rng.normal(0, 0.005))) for i, x in enumerate(hard)]
    samples = spark.createDataFrame(rows, "leg string, qid long, v double")
    seen = evaluation.decay(samples, "v", "then", "now")
    assert seen["overlap"] and seen["p"] < 1e-6 and abs(seen["shift"] + 0.02) < 0.005 and 0 < seen["gap"] < 0.3
    d = evaluation.paired_differences(samples, "v", "now", "then")
    b = evaluation.paired_bootstrap(d, 800)
    assert b["p"] < 0.01 and b["low"] < seen["shift"] < b["high"] < 0
    assert evaluation.paired_bootstrap(spark.createDataFrame([], "qid long, d double"))["p"] == 1.0


def test_cones_and_shifts(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(40, 6)) + 2, rng.normal(size=(40, 6))
    pairs = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "pair_id long, x array<double>, y array<double>")
    gap = crossmodal.gap_vector(pairs)
    assert np.allclose(gap, (x - y).mean(0))
    at = {(r["pair_id"], r["side"]): r["vec"] for r in crossmodal.cones(pairs).collect()}
    both = np.concatenate([x, y]) - np.concatenate([x, y]).mean(0)
    _, s, _ = np.linalg.svd(both, full_matrices=False)
    found = np.array([at[i, "x"] for i in range(40)] + [at[i, "y"] for i in range(40)])
    assert found.shape == (80, 2) and np.allclose(np.sqrt((found**2).sum(0)), s[:2])
    moved = crossmodal.shifted(pairs.select("pair_id", F.col("y").alias("vec")), gap, 1.0).orderBy("pair_id").collect()
    assert np.allclose([r["vec"] for r in moved], y + gap)


def test_ranking_principle_edges(spark):
    rows = spark.createDataFrame([(1, 10, 1, 0.2), (1, 11, 2, 0.9), (1, 12, 3, 0.5), (2, 10, 1, 0.5)], "qid long, doc_id long, rank long, p double")
    assert {r["qid"]: r["inversions"] for r in principle.inversions(rows).collect()} == {1: 2, 2: 0}
    now = rows
    for _ in range(3):  # as many steps as there are inversions sort a query
        now = principle.bubble_step(now)
    best = principle.by_probability(rows)
    key = lambda df: {(r["qid"], r["doc_id"]): r["rank"] for r in df.collect()}
    assert key(now) == key(best)
    for k in (1, 2, 3):
        a, b = (principle.expected_relevant(x, k).orderBy("qid").collect()[0]["expected"] for x in (rows, best))
        assert a <= b + 1e-12


def _shuffled(spark):
    """Bytes written to shuffles by all stages so far."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize(("name", "most"), [("expanded_query_topk", 1.6e6), ("rocchio_topk", 4e6), ("bm25_parameter_grid", 1.4e6)])
def test_ranking_shuffles_no_pairs(spark, name, most):
    """Postings and pairs of a query and a document stay where they are."""
    from ferrule.queries import lexical as queries

    before = _shuffled(spark)
    queries.book.queries[name](spark, "/root/testdata/sf0.001").collect()
    assert _shuffled(spark) - before < most


@pytest.fixture(scope="module")
def few_texts(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 60)) if x < 400) + (f" only{i}" if i % 3 else "")) for i in range(150)]
    texts += [(200, None), (201, ""), (202, texts[0][1]), (203, texts[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, texts[q * 7][1] + " unheard") for q in range(1, 12)] + [(99, "unheard of")], "qid long, text string")
    return forward.forward_index(docs), lexical.stored_index(docs), lexical.query_terms(asked)


@pytest.mark.parametrize("bounds", [{}, {"MOST_VALUES": 40, "PAIRS": 20, "POSTINGS": 30, "MOST_TERMS": 5}, {"MOST_MODEL_ROWS": 20, "MOST_QUERIES": 2, "MOST_TERMS": 0}])
def test_forward_rankings_equal_relational_ones(few_texts, monkeypatch, bounds):
    ahead, index, queries = few_texts
    for name, value in bounds.items():
        monkeypatch.setattr(forward, name, value)
    key = lambda df: {(r["qid"], r["rank"]): (r["doc_id"], round(r["score"], 8)) for r in df.collect()}
    feedback = lexical.bm25_rank(index, queries, 5)
    assert key(forward.bm25_rank(ahead, queries, 5)) == key(feedback) != {}
    assert key(forward.ql_rank(ahead, queries, 10)) == key(lexical.ql_rank(index, queries, 10))
    few = ahead.only(feedback)
    model = lambda x: lexical.expanded_model(x, feedback, queries)
    assert key(forward.ql_rank(ahead, model(few).withColumnRenamed("p", "qtf"))) == key(ranking.top_k(lexical.model_scores(index, model(index)), 10))
    assert key(forward.rocchio_rank(ahead, lexical.rocchio_query(few, feedback, queries))) == key(ranking.top_k(lexical.rocchio_scores(index, feedback, queries), 10))


def test_forward_index_merges_rows_of_an_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "B c"), (2, None)], "doc_id long, text string")
    index = forward.forward_index(docs)
    assert {r["term"]: (r["df"], r["cf"]) for r in index.terms.collect()} == {"a": (1, 1), "b": (1, 2), "c": (1, 1)}
    assert tuple(index.stats.first()) == (2, 2.0, 4)
    assert forward.bm25_rank(index, spark.createDataFrame([(1, "z", 1)], "qid long, term string, qtf long")).count() == 0
