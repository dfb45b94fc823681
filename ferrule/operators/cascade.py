"""Multi-stage retrieval: token-level cascades, retention of stages, budgets, noisy channels of stages."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import normal_quantile
from ..functions.vectors import dot
from ..plans.durable import written
from ..plans.ranking import top_k
from .ann import assign


def token_cells(doc_tokens: DataFrame, book: np.ndarray) -> DataFrame:
    """doc_tokens (doc_id, dtok, dvec) with the cell of their nearest centroid."""
    return assign(doc_tokens, book, "dvec").select("doc_id", "dtok", "dvec", "cell")


def _centroids(spark, book: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(book)], "cell long, centroid array<double>")


def token_scores(query_tokens: DataFrame, book: np.ndarray) -> DataFrame:
    """(qid, qtok, cell, s): inner products of query tokens and centroids, few rows a query."""
    return query_tokens.crossJoin(F.broadcast(_centroids(query_tokens.sparkSession, book))).select("qid", "qtok", "cell", dot("qvec", "centroid").alias("s"))


def probe_candidates(scores: DataFrame, cells: DataFrame, nprobe: int) -> DataFrame:
    """(qid, doc_id): documents that own a token in one of the nprobe best cells of a query token."""
    best = top_k(scores, nprobe, ["qid", "qtok"], "s", "cell").select("qid", "cell").distinct()
    return best.join(cells.select("cell", "doc_id").distinct(), "cell").select("qid", "doc_id").distinct()


def centroid_scores(scores: DataFrame, cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, doc_id, score): late interaction with every document token replaced by its centroid."""
    owned = candidates.join(cells.select("doc_id", "cell").distinct(), "doc_id")
    best = owned.join(scores, ["qid", "cell"]).groupBy("qid", "doc_id", "qtok").agg(F.max("s").alias("s"))
    return best.groupBy("qid", "doc_id").agg(F.sum("s").alias("score"))


# Documents that own the same cells are candidates of the same queries with the same centroid score, so queries
# meet the different sets of cells (of 16 cells and four tokens at most 2516), not the documents.
def cell_sets(cells: DataFrame, k: int = 1) -> DataFrame:
    """(set, first, n, docs): the different sets of cells that documents own, each with its smallest document, their number and the k smallest."""
    own = written(cells.groupBy("doc_id").agg(F.sort_array(F.collect_set("cell")).alias("set")))
    size = own.groupBy("set").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("set").orderBy("doc_id"))
    docs = own.withColumn("place", place).where(F.col("place") <= k).groupBy("set").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    return written(docs.join(size, "set").select("set", F.col("docs")[0].alias("first"), "n", "docs"))


def probed_cells(scores: DataFrame, nprobe: int) -> DataFrame:
    """(qid, probed): the nprobe best cells of each of a query's tokens, as a sorted set."""
    best = top_k(scores, nprobe, ["qid", "qtok"], "s", "cell")
    return best.groupBy("qid").agg(F.sort_array(F.collect_set("cell")).alias("probed"))


def met_sets(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """(asked's columns, set, first, n): the sets that share a cell with ``probed``; each pair once, by its smallest shared cell.

    Few small rows meet many, so they are dealt to all tasks by number, not by
    their bytes.
    """
    dealt = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism)
    owned = sets.select("set", "first", "n", F.explode("set").alias("cell"))
    met = dealt.withColumn("cell", F.explode("probed")).join(owned, "cell")
    return met.where(F.array_min(F.array_intersect("probed", "set")) == F.col("cell")).drop("cell")


def candidate_counts(scores: DataFrame, cells: DataFrame, nprobe: int) -> DataFrame:
    """(qid, candidates): how many documents probe_candidates() gives, without naming them.

    Queries that probe the same cells have the same number, so each different
    set of probed cells (of 16 cells, four tokens and two each fewer than
    40,000) meets the sets once.
    """
    probed = written(probed_cells(scores, nprobe))
    counts = met_sets(probed.select("probed").distinct(), cell_sets(cells)).groupBy("probed").agg(F.sum("n").alias("candidates"))
    return probed.join(counts, "probed").select("qid", "candidates")


def centroid_topk(scores: DataFrame, cells: DataFrame, nprobe: int, k: int) -> DataFrame:
    """(qid, doc_id, score, rank): the k best of probe_candidates() by centroid_scores().

    The k best documents lie in the k best sets (ties to the smaller first
    document) and there among the k smallest, so no more are looked at.
    """
    sets = cell_sets(cells, k)
    row = F.sort_array(F.collect_list(F.struct("cell", "s")))
    table = scores.groupBy("qid", "qtok").agg(F.map_from_arrays(F.transform(row, lambda x: x["cell"]), F.transform(row, lambda x: x["s"])).alias("of"))
    table = table.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("qtok", F.map_entries("of").alias("of")))), lambda x: F.map_from_entries(x["of"])).alias("tokens"))
    most = lambda of: F.array_max(F.transform("set", lambda c: F.try_element_at(of, c)))
    score = F.aggregate("tokens", F.lit(0.0), lambda total, of: total + most(of))
    found = top_k(met_sets(probed_cells(scores, nprobe), sets).join(table, "qid").select("qid", "first", score.alias("score")), k, tie="first")
    docs = sets.select("first", F.explode("docs").alias("doc_id"))
    return top_k(found.drop("rank").join(docs, "first").select("qid", "doc_id", "score"), k)


def token_cascade(query_tokens: DataFrame, doc_tokens: DataFrame, book: np.ndarray, nprobe: int = 2, keep: int = 40, k: int = 10) -> DataFrame:
    """Candidates by cells, the best ``keep`` by centroids, exact late interaction on these: (qid, doc_id, score, rank)."""
    from .dense import maxsim

    kept = centroid_topk(token_scores(query_tokens, book), token_cells(doc_tokens, book), nprobe, keep).select("qid", "doc_id")
    return top_k(maxsim(query_tokens, doc_tokens.select("doc_id", "dvec"), kept), k)


def score_error_bound(pairs: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame, book: np.ndarray) -> DataFrame:
    """(qid, doc_id, bound) of the given pairs: the centroid score is off by at most the query tokens' lengths times the document's largest residual."""
    length = query_tokens.groupBy("qid").agg(F.sum(F.sqrt(dot("qvec", "qvec"))).alias("q"))
    residual = assign(doc_tokens, book, "dvec").groupBy("doc_id").agg(F.sqrt(F.max("residual2")).alias("r"))
    return pairs.select("qid", "doc_id").join(length, "qid").join(residual, "doc_id").select("qid", "doc_id", (F.col("q") * F.col("r")).alias("bound"))


def stage_retention(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(retention): mean over queries of kept truth over least(k, relevant)."""
    size = truth.groupBy("qid").agg(F.count("*").alias("n"))
    hit = truth.select("qid", "doc_id").join(found.select("qid", "doc_id").distinct(), ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("h"))
    return size.join(hit, "qid", "left").agg(F.avg(F.least(F.coalesce("h", F.lit(0)), F.lit(k)) / F.least("n", F.lit(k))).alias("retention"))


def pool_recall(ranking: DataFrame, gold: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, recall): share of queries whose gold document is in the first ``depth``: what a perfect reranker of that pool can reach."""
    place = gold.select("qid", "doc_id").join(ranking.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    grid = F.explode(F.array(*[F.lit(int(x)) for x in depths])).alias("depth")
    return place.select("qid", "rank", grid).groupBy("depth").agg(F.avg(F.coalesce(F.col("rank") <= F.col("depth"), F.lit(False)).cast("double")).alias("recall"))


def rerank_outcomes(ranking: DataFrame, rescored: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    """(fixed, kept, broke, missed, lift): queries whose first place a reranking of the first ``depth`` mends, keeps, spoils or misses.

    ``rescored`` (qid, doc_id, score) has the new scores; lift is fixed less broke over all queries.
    """
    pool = ranking.where(F.col("rank") <= depth).select("qid", "doc_id").join(rescored.select("qid", "doc_id", "score"), ["qid", "doc_id"])
    after = top_k(pool.select("qid", "doc_id", "score"), 1).select("qid", F.col("doc_id").alias("after"))
    before = ranking.where("rank = 1").select("qid", F.col("doc_id").alias("before"))
    each = gold.select("qid", "doc_id").join(before, "qid").join(after, "qid", "left").select((F.col("before") == F.col("doc_id")).alias("b"), F.coalesce(F.col("after") == F.col("doc_id"), F.lit(False)).alias("a"))
    counts = each.agg(*[F.count_if(c).alias(x) for x, c in (("fixed", F.expr("not b and a")), ("kept", F.expr("b and a")), ("broke", F.expr("b and not a")), ("missed", F.expr("not b and not a")))], F.count("*").alias("n"))
    return counts.select("fixed", "kept", "broke", "missed", ((F.col("fixed") - F.col("broke")) / F.col("n")).alias("lift"))


def tombstone_scans(ranking: DataFrame, shares: list[float], k: int = 10, seed: int = 0) -> DataFrame:
    """(share, scanned, predicted): places read until k live documents are found when a share of all is dead, and k / (1 - share).

    Documents are dead by dice.mixed of their id; queries that find fewer than k live ones in their ranking don't count.
    """
    from ..functions.dice import PRIME, mixed

    if any(not 0 <= s < 1 for s in shares):
        raise ValueError("shares must be in [0, 1)")
    rows = ranking.select("qid", "doc_id", "rank", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    live = rows.where(mixed("doc_id", F.lit(seed)) >= F.ceil(F.col("share") * PRIME))
    kth = top_k(live.withColumn("score", -F.col("rank").cast("double")).drop("rank"), k, ["qid", "share"]).where(F.col("rank") == k)
    return kth.groupBy("share").agg(F.avg(-F.col("score")).alias("scanned")).withColumn("predicted", k / (1 - F.col("share")))


def dependent_cascade(r1: float, r2: float, rho: float, n: int = 40_000, seed: int = 0) -> dict[str, float]:
    """Joint retention of two stages whose failures correlate, by a Gaussian copula; and the independent product."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    b = rho * a + math.sqrt(1 - rho * rho) * rng.normal(size=n)
    both = ((a < normal_quantile(r1)) & (b < normal_quantile(r2))).mean()
    return {"joint": float(both), "independent": r1 * r2}


def allocate_budget(curves: dict[str, list[tuple[float, float]]], budget: float) -> dict[str, int]:
    """Steps along each stage's (cost, recall) curve, always the one of most log-recall a unit of cost, while the budget lasts.

    An error is raised where even the cheapest steps cost more than the budget.
    """
    at = dict.fromkeys(curves, 0)
    spent = sum(c[0][0] for c in curves.values())
    if spent > budget + 1e-12:
        raise ValueError("the cheapest allocation is over the budget")
    while True:
        options = []
        for stage, curve in curves.items():
            if at[stage] + 1 < len(curve):
                (c0, r0), (c1, r1) = curve[at[stage]], curve[at[stage] + 1]
                if spent + c1 - c0 <= budget + 1e-12 and r1 > r0:
                    options.append(((math.log(r1) - math.log(max(r0, 1e-12))) / max(c1 - c0, 1e-12), stage, c1 - c0))
        if not options:
            return at
        _, stage, cost = max(options, key=lambda o: (o[0], o[1]))
        at[stage] += 1
        spent += cost


def reformulated_walk(queries: DataFrame, corpus: DataFrame, hops: int = 3) -> DataFrame:
    """(qid, hop, doc_id): retrieve, read, ask for what the read document says beyond the query, skip what was read."""
    from ..functions.vectors import orthogonal_part
    from ..plans.durable import written
    from .dense import knn

    asked, read = queries.select("qid", "vec"), None
    for hop in range(1, hops + 1):
        found = knn(asked, corpus, hop, "cosine", skip_self=True)
        new = found if read is None else found.join(read.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        best = new.groupBy("qid").agg(F.min_by("doc_id", "rank").alias("doc_id")).withColumn("hop", F.lit(hop).cast("bigint")).select("qid", "hop", "doc_id")
        read = written(best if read is None else read.unionByName(best))
        last = read.where(F.col("hop") == hop).join(corpus.select("doc_id", "vec"), "doc_id").join(asked.withColumnRenamed("vec", "qv"), "qid")
        asked = written(last.select("qid", orthogonal_part("vec", "qv").alias("vec")))
    return read


# Small-world routing and resilience of graphs.
def ring_contacts(n: int, alpha: float, seed: int = 0) -> np.ndarray:
    """One long-range contact of each place on a ring, with odds distance^-alpha."""
    rng = np.random.default_rng(seed)
    distance = np.minimum(np.arange(1, n), n - np.arange(1, n)).astype(float)
    odds = distance**-alpha
    return (np.arange(n) + 1 + rng.choice(n - 1, size=n, p=odds / odds.sum())) % n


def greedy_hops(source: int, target: int, contacts: np.ndarray) -> int:
    """Steps of always moving to the neighbour (left, right, contact) nearest to the target."""
    n, at, hops = len(contacts), source, 0
    gap = lambda a: min(abs(a - target), n - abs(a - target))
    while at != target:
        at = min(((at - 1) % n, (at + 1) % n, int(contacts[at])), key=gap)
        hops += 1
    return hops


def retained_component(nodes: DataFrame, edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """(kept, largest): nodes kept with the given probability (by dice.mixed of the node), and their largest component."""
    from ..functions.dice import PRIME, mixed
    from .graphs import components

    kept = nodes.where(mixed("node", F.lit(seed)) < math.ceil(share * PRIME))
    inside = edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    sizes = components(kept, inside).groupBy("component").agg(F.count("*").alias("k"))
    return sizes.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("kept"), F.coalesce(F.max("k"), F.lit(0)).alias("largest"))
