"""Rank fusion and consensus over runs (leg, qid, doc_id, score, rank).

Rank is data: it is never row order. Fused rankings break ties by ascending id.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranking import top_k


def rrf_contributions(run: DataFrame, k: float = 60.0) -> DataFrame:
    return run.select("qid", "doc_id", "leg", (1.0 / (k + F.col("rank"))).alias("contribution"))


def rrf(run: DataFrame, k: float = 60.0, depth: int = 10) -> DataFrame:
    """Sum of 1 / (k + rank); a leg that lacks a document adds nothing."""
    return top_k(rrf_contributions(run, k).groupBy("qid", "doc_id").agg(F.sum("contribution").alias("score")), depth)


def borda(run: DataFrame, depth: int = 10) -> DataFrame:
    """Sum of n - rank with n the number of different documents of the query's legs."""
    n = run.groupBy("qid").agg(F.countDistinct("doc_id").alias("n"))
    totals = run.join(n, "qid").groupBy("qid", "doc_id").agg(F.sum(F.col("n") - F.col("rank")).cast("double").alias("score"))
    return top_k(totals, depth)


def min_max(run: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1] in each leg and query; 0 where all are equal."""
    w = W.partitionBy("leg", "qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return run.withColumn("score", F.when(high == low, 0.0).otherwise((F.col("score") - low) / (high - low)))


def comb_sum(run: DataFrame, normalize: bool = True, depth: int = 10) -> DataFrame:
    """Sum of (scaled) scores, a missing score being 0."""
    scaled = min_max(run) if normalize else run
    return top_k(scaled.groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), depth)


def footrule(run: DataFrame, a: str, b: str) -> DataFrame:
    """(qid, footrule, common): sum of rank differences over the documents both legs have, ranked among these."""
    common = run.where(F.col("leg") == a).select("qid", "doc_id", F.col("rank").alias("ra")).join(run.where(F.col("leg") == b).select("qid", "doc_id", F.col("rank").alias("rb")), ["qid", "doc_id"])
    place = lambda c: F.row_number().over(W.partitionBy("qid").orderBy(c))
    return common.withColumn("pa", place("ra")).withColumn("pb", place("rb")).groupBy("qid").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).cast("bigint").alias("footrule"), F.count("*").alias("common"))


def discordant_pairs(run: DataFrame, a: str, b: str) -> DataFrame:
    """(qid, discordant): pairs of common documents that the legs order differently; legs are as deep as the run."""
    common = run.where(F.col("leg") == a).select("qid", "doc_id", F.col("rank").alias("ra")).join(run.where(F.col("leg") == b).select("qid", "doc_id", F.col("rank").alias("rb")), ["qid", "doc_id"])
    other = common.select("qid", F.col("ra").alias("ra2"), F.col("rb").alias("rb2"))
    pairs = common.join(other, "qid").where("ra < ra2")
    return pairs.groupBy("qid").agg(F.count_if(F.col("rb") > F.col("rb2")).cast("bigint").alias("discordant"))


def majority(run: DataFrame) -> DataFrame:
    """(qid, a, b, wins): legs that rank a above b; a document that a leg lacks is last there."""
    x = run.select("qid", "leg", F.col("doc_id").alias("a"), F.col("rank").alias("ra"))
    docs = run.select("qid", F.col("doc_id").alias("b")).distinct()
    y = run.select("qid", "leg", F.col("doc_id").alias("b"), F.col("rank").alias("rb"))
    return x.join(docs, "qid").where("a <> b").join(y, ["qid", "leg", "b"], "left").where("rb is null or ra < rb").groupBy("qid", "a", "b").agg(F.count("*").alias("wins"))


def kendall_distance(x: list, y: list) -> int:
    """Pairs of the common items that two orders disagree on (a count, no coefficient)."""
    place = {v: i for i, v in enumerate(y)}
    own = [place[v] for v in x if v in place]
    return sum(own[i] > own[j] for i in range(len(own)) for j in range(i + 1, len(own)))


def kemeny_order(rankings: list[list]) -> tuple[list, int]:
    """The order with the least total disagreement, by trying all (up to 8 items); the first of equals."""
    items = sorted({v for ranking in rankings for v in ranking})
    if len(items) > 8:
        raise ValueError("exact consensus is for at most 8 items")
    return min(((list(p), sum(kendall_distance(list(p), ranking) for ranking in rankings)) for p in permutations(items)), key=lambda x: x[1])


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest complete assignment (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def footrule_order(rankings: list[list]) -> list:
    """The order with the least total footrule, as an assignment of items to places."""
    items = sorted({v for ranking in rankings for v in ranking})
    cost = np.zeros((len(items), len(items)))
    for ranking in rankings:
        place = {v: i for i, v in enumerate(ranking)}
        for i, item in enumerate(items):
            cost[i] += np.abs(np.arange(len(items)) - place.get(item, len(items) - 1))
    order = assignment(cost)
    return [items[i] for i in np.argsort(order, kind="stable")]


def markov_chain_order(rankings: list[list], damp: float = 0.05, rounds: int = 500) -> list:
    """From an item move to a random one that most rankings put above it; items by their long-run share."""
    items = sorted({v for ranking in rankings for v in ranking})
    place = [{v: i for i, v in enumerate(ranking)} for ranking in rankings]
    n = len(items)
    move = np.zeros((n, n))
    for i, a in enumerate(items):
        for j, b in enumerate(items):
            wins = sum(p.get(b, n) < p.get(a, n) for p in place)
            move[i, j] = (i != j) * (2 * wins > len(rankings)) / n
        move[i, i] = 1 - move[i].sum()
    move = (1 - damp) * move + damp / n
    share = np.full(n, 1 / n)
    for _ in range(rounds):
        share = share @ move
    return [items[i] for i in np.lexsort((np.arange(n), -np.round(share, 12)))]


CONSENSUS = {"kemeny": lambda rs: kemeny_order(rs)[0], "footrule": footrule_order, "markov": markov_chain_order}


def consensus(run: DataFrame, method: str, depth: int) -> DataFrame:
    """(qid, doc_id, rank): one consensus order a query of the documents in each leg's first ``depth``.

    A query's documents are at most depth times the number of legs, so a group is small whatever the run's size.
    """
    order = CONSENSUS[method]

    def one(key, group):
        rows = sorted(zip(group.column("leg").to_pylist(), group.column("rank").to_pylist(), group.column("doc_id").to_pylist(), strict=True))
        rankings: dict = {}
        for leg, _, doc in rows:
            rankings.setdefault(leg, []).append(doc)
        found = order(list(rankings.values()))
        return pa.table({"qid": pa.array([key[0].as_py()] * len(found), pa.int64()), "doc_id": pa.array(found, pa.int64()), "rank": pa.array(range(1, len(found) + 1), pa.int64())})

    return run.where(F.col("rank") <= depth).select("qid", "leg", "rank", "doc_id").groupBy("qid").applyInArrow(one, "qid bigint, doc_id bigint, rank bigint")


def sliding_window_order(order: list, better, window: int = 20, step: int = 10, passes: int = 1, back_to_front: bool = True) -> list:
    """Passes of sorting one window after another by ``better`` (a key; larger first)."""
    from ..functions.special import window_starts

    out = list(order)
    for _ in range(passes):
        starts = window_starts(len(out), window, step)
        for at in reversed(starts) if back_to_front else starts:
            out[at : at + window] = sorted(out[at : at + window], key=lambda x: -better(x))
    return out
