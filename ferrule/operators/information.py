"""Information theory of retrieval, attention over contexts, context selection, multi-hop reading.

Distributions are long: (qid, doc_id, p) and (qid, doc_id, a, p). Logarithms are
to base 2 (bits) unless a name says nats.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..plans.ranking import softmax


def entropy_of(p: Column) -> Column:
    """One summand of the entropy in bits; 0 at p = 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def divergence_of(p: Column, q: Column) -> Column:
    """One summand of KL(p || q) in bits; infinite where q has no support."""
    return F.when(p <= 0, 0.0).when(q <= 0, F.lit(math.inf)).otherwise(p * F.log2(p / q))


def retrieval_distribution(scores: DataFrame, tau: float = 0.1) -> DataFrame:
    """(qid, doc_id, pd): softmax of a query's scores."""
    return scores.select("qid", "doc_id", softmax(F.col("score"), "qid", tau).alias("pd"))


def answer_posteriors(pairs: DataFrame, prototypes: DataFrame, tau: float = 0.25) -> DataFrame:
    """(qid, doc_id, a, p): softmax of (q + d) . prototype over the answers; prototypes are few and sent to every task."""
    x = pairs.crossJoin(F.broadcast(prototypes)).select("qid", "doc_id", "a", (dot("qvec", "proto") + dot("dvec", "proto")).alias("s"))
    return x.select("qid", "doc_id", "a", softmax(F.col("s"), ["qid", "doc_id"], tau).alias("p"))


def answer_priors(posteriors: DataFrame, retrieval: DataFrame) -> DataFrame:
    """(qid, a, prior): the posterior averaged over the retrieval distribution."""
    return posteriors.join(retrieval, ["qid", "doc_id"]).groupBy("qid", "a").agg(F.sum(F.col("pd") * F.col("p")).alias("prior"))


def pointwise_information(posteriors: DataFrame, priors: DataFrame) -> DataFrame:
    """(qid, doc_id, a, pmi) in bits."""
    return posteriors.join(priors, ["qid", "a"]).select("qid", "doc_id", "a", F.log2(F.col("p") / F.col("prior")).alias("pmi"))


def information_of_documents(posteriors: DataFrame, priors: DataFrame) -> DataFrame:
    """(qid, doc_id, bits): KL of a document's posterior from the prior."""
    both = posteriors.join(priors, ["qid", "a"])
    return both.groupBy("qid", "doc_id").agg(F.sum(divergence_of(F.col("p"), F.col("prior"))).alias("bits"))


def conditional_information(posteriors: DataFrame, priors: DataFrame, retrieval: DataFrame) -> DataFrame:
    """(qid, prior_entropy, rest_entropy, bits): what retrieval tells of the answer, as a fall of entropy."""
    h0 = priors.groupBy("qid").agg(F.sum(entropy_of(F.col("prior"))).alias("prior_entropy"))
    h1 = posteriors.groupBy("qid", "doc_id").agg(F.sum(entropy_of(F.col("p"))).alias("h")).join(retrieval, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(F.col("pd") * F.col("h")).alias("rest_entropy"))
    return h0.join(h1, "qid").withColumn("bits", F.col("prior_entropy") - F.col("rest_entropy"))


def query_document_information(retrieval: DataFrame) -> DataFrame:
    """(bits): mean KL of the queries' retrieval distributions from their mean."""
    n = retrieval.select("qid").distinct().agg(F.count("*").alias("n"))
    mean = retrieval.crossJoin(F.broadcast(n)).groupBy("doc_id").agg((F.sum("pd") / F.first("n")).alias("pm"))
    kl = retrieval.join(mean, "doc_id").groupBy("qid").agg(F.sum(divergence_of(F.col("pd"), F.col("pm"))).alias("kl"))
    return kl.agg(F.avg("kl").alias("bits"))


def erasure_sweep(posteriors: DataFrame, priors: DataFrame, gold: DataFrame, recalls: list[float]) -> DataFrame:
    """(recall, entropy, error): the gold document's posterior arrives with that probability, else only the prior is known."""
    clean = posteriors.join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(entropy_of(F.col("p"))).alias("h1"), (1 - F.max("p")).alias("e1"))
    blank = priors.groupBy("qid").agg(F.sum(entropy_of(F.col("prior"))).alias("h0"), (1 - F.max("prior")).alias("e0"))
    x = clean.join(blank, "qid").withColumn("recall", F.explode(F.array(*[F.lit(float(x)) for x in recalls])))
    mixed = lambda a, b: F.avg(F.col("recall") * F.col(a) + (1 - F.col("recall")) * F.col(b))
    return x.groupBy("recall").agg(mixed("h1", "h0").alias("entropy"), mixed("e1", "e0").alias("error"))


def belief_error(belief: Column) -> Column:
    """Chance that the likeliest answer of a belief is wrong by the belief itself: an aggregate over its probabilities."""
    return 1 - F.max(belief)


def substitution_sweep(posteriors: DataFrame, gold: DataFrame, distractors: DataFrame, answers: DataFrame, shares: list[float]) -> DataFrame:
    """(share, realised, believed, entropy): with that probability the gold document is replaced by a distractor.

    ``answers`` (qid, a) has the true answers. realised is the error against
    them, believed the error the belief admits; their gap is confident error.
    """

    def read(documents):
        own = posteriors.join(documents, ["qid", "doc_id"])
        best = own.groupBy("qid").agg(F.min_by("a", F.struct(-F.round("p", 9), F.col("a"))).alias("said"), belief_error(F.col("p")).alias("believed"), F.sum(entropy_of(F.col("p"))).alias("entropy"))
        return best.join(answers, "qid").select("qid", (F.col("said") != F.col("a")).cast("double").alias("realised"), "believed", "entropy")

    names = ("realised", "believed", "entropy")
    both = read(gold).join(read(distractors).select("qid", *[F.col(c).alias(f"{c}_d") for c in names]), "qid").withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return both.groupBy("share").agg(*[F.avg((1 - F.col("share")) * F.col(c) + F.col("share") * F.col(f"{c}_d")).alias(c) for c in names])


def attention_mixture(ranked: DataFrame, k: int, tau: float) -> DataFrame:
    """(qid, pos-wise mixture): attention-weighted mean vector of a query's first k documents (qid, doc_id, score, rank, dvec)."""
    own = ranked.where(F.col("rank") <= k).withColumn("w", softmax(F.col("score"), "qid", tau))
    parts = own.select("qid", "w", F.posexplode("dvec").alias("pos", "x")).groupBy("qid", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return parts.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mix"))


# Context selection inside one query's pool (bounded by the pool's size).
def facility_value(chosen: list[int], similarity: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Weighted sum over all items of the best similarity to a chosen one."""
    if not chosen:
        return 0.0
    best = similarity[:, chosen].max(axis=1)
    return float(best.sum() if weights is None else (weights * best).sum())


def log_det_value(chosen: list[int], kernel: np.ndarray) -> float:
    """log det(I + L_S): the diversity of a chosen set."""
    if not chosen:
        return 0.0
    return float(np.linalg.slogdet(np.eye(len(chosen)) + kernel[np.ix_(chosen, chosen)])[1])


def greedy(value: Callable[[list[int]], float], n: int, k: int) -> list[int]:
    """Largest gain first; ties go to the lowest index. Gains are kept as upper bounds and only refreshed at the top."""
    bound = [math.inf] * n
    chosen: list[int] = []
    now = value([])
    while len(chosen) < min(k, n):
        fresh: set[int] = set()
        while True:
            i = max((j for j in range(n) if j not in chosen), key=lambda j: (round(bound[j], 12) if bound[j] < math.inf else math.inf, -j))
            if i in fresh:
                break
            bound[i] = value([*chosen, i]) - now
            fresh.add(i)
        chosen.append(i)
        now += bound[i]
    return chosen


def best_subset(value: Callable[[list[int]], float], n: int, k: int) -> list[int]:
    return list(max(combinations(range(n), min(k, n)), key=lambda s: value(list(s))))


def marginal_relevance(relevance: np.ndarray, similarity: np.ndarray, k: int, balance: float = 0.5) -> list[int]:
    """Relevance against the best similarity to what is chosen."""
    chosen: list[int] = []
    while len(chosen) < min(k, len(relevance)):
        near = similarity[:, chosen].max(axis=1) if chosen else np.zeros(len(relevance))
        score = np.round(balance * relevance - (1 - balance) * near, 12)
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
    return chosen


def select_contexts(pools: DataFrame, k: int, method: str, balance: float = 0.5) -> DataFrame:
    """(qid, doc_id, place): k documents of each query's pool (qid, doc_id, rank, score, dvec).

    Methods: top (by score), mmr, coverage (facility location), diverse
    (determinantal). A group is one query's pool, whose size the caller bounds.
    """

    def one(key, group):
        rank = group.column("rank").to_numpy()
        order = np.argsort(rank)
        ids = group.column("doc_id").to_numpy()[order]
        score = group.column("score").to_numpy()[order]
        x = np.array(group.column("dvec").to_pylist(), float)[order]
        x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        gram = x @ x.T
        if method == "top":
            chosen = list(range(min(k, len(ids))))
        elif method == "mmr":
            chosen = marginal_relevance(score, gram, k, balance)
        elif method == "coverage":
            chosen = greedy(lambda s: facility_value(s, np.maximum(gram, 0), np.maximum(score, 0)), len(ids), k)
        elif method == "diverse":
            quality = np.exp(score)
            chosen = greedy(lambda s: log_det_value(s, quality[:, None] * gram * quality[None, :]), len(ids), k)
        else:
            raise ValueError(f"unknown method {method}")
        return pa.table({"qid": pa.array([key[0].as_py()] * len(chosen), pa.int64()), "doc_id": pa.array(ids[chosen], pa.int64()), "place": pa.array(range(1, len(chosen) + 1), pa.int64())})

    return pools.select("qid", "doc_id", "rank", "score", "dvec").groupBy("qid").applyInArrow(one, "qid bigint, doc_id bigint, place bigint")
