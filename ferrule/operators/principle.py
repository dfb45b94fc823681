"""The probability ranking principle over rankings (qid, doc_id, rank, p), p being a document's probability of relevance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranking import rank_of


def expected_relevant(ranking: DataFrame, k: int) -> DataFrame:
    """(qid, expected): relevant documents expected in the first k."""
    return ranking.groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, F.col("p")).otherwise(0.0)).alias("expected"))


def expected_cost(ranking: DataFrame, k: int, c_fp: float, c_fn: float) -> DataFrame:
    """(qid, cost): c_fp a document shown in vain plus c_fn a relevant one below the cut, as expected."""
    cost = F.when(F.col("rank") <= k, c_fp * (1 - F.col("p"))).otherwise(c_fn * F.col("p"))
    return ranking.groupBy("qid").agg(F.sum(cost).alias("cost"))


def by_probability(ranking: DataFrame) -> DataFrame:
    """The ranking in falling probability, equal ones by id."""
    return ranking.withColumn("rank", rank_of(score="p"))


def inversions(ranking: DataFrame) -> DataFrame:
    """(qid, inversions, n): pairs that stand in the wrong order, and how many documents are ranked (a lone one has no pair).

    Each group is merge-sorted, counting what a later document passes, so no pair is formed.
    """

    def count(p: np.ndarray) -> tuple[np.ndarray, int]:
        if len(p) < 2:
            return p, 0
        (a, x), (b, y) = count(p[: len(p) // 2]), count(p[len(p) // 2 :])
        passed = np.searchsorted(a, b, "left")  # ascending: how many of a are below each of b
        return np.sort(np.concatenate([a, b]), kind="stable"), x + y + int(passed.sum())

    def one(key, group):
        order = np.argsort(group.column("rank").to_numpy(), kind="stable")
        return pa.table({"qid": pa.array([key[0].as_py()], pa.int64()), "inversions": pa.array([count(group.column("p").to_numpy()[order])[1]], pa.int64()), "n": pa.array([group.num_rows], pa.int64())})

    return ranking.select("qid", "rank", F.col("p").cast("double")).groupBy("qid").applyInArrow(one, "qid bigint, inversions bigint, n bigint")


def bubble_step(ranking: DataFrame) -> DataFrame:
    """The ranking with each query's first neighbours in the wrong order swapped."""
    later = F.lead("p").over(W.partitionBy("qid").orderBy("rank"))
    marked = ranking.withColumn("_wrong", F.when(F.col("p") < later, F.col("rank"))).withColumn("_at", F.min("_wrong").over(W.partitionBy("qid")))
    rank = F.when(F.col("rank") == F.col("_at"), F.col("rank") + 1).when(F.col("rank") == F.col("_at") + 1, F.col("rank") - 1).otherwise(F.col("rank"))
    return marked.withColumn("rank", rank).drop("_wrong", "_at")
