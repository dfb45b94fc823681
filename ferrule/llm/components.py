"""Connected components by alternating large-star and small-star rounds.

Every round is two joins on the edge list; nothing about the graph reaches the
driver except one row of totals a round, which tells whether it still changes.
Each round's edges are written to the shared folder, so a lost executor costs
at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
    return both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    linked = down.join(low, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return linked.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge.

    ``edges`` has bigint columns src and dst, any direction, repeats and loops
    allowed. component is the smallest node reachable. An empty edge list
    gives an empty result. Converges in O(log^2 n) rounds; an error is raised
    if ``rounds`` should not suffice rather than a partial result returned.
    """
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    total = _total(now)
    for _ in range(rounds):
        if total[0] == 0:
            break
        nxt = cut(_small_star(_large_star(now)))
        discard(now)
        new, now = _total(nxt), nxt
        if new == total:
            break
        total = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def _total(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], int(row["h"])
