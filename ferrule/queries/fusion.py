"""Fusion queries over the three legs of the vector runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as X
from ..plans.ranking import top_k
from .base import RUN_DEPTH, RUN_SQL, Book, n, r, ranked, ranked_sql, rs, run

book = Book()
_RUN = f"WITH {RUN_SQL} "


@book.query(_RUN + ranked_sql("SELECT qid, doc_id, sum(1.0 / (60 + rank)) AS score FROM run GROUP BY ALL", 10))
def reciprocal_rank_fusion(spark, d):
    return ranked(X.rrf(run(spark, d)))


@book.query(_RUN + f"SELECT qid, doc_id, leg, {rs('1.0::DOUBLE / (60 + rank)')} AS contribution FROM run")
def fusion_contributions(spark, d):
    return X.rrf_contributions(run(spark, d)).select("qid", "doc_id", "leg", r("contribution").alias("contribution"))


@book.query(_RUN + ", n AS (SELECT qid, count(DISTINCT doc_id) AS n FROM run GROUP BY 1) " + ranked_sql("SELECT qid, doc_id, sum(n - rank)::DOUBLE AS score FROM run JOIN n USING (qid) GROUP BY ALL", 10))
def borda_fusion(spark, d):
    return ranked(X.borda(run(spark, d)))


_SCALED = "s AS (SELECT leg, qid, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM run WINDOW w AS (PARTITION BY leg, qid))"


@book.query(_RUN + f", {_SCALED} " + ranked_sql("SELECT qid, doc_id, sum(score) AS score FROM s GROUP BY ALL", 10))
def scaled_sum_fusion(spark, d):
    return ranked(X.comb_sum(run(spark, d)))


@book.query(_RUN + ranked_sql("SELECT qid, doc_id, sum(score) AS score FROM run GROUP BY ALL", 10))
def raw_sum_fusion(spark, d):
    return ranked(X.comb_sum(run(spark, d), normalize=False))


_COMMON = "c AS (SELECT a.qid, a.doc_id, row_number() OVER (PARTITION BY a.qid ORDER BY a.rank) AS pa, row_number() OVER (PARTITION BY a.qid ORDER BY b.rank) AS pb FROM run a JOIN run b ON a.qid = b.qid AND a.doc_id = b.doc_id WHERE a.leg = 'full' AND b.leg = 'head')"


@book.query(_RUN + f", {_COMMON} SELECT qid, sum(abs(pa - pb))::BIGINT AS footrule, count(*) AS common FROM c GROUP BY 1")
def rank_footrule(spark, d):
    return X.footrule(run(spark, d), "full", "head")


@book.query(_RUN + f", {_COMMON} SELECT x.qid, count_if(x.pb > y.pb)::BIGINT AS discordant FROM c x JOIN c y ON x.qid = y.qid AND x.pa < y.pa GROUP BY 1")
def rank_discordance(spark, d):
    return X.discordant_pairs(run(spark, d), "full", "head")


@book.query(_RUN + """, t AS (SELECT * FROM run), docs AS (SELECT DISTINCT qid, doc_id AS b FROM t)
SELECT x.qid, x.doc_id AS a, docs.b, count(*) AS wins FROM t x JOIN docs ON docs.qid = x.qid AND docs.b <> x.doc_id LEFT JOIN t y ON y.qid = x.qid AND y.leg = x.leg AND y.doc_id = docs.b WHERE y.rank IS NULL OR x.rank < y.rank GROUP BY ALL""")
def pairwise_majority(spark, d):
    return X.majority(run(spark, d)).select("qid", "a", "b", n("wins").alias("wins"))


@book.query()
def consensus_orders(spark, d):
    """Footrule and Markov-chain consensus of the whole runs; the exact one, which tries all orders, of the first two of each leg."""
    every = run(spark, d)
    parts = [X.consensus(every, m, depth).withColumn("method", F.lit(m)) for m, depth in (("kemeny", 2), ("footrule", RUN_DEPTH), ("markov", RUN_DEPTH))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@book.query(_RUN + """, fused AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, doc_id) AS k FROM run GROUP BY qid, doc_id),
legs AS (SELECT leg, qid, doc_id FROM run WHERE rank <= 10 UNION ALL SELECT 'fused', qid, doc_id FROM fused WHERE k <= 10),
n AS (SELECT qid, count(*) AS rel FROM qrels GROUP BY 1), hits AS (SELECT l.leg, l.qid, count(g.doc_id) AS hits FROM legs l LEFT JOIN qrels g ON l.qid = g.qid AND l.doc_id = g.doc_id GROUP BY ALL)
""" + f"SELECT leg, {rs('avg(hits / least(10, rel))')} AS recall FROM hits JOIN n USING (qid) GROUP BY 1")
def fusion_gain(spark, d):
    """Recall of each leg and of their fusion, with the denominator least(k, relevant)."""
    from .base import graded

    every, rel = run(spark, d), graded(spark, d)
    fused = top_k(X.rrf_contributions(every).groupBy("qid", "doc_id").agg(F.sum("contribution").alias("score")), 10).select(F.lit("fused").alias("leg"), "qid", "doc_id")
    legs = every.where("rank <= 10").select("leg", "qid", "doc_id").unionByName(fused)
    size = rel.groupBy("qid").agg(F.count("*").alias("rel"))
    hits = legs.join(rel.select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left").groupBy("leg", "qid").agg(F.count("hit").alias("hits"))
    return hits.join(size, "qid").groupBy("leg").agg(r(F.avg(F.col("hits") / F.least(F.lit(10), F.col("rel")))).alias("recall"))
