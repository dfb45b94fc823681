"""Generation queries: neighbours as claims about a query, labels as the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import chow_threshold
from ..operators import generation as G
from ..operators.dense import knn
from .base import CLAIMS_SQL, RUN_SQL, Book, claims, n, r, rs, vector_queries, vectors

book = Book()
_C = "WITH " + CLAIMS_SQL
GRID = [round(0.5 + 0.02 * i, 2) for i in range(21)]
_GRID = "(SELECT unnest([" + ", ".join(map(str, GRID)) + "])::DOUBLE AS l)"


def _claims_and_facts(spark, d):
    """Claims are the first 16 coordinates' neighbours, facts the whole vectors' (three a query)."""
    q, c = vector_queries(spark, d), vectors(spark, d)
    cut = lambda df: df.withColumn("vec", F.slice("vec", 1, 16))
    made = knn(cut(q), cut(c), 5, "cosine").select("qid", F.col("doc_id").alias("claim_id"))
    facts = knn(q, c, 3, "cosine").select("qid", F.col("doc_id").alias("fact_id"))
    one, two = c.select(F.col("doc_id").alias("claim_id"), "vec"), c.select(F.col("doc_id").alias("fact_id"), F.col("vec").alias("fvec"))
    return made.join(one, "claim_id"), facts.join(two, "fact_id")


_SUPPORT = f"""WITH {RUN_SQL}, p AS (SELECT c.qid, c.doc_id AS claim_id, f.doc_id AS fact_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM run c JOIN run f ON c.qid = f.qid AND c.leg = 'head' AND c.rank <= 5 AND f.leg = 'full' AND f.rank <= 3 JOIN embeddings a ON a.vec_id = c.doc_id JOIN embeddings b ON b.vec_id = f.doc_id),
s AS (SELECT qid, claim_id, fact_id, c, (c >= 0.4)::INT AS supported FROM (SELECT *, row_number() OVER (PARTITION BY qid, claim_id ORDER BY round(c, 9) DESC, fact_id) AS k FROM p) WHERE k = 1)"""


@book.query(_SUPPORT + f" SELECT qid, claim_id, fact_id, {rs('c')} AS cosine, supported::BIGINT AS supported FROM s")
def claim_support(spark, d):
    return G.claim_support(*_claims_and_facts(spark, d), least=0.4).select("qid", "claim_id", "fact_id", r("cosine").alias("cosine"), n("supported").alias("supported"))


@book.query(_SUPPORT + f", a AS (SELECT qid, avg(supported) AS p, count(DISTINCT CASE WHEN supported = 1 THEN fact_id END) / 3 AS c FROM s GROUP BY 1) SELECT qid, {rs('p')} AS faithfulness, {rs('c')} AS coverage, {rs('CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END')} AS f1 FROM a")
def answer_faithfulness(spark, d):
    made, facts = _claims_and_facts(spark, d)
    out = G.answer_scores(G.claim_support(made, facts, 0.4), facts)
    return out.select("qid", *[r(c).alias(c) for c in ("faithfulness", "coverage", "f1")])


@book.query(_C + f", f AS (SELECT 1 - p AS s, row_number() OVER (ORDER BY 1 - p) AS i, count(*) OVER () AS n FROM claims WHERE y = 1) SELECT {rs('s')} AS quantile FROM f WHERE i = ceil(0.8 * (n + 1))")
def conformal_quantile(spark, d):
    right = claims(spark, d).where("y = 1").select((1 - F.col("p")).alias("s"))
    q = G.conformal_quantile(right, 0.2)
    return spark.createDataFrame([(round(float(q), 6),)], "quantile double").where(F.col("quantile") < float("inf"))


@book.query(_C + f", f AS (SELECT 1 - p AS s, rank * 1.0 AS w FROM claims), c AS (SELECT s, sum(sum(w)) OVER (ORDER BY s) AS up FROM f GROUP BY s), t AS (SELECT sum(w) + 1 AS t FROM f) SELECT {rs('min(s)')} AS quantile FROM c, t WHERE up >= 0.8 * t - 1e-12")
def weighted_conformal_quantile(spark, d):
    rows = claims(spark, d).select((1 - F.col("p")).alias("s"), F.col("rank").cast("double").alias("w"))
    return spark.createDataFrame([(round(float(G.weighted_conformal_quantile(rows, 0.2, 1.0)), 6),)], "quantile double")


_LOSS = _C + f", e AS (SELECT qid, l, count_if(p >= l AND y = 0) / 10 AS loss FROM claims, {_GRID} GROUP BY ALL), t AS (SELECT l, avg(loss) AS loss, count(*) AS n FROM e GROUP BY 1)"


@book.query(_LOSS + f" SELECT l AS lambda, {rs('loss')} AS loss, n FROM t")
def retained_loss(spark, d):
    return G.loss_table(claims(spark, d), GRID, 10).select("lambda", r("loss").alias("loss"), "n")


@book.query(_LOSS + " SELECT coalesce(min(CASE WHEN n / (n + 1) * loss + 1 / (n + 1) <= 0.2 THEN l END), max(l)) AS lambda FROM t")
def risk_control_threshold(spark, d):
    return G.risk_control(G.loss_table(claims(spark, d), GRID, 10), 0.2)


@book.query(_C + " SELECT qid, count_if(p >= 0.7)::BIGINT AS retained, (count_if(p >= 0.7) = 0)::BIGINT AS abstain FROM claims GROUP BY 1")
def claim_back_off(spark, d):
    return G.back_off(claims(spark, d), 0.7).select("qid", n("retained").alias("retained"), n("abstain").alias("abstain"))


@book.query(_C + f" SELECT l AS lambda, {rs('coalesce(count_if(p >= l AND y = 1) / nullif(count_if(p >= l), 0), 1)')} AS precision, {rs('count_if(p >= l) / count(*)')} AS retained FROM claims, {_GRID} GROUP BY l")
def retention_frontier(spark, d):
    return G.retention_frontier(claims(spark, d), GRID).select("lambda", r("precision").alias("precision"), r("retained").alias("retained"))


_ANSWERS = _C + ", a AS (SELECT qid, avg(p) AS score, (avg(y) >= 0.5)::INT AS correct FROM claims GROUP BY 1), rc AS (SELECT row_number() OVER w AS i, row_number() OVER w / count(*) OVER () AS coverage, sum(1 - correct) OVER w / row_number() OVER w AS risk FROM a WINDOW w AS (ORDER BY round(score, 9) DESC, qid ROWS UNBOUNDED PRECEDING))"


@book.query(_ANSWERS + f" SELECT i, {rs('coverage')} AS coverage, {rs('risk')} AS risk FROM rc")
def risk_coverage(spark, d):
    return G.risk_coverage(G.answers(claims(spark, d))).select(n("i").alias("i"), r("coverage").alias("coverage"), r("risk").alias("risk"))


@book.query(_ANSWERS + f" SELECT {rs('sum(a)')} AS area FROM (SELECT (coverage - coalesce(lag(coverage) OVER (ORDER BY i), 0)) * (risk + coalesce(lag(risk) OVER (ORDER BY i), 0)) / 2 AS a FROM rc)")
def area_under_risk(spark, d):
    return G.area_under_risk(G.risk_coverage(G.answers(claims(spark, d)))).select(r("area").alias("area"))


@book.query(_ANSWERS + f" SELECT l AS t, {rs('avg(CASE WHEN score < l THEN 1.0 WHEN correct = 0 THEN 5.0 ELSE 0.0 END)')} AS cost, {rs('avg((score >= l)::INT)')} AS emitted FROM a, {_GRID} GROUP BY l")
def abstention_costs(spark, d):
    return G.expected_costs(G.answers(claims(spark, d)), GRID, 5.0, 1.0).select("t", r("cost").alias("cost"), r("emitted").alias("emitted"))


@book.query(_ANSWERS + " SELECT qid, (score >= 0.8)::BIGINT AS emit FROM a")
def chow_decisions(spark, d):
    """Answer where the confidence is at least 1 - c_abs / c_err."""
    return G.answers(claims(spark, d)).select("qid", n(F.col("score") >= chow_threshold(5.0, 1.0)).alias("emit"))


@book.query(_ANSWERS + f" SELECT l AS lambda, {rs('count_if(score >= l AND correct = 0) / count(*)')} AS loss, {rs('coalesce(count_if(score >= l AND correct = 0) / nullif(count_if(score >= l), 0), 0)')} AS risk, count(*) AS n FROM a, {_GRID} GROUP BY l")
def wrong_answers(spark, d):
    return G.wrong_answers(G.answers(claims(spark, d)), GRID).select("lambda", r("loss").alias("loss"), r("risk").alias("risk"), "n")


@book.query(_ANSWERS + f", t AS (SELECT l, count_if(score >= l AND correct = 0) / count(*) AS loss, count(*)::DOUBLE AS n FROM a, {_GRID} GROUP BY l) SELECT coalesce(min(CASE WHEN n / (n + 1) * loss + 1 / (n + 1) <= 0.2 THEN l END), max(l)) AS lambda FROM t")
def selective_threshold(spark, d):
    return G.selective_threshold(G.answers(claims(spark, d)), GRID, 0.2)
