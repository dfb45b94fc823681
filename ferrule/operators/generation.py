"""Grounded generation: support of claims, conformal back-off, abstention, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..plans.durable import written
from ..plans.ranking import running_sums


def claim_support(claims: DataFrame, facts: DataFrame, least: float = 0.78) -> DataFrame:
    """claims (qid, claim_id, vec) with their nearest fact of the same context (qid, fact_id, fvec): (qid, claim_id, fact_id, cosine, supported)."""
    pairs = claims.join(facts, "qid").withColumn("cosine", cosine("vec", "fvec"))
    best = F.max_by(F.struct("fact_id", "cosine"), F.struct(F.round("cosine", 9), -F.col("fact_id")))
    return pairs.groupBy("qid", "claim_id").agg(best.alias("b")).select("qid", "claim_id", "b.fact_id", "b.cosine", (F.col("b.cosine") >= least).cast("int").alias("supported"))


def answer_scores(support: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, faithfulness, coverage, f1): supported share of claims, attributed share of facts, their harmonic mean."""
    n_facts = facts.groupBy("qid").agg(F.countDistinct("fact_id").alias("n_facts"))
    s = support.groupBy("qid").agg(F.avg(F.col("supported").cast("double")).alias("faithfulness"), F.countDistinct(F.when(F.col("supported") == 1, F.col("fact_id"))).alias("used")).join(n_facts, "qid")
    p, c = F.col("faithfulness"), F.col("used") / F.col("n_facts")
    return s.select("qid", p.alias("faithfulness"), c.alias("coverage"), F.when(p + c > 0, 2 * p * c / (p + c)).otherwise(0.0).alias("f1"))


# Conformal methods.
def conformal_quantile(scores: DataFrame, alpha: float, score: str = "s") -> float:
    """The ceil((1 - alpha)(n + 1))-th smallest score; infinity beyond n.

    Only the order statistic is taken, from running counts of the distinct
    scores, which are written, so that the scores are worked out once.
    """
    import math

    by = written(scores.groupBy(score).agg(F.count("*").alias("c")))
    n = by.agg(F.sum("c")).first()[0] or 0
    k = math.ceil((1 - alpha) * (n + 1))
    if k > n or n == 0:
        return math.inf
    counts = running_sums(by, score, {"up": "c"})
    return counts.where(F.col("up") >= k).agg(F.min(score)).first()[0]


def weighted_conformal_quantile(scores: DataFrame, alpha: float, test_weight: float, score: str = "s", weight: str = "w") -> float:
    """The smallest score at which the weight so far reaches 1 - alpha of all, the test point's included; else infinity."""
    import math

    total = scores.agg(F.coalesce(F.sum(weight), F.lit(0.0))).first()[0] + test_weight
    run = running_sums(scores.groupBy(score).agg(F.sum(weight).alias("mass")), score, {"up": "mass"})
    found = run.where(F.col("up") >= (1 - alpha) * total - 1e-12).agg(F.min(score)).first()[0]
    return math.inf if found is None else found


def loss_table(claims: DataFrame, grid: list[float], k: int) -> DataFrame:
    """(lambda, loss): mean over answers of false retained claims over k; falls as the threshold rises."""
    lam = claims.select("qid", "p", "y", F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("lambda"))
    each = lam.groupBy("qid", "lambda").agg((F.count_if((F.col("p") >= F.col("lambda")) & (F.col("y") == 0)) / k).alias("loss"))
    return each.groupBy("lambda").agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


def risk_control(losses: DataFrame, alpha: float, bound: float = 1.0) -> DataFrame:
    """(lambda): the smallest whose corrected risk n/(n+1) loss + bound/(n+1) is at most alpha, else the largest."""
    n = F.col("n").cast("double")
    ok = n / (n + 1) * F.col("loss") + bound / (n + 1) <= alpha
    return losses.agg(F.coalesce(F.min(F.when(ok, F.col("lambda"))), F.max("lambda")).alias("lambda"))


def back_off(claims: DataFrame, tau: float) -> DataFrame:
    """(qid, retained, abstain): claims at or above tau; an answer without one abstains."""
    return claims.groupBy("qid").agg(F.count_if(F.col("p") >= tau).alias("retained")).withColumn("abstain", (F.col("retained") == 0).cast("int"))


def retention_frontier(claims: DataFrame, grid: list[float]) -> DataFrame:
    """(lambda, precision, retained): precision of what is retained (1 if nothing is) and its share."""
    lam = claims.select("p", "y", F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("lambda"))
    kept = F.col("p") >= F.col("lambda")
    return lam.groupBy("lambda").agg(F.coalesce(F.try_divide(F.count_if(kept & (F.col("y") == 1)), F.count_if(kept)), F.lit(1.0)).alias("precision"), (F.count_if(kept) / F.count("*")).alias("retained"))


# Selective answers: (qid, score, correct).
def answers(claims: DataFrame, how: str = "mean", floor: float = 0.5) -> DataFrame:
    agg = F.avg("p") if how == "mean" else F.min("p")
    return claims.groupBy("qid").agg(agg.alias("score"), (F.avg(F.col("y").cast("double")) >= floor).cast("int").alias("correct"))


def risk_coverage(scored: DataFrame) -> DataFrame:
    """(i, coverage, risk, before) when answers are given from the most confident on; before is the risk one answer earlier (0 at first)."""
    rows = scored.select("qid", (-F.round("score", 9)).alias("doubt"), F.lit(1).alias("one"), (1 - F.col("correct")).alias("wrong"))
    n = rows.agg(F.count("*").alias("n"))
    up = running_sums(rows, "doubt", {"i": "one", "bad": "wrong"}, ["qid"]).crossJoin(F.broadcast(n))
    before = F.when(F.col("i") > 1, (F.col("bad") - F.col("wrong")) / (F.col("i") - 1)).otherwise(0.0)
    return up.select("i", (F.col("i") / F.col("n")).alias("coverage"), (F.col("bad") / F.col("i")).alias("risk"), before.alias("before"))


def area_under_risk(curve: DataFrame) -> DataFrame:
    """Trapezoids from (0, 0); coverage rises by the same step at every answer."""
    step = F.col("coverage") / F.col("i")
    return curve.agg(F.sum(step * (F.col("risk") + F.col("before")) / 2).alias("area"))


def expected_costs(scored: DataFrame, thresholds: list[float], c_err: float, c_abs: float) -> DataFrame:
    """(t, cost, emitted): a wrong answer costs c_err, an abstention c_abs."""
    t = scored.select("score", "correct", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("t"))
    emit = F.col("score") >= F.col("t")
    return t.groupBy("t").agg(F.avg(F.when(~emit, float(c_abs)).when(F.col("correct") == 0, float(c_err)).otherwise(0.0)).alias("cost"), F.avg(emit.cast("double")).alias("emitted"))


def wrong_answers(scored: DataFrame, grid: list[float]) -> DataFrame:
    """(lambda, loss, risk, n): share of all answers that are given and wrong (falls with the threshold), and of those given."""
    t = scored.select("score", "correct", F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("lambda"))
    given, wrong = F.col("score") >= F.col("lambda"), F.col("correct") == 0
    return t.groupBy("lambda").agg((F.count_if(given & wrong) / F.count("*")).alias("loss"), F.coalesce(F.try_divide(F.count_if(given & wrong), F.count_if(given)), F.lit(0.0)).alias("risk"), F.count("*").alias("n"))


def selective_threshold(scored: DataFrame, grid: list[float], alpha: float) -> DataFrame:
    """(lambda): the smallest score from which answers may be given so that wrong ones stay within alpha of all."""
    return risk_control(wrong_answers(scored, grid), alpha)
