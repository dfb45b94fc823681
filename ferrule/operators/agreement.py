"""Judges and raters: confusion, corrected rates, agreement, variance components, observer error.

Ratings are long: (item, judge, value), a missing rating being an absent row or a null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import rogan_gladen, rogan_gladen_variance


def confusion_rates(verdicts: DataFrame, verdict: str = "v", truth: str = "y", by: list[str] | None = None) -> DataFrame:
    """(by..., n, p_obs, sensitivity, specificity); 0.5 where a rate has no row to be seen on."""
    v, y = F.col(verdict), F.col(truth)
    rate = lambda hit, base: F.coalesce(F.try_divide(F.count_if(hit), F.count_if(base)), F.lit(0.5))
    return verdicts.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(v.cast("double")).alias("p_obs"), rate((v == 1) & (y == 1), y == 1).alias("sensitivity"), rate((v == 0) & (y == 0), y == 0).alias("specificity"))


def corrected_rate(p: Column, sens: Column, spec: Column) -> Column:
    """The true rate behind an observed one, clipped to [0, 1]; NaN where the judge tells nothing."""
    j = sens + spec - 1
    return F.when(F.abs(j) < 1e-9, F.lit(math.nan)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p + spec - 1) / j)))


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(n, observed, expected, kappa, ac1) of two raters on 0/1 labels."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    expected = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    m = (F.col("pa") + F.col("pb")) / 2
    chance = 2 * m * (1 - m)
    ratio = lambda e: F.when(F.abs(1 - e) < 1e-12, 0.0).otherwise((F.col("observed") - e) / (1 - e))
    return s.select("n", "observed", expected.alias("expected"), ratio(expected).alias("kappa"), ratio(chance).alias("ac1"))


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """(alpha) of 0/1 ratings with gaps; items with one rating say nothing."""
    items = ratings.where("value is not null").groupBy("item").agg(F.count("*").alias("m"), F.sum("value").alias("k")).where("m > 1")
    m, k = F.col("m").cast("double"), F.col("k").cast("double")
    s = items.agg(F.sum(2 * k * (m - k) / (m - 1)).alias("disagree"), F.sum(m).alias("n"), F.sum(k).alias("ones"))
    expected = 2 * F.col("ones") * (F.col("n") - F.col("ones")) / (F.col("n") - 1)
    return s.select(F.when(expected == 0, 1.0).otherwise(1 - F.col("disagree") / expected).alias("alpha"))


def variance_components(ratings: DataFrame) -> DataFrame:
    """(items, judges, var_item, var_judge, var_error, icc) of a complete two-way table without repeats."""
    item = ratings.groupBy("item").agg(F.avg("value").alias("mi"))
    judge = ratings.groupBy("judge").agg(F.avg("value").alias("mj"))
    whole = ratings.agg(F.avg("value").alias("g"), F.countDistinct("item").alias("n"), F.countDistinct("judge").alias("k"))
    full = ratings.join(item, "item").join(judge, "judge").crossJoin(F.broadcast(whole))
    e = F.col("value") - F.col("mi") - F.col("mj") + F.col("g")
    ss = full.agg(F.first("n").alias("n"), F.first("k").alias("k"), F.sum(F.pow(F.col("mi") - F.col("g"), 2)).alias("ssi"), F.sum(F.pow(F.col("mj") - F.col("g"), 2)).alias("ssj"), F.sum(F.pow(e, 2)).alias("sse"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    msi, msj, mse = F.col("ssi") / (n - 1), F.col("ssj") / (k - 1), F.col("sse") / ((n - 1) * (k - 1))
    vi, vj = F.greatest((msi - mse) / k, F.lit(0.0)), F.greatest((msj - mse) / n, F.lit(0.0))
    icc = F.try_divide(msi - mse, msi + (k - 1) * mse + k * (msj - mse) / n)
    return ss.select(F.col("n").alias("items"), F.col("k").alias("judges"), vi.alias("var_item"), vj.alias("var_judge"), mse.alias("var_error"), icc.alias("icc"))


def precision_floor(components: DataFrame, grid: list[int], judges: int = 1) -> DataFrame:
    """(n, se) of a mean over n items with a fixed number of judges: the judges' part does not shrink with n."""
    n = F.col("n").cast("double")
    se = F.sqrt(F.col("var_item") / n + F.col("var_judge") / judges + F.col("var_error") / (n * judges))
    return components.withColumn("n", F.explode(F.array(*[F.lit(x) for x in grid]))).select("n", se.alias("se"))


def observer_error(ratings: DataFrame, rounds: int = 30, tol: float = 1e-6) -> tuple[DataFrame, dict]:
    """Dawid-Skene for 0/1 labels: (item, p) posterior of label 1, and each judge's sensitivity and specificity.

    The expectation and the maximisation are one aggregation each a round; the
    driver keeps two numbers a judge.
    """
    rows = ratings.where("value is not null").select("item", "judge", F.col("value").cast("double").alias("v"))
    post = rows.groupBy("item").agg(F.avg("v").alias("p"))
    last: dict = {}
    for _ in range(rounds):
        seen = rows.join(post, "item").groupBy("judge").agg(
            ((F.sum(F.col("p") * F.col("v")) + 1) / (F.sum("p") + 2)).alias("sens"),
            ((F.sum((1 - F.col("p")) * (1 - F.col("v"))) + 1) / (F.sum(1 - F.col("p")) + 2)).alias("spec"),
        )
        judges = {x["judge"]: (x["sens"], x["spec"]) for x in seen.collect()}
        prior = post.agg(F.avg("p")).first()[0]
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        table = rows.sparkSession.createDataFrame([(j, *map(float, x)) for j, x in judges.items()], "judge long, sens double, spec double")
        one = F.when(F.col("v") == 1, F.col("sens")).otherwise(1 - F.col("sens"))
        zero = F.when(F.col("v") == 1, 1 - F.col("spec")).otherwise(F.col("spec"))
        odds = rows.join(table, "judge").groupBy("item").agg((F.sum(F.log(one) - F.log(zero)) + math.log(prior / (1 - prior))).alias("o"))
        post = odds.select("item", (1 / (1 + F.exp(-F.col("o")))).alias("p"))
        if last and all(abs(a - b) < tol for j in judges for a, b in zip(judges[j], last[j], strict=True)):
            break
        last = judges
    return post, judges


def corrected_summary(n: int, p_obs: float, sens: float, spec: float) -> dict[str, float]:
    p = rogan_gladen(p_obs, sens, spec)
    return {"naive": p_obs, "corrected": p, "variance": rogan_gladen_variance(p_obs, sens, spec, n)}
