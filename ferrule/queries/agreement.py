"""Judges and raters: each event type judges whether a user is active; the majority is the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..sources.tables import table
from .base import CLAIMS_SQL, Book, claims, ieee_divide, r, rounded_float, rs

book = Book()
#: A judge's verdict on a user: whether the mean value of the user's events of one type exceeds 50.
_RATINGS = """ratings AS (SELECT user_id::BIGINT AS item, j AS judge, CASE WHEN avg(value) > 50 THEN 1 ELSE 0 END AS value FROM (SELECT user_id, value, event_id % 3 AS j FROM events) GROUP BY ALL),
complete AS (SELECT item, judge, value::DOUBLE AS value FROM ratings WHERE item IN (SELECT item FROM ratings GROUP BY 1 HAVING count(*) = 3))"""


def _ratings(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").cast("bigint").alias("item"), (F.col("event_id") % 3).alias("judge")).agg(F.when(F.avg("value") > 50, 1).otherwise(0).alias("value"))


def _complete(spark, d):
    rows = _ratings(spark, d)
    full = rows.groupBy("item").agg(F.count("*").alias("k")).where("k = 3").select("item")
    return rows.join(full, "item", "left_semi").withColumn("value", F.col("value").cast("double"))


_CLAIMS = "WITH " + CLAIMS_SQL + ", v AS (SELECT CASE WHEN p >= 0.7 THEN 1 ELSE 0 END AS v, y FROM claims), c AS (SELECT count(*) AS n, avg(v) AS p_obs, coalesce(count_if(v = 1 AND y = 1) / nullif(count_if(y = 1), 0), 0.5) AS sens, coalesce(count_if(v = 0 AND y = 0) / nullif(count_if(y = 0), 0), 0.5) AS spec FROM v) "


def _verdicts(spark, d):
    return claims(spark, d).select((F.col("p") >= 0.7).cast("int").alias("v"), "y")


@book.query(_CLAIMS + f"SELECT n, {rs('p_obs')} AS p_obs, {rs('sens')} AS sensitivity, {rs('spec')} AS specificity FROM c")
def judge_confusion(spark, d):
    return A.confusion_rates(_verdicts(spark, d)).select("n", *[r(c).alias(c) for c in ("p_obs", "sensitivity", "specificity")])


@book.query(_CLAIMS + f"SELECT {rs('p_obs')} AS naive, {rs('least(1, greatest(0, (p_obs + spec - 1) / (sens + spec - 1)))')} AS corrected, {rs('p_obs * (1 - p_obs) / (n * pow(sens + spec - 1, 2))')} AS variance FROM c")
def corrected_rate(spark, d):
    """A judge that tells nothing (sensitivity + specificity = 1) divides by zero: as in SQL, by the rules of floating point."""
    c = A.confusion_rates(_verdicts(spark, d))
    p, j = F.col("p_obs"), F.col("sensitivity") + F.col("specificity") - 1
    corrected = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ieee_divide(p + F.col("specificity") - 1, j)))
    return c.select(r("p_obs").alias("naive"), rounded_float(corrected).alias("corrected"), rounded_float(ieee_divide(p * (1 - p), F.col("n") * j * j)).alias("variance"))


@book.query(f"""WITH {_RATINGS}, p AS (SELECT a.value AS a, b.value AS b FROM ratings a JOIN ratings b ON a.item = b.item AND a.judge = 0 AND b.judge = 1),
s AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb FROM p), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe, (pa + pb) / 2 AS m FROM s)
SELECT n, {rs('po')} AS observed, {rs('pe')} AS expected, {rs('(po - pe) / (1 - pe)')} AS kappa, {rs('(po - 2 * m * (1 - m)) / (1 - 2 * m * (1 - m))')} AS ac1 FROM e""")
def rater_agreement(spark, d):
    x = _ratings(spark, d)
    pairs = x.where("judge = 0").select("item", F.col("value").alias("a")).join(x.where("judge = 1").select("item", F.col("value").alias("b")), "item")
    return A.cohen_kappa(pairs).select("n", *[r(c).alias(c) for c in ("observed", "expected", "kappa", "ac1")])


@book.query(f"""WITH {_RATINGS}, i AS (SELECT item, count(*)::DOUBLE AS m, sum(value)::DOUBLE AS k FROM ratings GROUP BY 1 HAVING count(*) > 1), s AS (SELECT sum(2 * k * (m - k) / (m - 1)) AS dis, sum(m) AS n, sum(k) AS o FROM i)
SELECT {rs('1 - dis / (2 * o * (n - o) / (n - 1))')} AS alpha FROM s""")
def rater_alpha(spark, d):
    return A.krippendorff_alpha(_ratings(spark, d)).select(r("alpha").alias("alpha"))


_ANOVA = f"""WITH {_RATINGS}, g AS (SELECT avg(value) AS g, count(DISTINCT item)::DOUBLE AS n, count(DISTINCT judge)::DOUBLE AS k FROM complete), f AS (SELECT value, avg(value) OVER (PARTITION BY item) AS mi, avg(value) OVER (PARTITION BY judge) AS mj FROM complete),
ss AS (SELECT any_value(n) AS n, any_value(k) AS k, sum(pow(mi - g, 2)) / (any_value(n) - 1) AS msi, sum(pow(mj - g, 2)) / (any_value(k) - 1) AS msj, sum(pow(value - mi - mj + g, 2)) / ((any_value(n) - 1) * (any_value(k) - 1)) AS mse FROM f, g),
vc AS (SELECT n, k, greatest((msi - mse) / k, 0) AS vi, greatest((msj - mse) / n, 0) AS vj, mse, (msi - mse) / (msi + (k - 1) * mse + k * (msj - mse) / n) AS icc FROM ss)"""


@book.query(_ANOVA + f" SELECT n::BIGINT AS items, k::BIGINT AS judges, {rs('vi')} AS var_item, {rs('vj')} AS var_judge, {rs('mse')} AS var_error, {rs('icc')} AS icc FROM vc")
def rating_variance(spark, d):
    return A.variance_components(_complete(spark, d)).select("items", "judges", *[r(c).alias(c) for c in ("var_item", "var_judge", "var_error", "icc")])


@book.query(_ANOVA + f" SELECT m::BIGINT AS n, {rs('sqrt(vi / m + vj / 1 + mse / m)')} AS se FROM vc, (SELECT unnest([10, 20, 40, 80, 160, 320, 640]) AS m)")
def precision_floor(spark, d):
    out = A.precision_floor(A.variance_components(_complete(spark, d)), [10, 20, 40, 80, 160, 320, 640])
    return out.select(F.col("n").cast("bigint").alias("n"), r("se").alias("se"))


@book.query()
def observer_error(spark, d):
    post, _ = A.observer_error(_ratings(spark, d), rounds=8)
    return post.select("item", r("p").alias("p"))
