"""Evaluation queries over the vector runs, claims and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dice import PRIME, mixed_sql
from ..operators import evaluation as E
from ..plans.durable import written
from ..sources.tables import table
from .base import CLAIMS_SQL, RUN_SQL, Book, claims, judged, n, r, rs, run

book = Book()
_RUN = f"WITH {RUN_SQL}, rel AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY 1), qs AS (SELECT DISTINCT leg, qid FROM run), h AS (SELECT r.leg, r.qid, r.rank, g.grade, row_number() OVER (PARTITION BY r.leg, r.qid ORDER BY r.rank) AS i FROM run r JOIN qrels g ON r.qid = g.qid AND r.doc_id = g.doc_id)"
_AP = ", ap AS (SELECT qs.leg, qs.qid, coalesce(sum(i / h.rank / n_rel), 0) AS ap FROM qs LEFT JOIN h USING (leg, qid) LEFT JOIN rel USING (qid) GROUP BY ALL)"


@book.query(_RUN + f"""SELECT leg, qid, {rs('p')} AS precision, {rs('rc')} AS recall, {rs('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END')} AS f1 FROM
(SELECT qs.leg, qs.qid, count(h.rank) / 10.0::DOUBLE AS p, count(h.rank) / any_value(n_rel) AS rc FROM qs LEFT JOIN h ON h.leg = qs.leg AND h.qid = qs.qid AND h.rank <= 10 JOIN rel ON rel.qid = qs.qid GROUP BY ALL)""")
def precision_recall(spark, d):
    out = E.precision_recall_at(run(spark, d), judged(spark, d), 10)
    return out.select("leg", "qid", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@book.query(_RUN + _AP + f"SELECT leg, qid, {rs('ap')} AS ap FROM ap")
def average_precision(spark, d):
    return E.average_precision(run(spark, d), judged(spark, d)).select("leg", "qid", r("ap").alias("ap"))


@book.query(_RUN + _AP + f"SELECT leg, count(*) AS n, {rs('avg(ap)')} AS mean, {rs('stddev_samp(ap)')} AS std, {rs('stddev_samp(ap) / sqrt(count(*))')} AS se, {rs('avg(ap) - 1.96 * stddev_samp(ap) / sqrt(count(*))')} AS low, {rs('avg(ap) + 1.96 * stddev_samp(ap) / sqrt(count(*))')} AS high FROM ap GROUP BY 1")
def mean_average_precision(spark, d):
    s = E.summary(E.average_precision(run(spark, d), judged(spark, d)), "ap")
    return s.select("leg", "n", *[r(c).alias(c) for c in ("mean", "std", "se", "low", "high")])


@book.query(_RUN + f"SELECT leg, qid, {rs('i / n_rel')} AS recall, {rs('i / h.rank')} AS precision FROM h JOIN rel USING (qid)")
def precision_recall_curve(spark, d):
    return E.pr_curve(run(spark, d), judged(spark, d)).select("leg", "qid", r("recall").alias("recall"), r("precision").alias("precision"))


@book.query(_RUN + f""", lv AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS level),
b AS (SELECT qs.leg, qs.qid, level, coalesce(max(CASE WHEN i / n_rel >= level - 1e-12 THEN i / h.rank END), 0) AS p FROM qs CROSS JOIN lv LEFT JOIN h USING (leg, qid) LEFT JOIN rel USING (qid) GROUP BY ALL)
SELECT leg, level, {rs('avg(p)')} AS precision FROM b GROUP BY ALL""")
def interpolated_precision(spark, d):
    out = E.interpolated_precision(run(spark, d), judged(spark, d))
    return out.select("leg", "level", r("precision").alias("precision"))


@book.query(_RUN + f"SELECT leg, {rs('avg(rr)')} AS mrr FROM (SELECT qs.leg, qs.qid, coalesce(1.0 / min(h.rank), 0)::DOUBLE AS rr FROM qs LEFT JOIN h USING (leg, qid) GROUP BY ALL) GROUP BY 1")
def mean_reciprocal_rank(spark, d):
    return E.reciprocal_rank(run(spark, d), judged(spark, d)).groupBy("leg").agg(r(F.avg("rr")).alias("mrr"))


def _ndcg_sql(gain: str, disc: str) -> str:
    return f"""(SELECT qs.leg, qs.qid, coalesce(any_value(dcg), 0) / any_value(ideal) AS ndcg FROM qs LEFT JOIN (SELECT leg, qid, sum({gain} * {disc.format('rank')}) AS dcg FROM h WHERE rank <= 10 GROUP BY ALL) x USING (leg, qid)
JOIN (SELECT qid, sum({gain} * {disc.format('k')}) AS ideal FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS k FROM qrels) WHERE k <= 10 GROUP BY 1) y USING (qid) GROUP BY ALL)"""


_GAINS = {"linear": "grade", "exponential": "(pow(2, grade) - 1)"}
_DISCOUNTS = {"log2": "(1 / log2({} + 1))", "geometric": "pow(0.85, {} - 1)", "reciprocal": "(1.0::DOUBLE / {})"}


@book.query(_RUN + f"SELECT leg, qid, {rs('ndcg')} AS ndcg FROM {_ndcg_sql(_GAINS['exponential'], _DISCOUNTS['log2'])}")
def ndcg_at_10(spark, d):
    return E.ndcg(run(spark, d), judged(spark, d)).select("leg", "qid", r("ndcg").alias("ndcg"))


@book.query(_RUN + " UNION ALL ".join(f"SELECT leg, '{g}' AS gain, '{k}' AS discount, {rs('avg(ndcg)')} AS ndcg FROM {_ndcg_sql(_GAINS[g], _DISCOUNTS[k])} GROUP BY leg" for g in _GAINS for k in _DISCOUNTS))
def ndcg_conventions(spark, d):
    every, rel, out = run(spark, d), judged(spark, d), None
    for g in _GAINS:
        for k in _DISCOUNTS:
            row = E.ndcg(every, rel, 10, g, k).groupBy("leg").agg(r(F.avg("ndcg")).alias("ndcg")).select("leg", F.lit(g).alias("gain"), F.lit(k).alias("discount"), "ndcg")
            out = row if out is None else out.unionByName(row)
    return out


@book.query(_RUN + _AP + f", m AS (SELECT leg, avg(ap) AS u FROM ap GROUP BY 1), k AS (SELECT leg, avg(rr) AS v FROM (SELECT qs.leg, qs.qid, coalesce(1.0 / min(h.rank), 0) AS rr FROM qs LEFT JOIN h USING (leg, qid) GROUP BY ALL) GROUP BY 1) SELECT a.leg AS x, b.leg AS y FROM m a JOIN k ka USING (leg) JOIN (SELECT * FROM m JOIN k USING (leg)) b ON a.leg < b.leg WHERE (a.u - b.u) * (ka.v - b.v) < 0")
def metric_reversals(spark, d):
    every, rel = run(spark, d), judged(spark, d)
    a = E.average_precision(every, rel).groupBy("leg").agg(F.avg("ap").alias("mean"))
    b = E.reciprocal_rank(every, rel).groupBy("leg").agg(F.avg("rr").alias("mean"))
    return E.reversals(a, b)


@book.query(_RUN + _AP + f"SELECT {rs('avg(d)')} AS mean, {rs('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} AS t, {rs('avg(d) / stddev_samp(d)')} AS effect FROM (SELECT a.ap - b.ap AS d FROM ap a JOIN ap b ON a.qid = b.qid AND a.leg = 'full' AND b.leg = 'head')")
def paired_t_statistic(spark, d):
    diff = E.paired_differences(E.average_precision(run(spark, d), judged(spark, d)), "ap", "full", "head")
    t = E.paired_t(diff)
    return spark.createDataFrame([tuple(round(float(t[k]), 6) for k in ("mean", "t", "effect"))], "mean double, t double, effect double")


@book.query()
def leg_significance(spark, d):
    """All pairs of legs: t-test and sign-flip p-values with their adjustments."""
    ap = written(E.average_precision(run(spark, d), judged(spark, d)))
    rows = []
    for a, b in (("full", "head"), ("full", "tail"), ("head", "tail")):
        diff = E.paired_differences(ap, "ap", a, b)
        rows.append((f"{a}-{b}", round(E.paired_t(diff)["p"], 6), round(E.permutation_p(diff, 2000), 6)))
    tests = spark.createDataFrame(rows, "test string, p double, permutation_p double")
    return E.adjusted_p(tests)


_APD = _RUN + _AP + ", d AS (SELECT a.leg || '-' || b.leg AS test, a.qid, a.ap - b.ap AS d FROM ap a JOIN ap b ON a.qid = b.qid AND (a.leg, b.leg) IN (('full', 'head'), ('full', 'tail'), ('head', 'tail'))), "


@book.query(_APD + f"""s AS (SELECT test, draw, abs(sum(CASE WHEN {mixed_sql('qid', 'draw')} % 2 = 0 THEN d ELSE -d END)) AS s FROM d, range(2000) t(draw) GROUP BY ALL),
p AS (SELECT s.test, (count_if(s >= t - 1e-12) + 1) / 2001 AS p FROM s JOIN (SELECT test, abs(sum(d)) AS t FROM d GROUP BY 1) USING (test) GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i FROM p)
SELECT test, {rs('p')} AS p, {rs('least(1, 3 * p)')} AS bonferroni, {rs('max(least(1, (4 - i) * p)) OVER (ORDER BY i)')} AS holm, {rs('min(least(1, 3 * p / i)) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS bh FROM k""")
def permutation_significance(spark, d):
    """Sign-flip p-values of all pairs of legs with their adjustments."""
    ap = written(E.average_precision(run(spark, d), judged(spark, d)))
    rows = [(f"{a}-{b}", E.permutation_p(E.paired_differences(ap, "ap", a, b), 2000, exact_up_to=0)) for a, b in (("full", "head"), ("full", "tail"), ("head", "tail"))]
    return E.adjusted_p(spark.createDataFrame(rows, "test string, p double")).select("test", *[r(c).alias(c) for c in ("p", "bonferroni", "holm", "bh")])


_WEIGHT = "(" + " + ".join(f"(u >= {x!r})::INT" for x in E.POISSON) + ")"


@book.query(_APD + f"""w AS (SELECT test, draw, d, {_WEIGHT} AS w FROM (SELECT test, draw, d, {mixed_sql('qid', 'draw')} / {PRIME}.0::DOUBLE AS u FROM d, range(500) t(draw))),
m AS (SELECT test, draw, sum(w * d) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0)
SELECT test, {rs('stddev_samp(m)')} AS se, {rs('quantile_cont(m, 0.025)')} AS low, {rs('quantile_cont(m, 0.975)')} AS high, {rs('(count_if(abs(m - o) >= abs(o) - 1e-12) + 1) / 501')} AS p FROM m JOIN (SELECT test, avg(d) AS o FROM d GROUP BY 1) USING (test) GROUP BY 1""")
def paired_bootstrap(spark, d):
    ap = written(E.average_precision(run(spark, d), judged(spark, d)))
    rows = []
    for a, b in (("full", "head"), ("full", "tail"), ("head", "tail")):
        s = E.paired_bootstrap(E.paired_differences(ap, "ap", a, b), 500)
        rows.append((f"{a}-{b}", *(round(float(s[k]), 6) for k in ("se", "low", "high", "p"))))
    return spark.createDataFrame(rows, "test string, se double, low double, high double, p double")


@book.query(_RUN + _AP + f""", w AS (SELECT leg, draw, ap, {_WEIGHT} AS w FROM (SELECT leg, draw, ap, {mixed_sql('qid', 'draw')} / {PRIME}.0::DOUBLE AS u FROM ap, range(500) t(draw)))
SELECT leg, {rs('stddev_samp(m)')} AS se FROM (SELECT leg, draw, sum(w * ap) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0) GROUP BY 1""")
def bootstrap_standard_error(spark, d):
    ap = written(E.average_precision(run(spark, d), judged(spark, d)))
    rows = [(leg, round(float(E.bootstrap_se(ap.where(F.col("leg") == leg), "ap", 500)), 6)) for leg in ("full", "head", "tail")]
    return spark.createDataFrame(rows, "leg string, se double")


# Calibration.
_BIN = "(" + " + ".join("(p >= e[{}])::INT".format(i) for i in range(2, 11)) + ")"
_REL = "WITH " + CLAIMS_SQL + f""", e AS (SELECT quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM claims),
bins AS (SELECT bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM (SELECT p, y, {_BIN} AS bin FROM claims, e) GROUP BY 1)"""


@book.query(_REL + f"SELECT bin::BIGINT AS bin, n, {rs('confidence')} AS confidence, {rs('accuracy')} AS accuracy FROM bins")
def reliability_diagram(spark, d):
    return E.reliability(claims(spark, d)).select(n("bin").alias("bin"), "n", r("confidence").alias("confidence"), r("accuracy").alias("accuracy"))


@book.query(_REL + f"SELECT {rs('sum(n * abs(accuracy - confidence)) / sum(n)')} AS ece, {rs('max(abs(accuracy - confidence))')} AS mce FROM bins")
def calibration_error(spark, d):
    return E.calibration_errors(E.reliability(claims(spark, d))).select(r("ece").alias("ece"), r("mce").alias("mce"))


@book.query("WITH " + CLAIMS_SQL + f"SELECT {rs('avg(pow(p - y, 2))')} AS brier FROM claims")
def brier_score(spark, d):
    return E.brier(claims(spark, d)).select(r("brier").alias("brier"))


@book.query(_REL + f""", t AS (SELECT sum(n) AS m, sum(n * accuracy) / sum(n) AS base FROM bins)
SELECT {rs('sum(n / m * pow(confidence - accuracy, 2))')} AS reliability, {rs('sum(n / m * pow(accuracy - base, 2))')} AS resolution, {rs('max(base * (1 - base))')} AS uncertainty FROM bins, t""")
def brier_decomposition(spark, d):
    return E.brier_parts(E.reliability(claims(spark, d))).select(*[r(c).alias(c) for c in ("reliability", "resolution", "uncertainty")])


@book.query("WITH " + CLAIMS_SQL + f""", k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k FROM claims)
SELECT {rs('(sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y))')} AS auc FROM k""")
def pooled_auc(spark, d):
    return E.auc(claims(spark, d)).select(r("auc").alias("auc"))


@book.query()
def recalibration(spark, d):
    """Errors of raw, logistic and step-function scores, fitted on the first half of the queries, told on the rest."""
    every = written(claims(spark, d))  # every step of the fits reads them
    middle = every.agg(F.percentile("qid", 0.5)).first()[0]
    fit, rest = every.where(F.col("qid") <= middle), every.where(F.col("qid") > middle)
    a, b = E.platt(fit)
    steps = E.isotonic(fit)
    columns = {"raw": F.col("p"), "platt": 1 / (1 + F.exp(-(a * F.col("p") + b))), "isotonic": E.apply_isotonic(F.col("p"), *steps)}
    out = None
    for name, column in columns.items():
        scored = rest.select(column.alias("p"), "y")
        row = E.calibration_errors(E.reliability(scored)).crossJoin(E.brier(scored)).select(F.lit(name).alias("method"), *[r(c).alias(c) for c in ("ece", "mce", "brier")])
        out = row if out is None else out.unionByName(row)
    return out


# Drift: purchases against clicks of the event table.
def _samples(spark, d):
    e = table(spark, d, "events").where("event_type in ('click', 'purchase')")
    return e.select(F.when(F.col("event_type") == "click", "ref").otherwise("cur").alias("g"), F.col("value").alias("x"))


_SAMPLES = "s AS (SELECT CASE WHEN event_type = 'click' THEN 'ref' ELSE 'cur' END AS g, value AS x FROM events WHERE event_type IN ('click', 'purchase'))"


@book.query(f"""WITH {_SAMPLES}, c AS (SELECT x, count_if(g = 'ref') AS a, count_if(g = 'cur') AS b FROM s GROUP BY 1),
k AS (SELECT x, abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS gap FROM c WINDOW w AS (ORDER BY x))
SELECT {rs('max(gap)')} AS gap, (SELECT x FROM k ORDER BY round(gap, 12) DESC, x LIMIT 1) AS at FROM k""")
def distribution_gap(spark, d):
    return E.ks_gap(_samples(spark, d)).select(r("gap").alias("gap"), "at")


@book.query(f"WITH {_SAMPLES} SELECT x, {rs('share')} AS share FROM (SELECT x, sum(n) OVER (ORDER BY x) / sum(n) OVER () AS share FROM (SELECT x, count(*) AS n FROM s WHERE g = 'cur' GROUP BY 1))")
def distribution_function(spark, d):
    return E.distribution_function(_samples(spark, d).where("g = 'cur'")).select("x", r("share").alias("share"))


@book.query(_RUN + _AP + f""", m AS (SELECT leg, avg(ap) AS m, 1.96 * stddev_samp(ap) / sqrt(count(*)) AS h FROM ap WHERE leg IN ('full', 'tail') GROUP BY 1),
x AS (SELECT ap AS x, count_if(leg = 'full') AS a, count_if(leg = 'tail') AS b FROM ap GROUP BY 1), g AS (SELECT abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) AS gap FROM x)
SELECT (a.m - a.h <= b.m + b.h AND b.m - b.h <= a.m + a.h) AS overlap, {rs('b.m - a.m')} AS shift, {rs('(SELECT max(gap) FROM g)')} AS gap FROM m a, m b WHERE a.leg = 'full' AND b.leg = 'tail'""")
def silent_decay(spark, d):
    """The third leg as a decayed version of the first: what intervals and distribution functions see."""
    s = E.decay(written(E.average_precision(run(spark, d), judged(spark, d))), "ap", "full", "tail")
    return spark.createDataFrame([(bool(s["overlap"]), round(s["shift"], 6), round(s["gap"], 6))], "overlap boolean, shift double, gap double")


_LOGIT = "ln(p / (1 - p))"


@book.query("WITH " + CLAIMS_SQL + f""", j AS (SELECT 1 / (1 + exp(-({_LOGIT} + 0.3))) - 1 / (1 + exp(-({_LOGIT} - 0.3))) AS d FROM claims WHERE p > 0 AND p < 1)
SELECT {rs('avg(d)')} AS bias, {rs('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} AS t, count(*) AS n FROM j""")
def swap_bias(spark, d):
    """A judge whose log-odds rise by 0.3 for what is shown first and fall by as much for what is shown last."""
    c = claims(spark, d).where("p > 0 and p < 1")
    at = lambda shift: 1 / (1 + F.exp(-(F.log(F.col("p") / (1 - F.col("p"))) + shift)))
    s = E.swap_bias(c.select("qid", at(0.3).alias("early"), at(-0.3).alias("late")))
    return spark.createDataFrame([(round(s["bias"], 6), round(s["t"], 6), s["n"])], "bias double, t double, n long")


_XBIN = _BIN.replace("(p >=", "(x >=")


@book.query(f"""WITH {_SAMPLES}, e AS (SELECT quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM s WHERE g = 'ref'),
b AS (SELECT bin, count_if(g = 'ref') AS a, count_if(g = 'cur') AS b FROM (SELECT g, {_XBIN} AS bin FROM s, e) GROUP BY 1),
p AS (SELECT bin, (a + 0.5) / (sum(a) OVER () + 5) AS p, (b + 0.5) / (sum(b) OVER () + 5) AS q FROM b)
SELECT {rs('sum((p - q) * ln(p / q))')} AS psi, {rs('sum(p * ln(p / q))')} AS kl, {rs('sum(p * ln(p / q) + q * ln(q / p))')} AS jeffreys FROM p""")
def population_stability(spark, d):
    return E.divergences(E.histogram_shares(_samples(spark, d))).select(*[r(c).alias(c) for c in ("psi", "kl", "jeffreys")])
