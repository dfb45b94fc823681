"""Mined negatives, stale indexes and transformed queries over the vectors; labels say what belongs together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dice import PRIME, mixed_sql
from ..operators import sampling as S
from ..operators.dense import knn, knn_of_equals, mean_direction
from ..plans.durable import written
from .base import RUN_SQL, Book, r, rs, run, vector_queries, vectors

book = Book()
PACE, TURN = 10.0, [63 - i for i in range(64)]


@book.query(f"""WITH {RUN_SQL}, s AS (SELECT r.qid, r.rank, (a.label = b.label)::INT AS same FROM run r JOIN embeddings a ON a.vec_id = r.qid JOIN embeddings b ON b.vec_id = r.doc_id WHERE leg = 'full')
SELECT depth::INT AS depth, {rs('avg(rate)')} AS rate FROM (SELECT depth, qid, avg(same) AS rate FROM s, (SELECT unnest([1, 5, 20, 50]) AS depth) WHERE rank <= depth GROUP BY ALL) GROUP BY 1""")
def mined_false_negatives(spark, d):
    return S.false_negative_rate(run(spark, d).where("leg = 'full'"), vectors(spark, d), [1, 5, 20, 50]).select("depth", r("rate").alias("rate"))


@book.query(f"SELECT {rs('avg((n - 1) / (t - 1))')} AS prior FROM embeddings JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label), (SELECT count(*) AS t FROM embeddings)")
def label_prior(spark, d):
    return S.label_prior(vectors(spark, d).select("label")).select(r("prior").alias("prior"))


_HARD = f"WITH {RUN_SQL}, s AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM run WHERE leg = 'full' AND rank <= 20), n AS (SELECT qid, doc_id, score FROM s WHERE k > 1) "


@book.query(_HARD + f"SELECT qid, doc_id, {rs('exp(5 * (score - max(score) OVER (PARTITION BY qid))) / sum(exp(5 * (score - mx))) OVER (PARTITION BY qid)')} AS w FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS mx FROM n)")
def hardness_weights(spark, d):
    """Weights of a query's 2nd to 20th nearest as negatives, the nearest being the positive."""
    near = run(spark, d).where("leg = 'full' AND rank <= 20").select("qid", "doc_id", F.col("score").alias("s"), (F.col("rank") == 1).cast("int").alias("positive"))
    return S.hardness_weights(near, 5.0).select("qid", "doc_id", r("w").alias("w"))


def _at(alpha: float, name: str, where: str = "true") -> str:
    moved = f"list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda z: {1 - alpha!r}::DOUBLE * z[1] + {alpha!r}::DOUBLE * z[2])"
    return f"{name} AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, {moved} AS v FROM embeddings WHERE {where}))"


_STEPS = [(float(t), float(s)) for t, s in ((0, 0), (1, 0), (3, 0), (3, 2), (5, 0), (5, 4))]


def _overlap_sql(i: int, t: float, s: float) -> str:
    now, then = S.drift(t, PACE), S.drift(s, PACE)
    top = lambda c, n: f"{n} AS (SELECT qid, doc_id FROM (SELECT q.vec_id AS qid, c.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, c.v), 9) DESC, c.vec_id) AS k FROM q{i} q JOIN {c} c ON q.vec_id <> c.vec_id) WHERE k <= 10)"
    return ", ".join([_at(now, f"q{i}", "vec_id % 20 = 0"), _at(now, f"f{i}"), _at(then, f"s{i}"), top(f"f{i}", f"fresh{i}"), top(f"s{i}", f"stale{i}")])


_REFRESH = sorted({(float(t), float(t - t % i)) for i in (1, 2) for t in range(4)})


def _overlaps_sql(steps) -> str:
    each = (f"SELECT {t}::DOUBLE AS t, {s}::DOUBLE AS refreshed, avg(h) / 10 AS overlap FROM (SELECT a.qid, count(b.doc_id) AS h FROM fresh{i} a LEFT JOIN stale{i} b ON a.qid = b.qid AND a.doc_id = b.doc_id GROUP BY 1)" for i, (t, s) in enumerate(steps))
    return "WITH " + ", ".join(_overlap_sql(i, t, s) for i, (t, s) in enumerate(steps)) + ", o AS (" + " UNION ALL ".join(each) + ") "


@book.query(_overlaps_sql(_STEPS) + f"SELECT t, refreshed, {rs('overlap')} AS overlap FROM o")
def index_staleness(spark, d):
    """An encoder turning each vector towards its reverse; what an index encoded earlier still finds."""
    q, c = vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).select("doc_id", "vec")
    return S.staleness(q, c, TURN, _STEPS, 10, PACE).select("t", "refreshed", r("overlap").alias("overlap"))


@book.query(_overlaps_sql(_REFRESH) + f"SELECT i::INT AS interval, {rs('avg(overlap)')} AS overlap, {rs('1 / i')} AS cost FROM o, (SELECT unnest([1, 2]) AS i), range(4) h(t0) WHERE o.t = t0 AND o.refreshed = t0 - t0 % i GROUP BY i")
def refresh_costs(spark, d):
    """Two refresh intervals over four steps: overlap with a fresh index against encodings a step."""
    q, c = vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).select("doc_id", "vec")
    found = S.refresh_costs(written(S.staleness(q, c, TURN, _REFRESH, 10, PACE)), [1, 2], 4)
    return found.select("interval", r("overlap").alias("overlap"), r("cost").alias("cost"))


_FB = f"""WITH {RUN_SQL}, q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 20 = 0),
u AS (SELECT r.qid, generate_subscripts(e.embedding, 1) AS i, unnest(e.embedding)::DOUBLE AS x FROM run r JOIN embeddings e ON e.vec_id = r.doc_id WHERE leg = 'full' AND rank <= 5),
c0 AS (SELECT qid, list(x ORDER BY i) AS c FROM (SELECT qid, i, avg(x) AS x FROM u GROUP BY ALL) GROUP BY 1), c AS (SELECT qid, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c0),
al(alpha) AS (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)), m AS (SELECT alpha, qid, list_transform(list_zip(v, c), lambda z: (1 - alpha) * z[1] + alpha * z[2]) AS v FROM q JOIN c USING (qid), al),
t AS (SELECT alpha, m.qid, e.label, row_number() OVER (PARTITION BY alpha, m.qid ORDER BY round(list_cosine_similarity(m.v, e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS k FROM m JOIN embeddings e ON e.vec_id <> m.qid) """


def _precision(spark, d, moved, k=10, search=knn):
    labels = vectors(spark, d).select("doc_id", "label")
    own = vector_queries(spark, d).select("qid", "qlabel")
    found = search(moved, vectors(spark, d).select("doc_id", "vec"), k, "cosine").join(labels, "doc_id").join(own, "qid")
    return found.groupBy("qid").agg((F.count_if(F.col("label") == F.col("qlabel")) / k).alias("p")).agg(r(F.avg("p")).alias("precision"))


@book.query(_FB + f"SELECT alpha, {rs('avg(p)')} AS precision FROM (SELECT alpha, t.qid, count_if(t.label = q.label) / 10 AS p FROM t JOIN q USING (qid) WHERE k <= 10 GROUP BY ALL) GROUP BY 1")
def feedback_interpolation(spark, d):
    """Queries moved towards the mean of their five nearest documents: share of the ten nearest with the query's label."""
    q, c = vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).select("doc_id", "vec")
    centres, out = written(S.feedback_centroids(q, c, 5)), None
    for alpha in (0.0, 0.5, 1.0):
        row = _precision(spark, d, S.interpolated(q, centres, alpha)).select(F.lit(alpha).alias("alpha"), "precision")
        out = row if out is None else out.unionByName(row)
    return out


_AXIS = """WITH u AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), g0 AS (SELECT list(x ORDER BY i) AS g FROM (SELECT i, avg(x) AS x FROM u GROUP BY 1)),
g AS (SELECT list_transform(g, lambda x: x / sqrt(list_dot_product(g, g))) AS g FROM g0), th(theta) AS (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)),
m AS (SELECT theta, vec_id AS qid, label, list_transform(list_zip(embedding::DOUBLE[], g), lambda z: cos(theta) * z[1] + sin(theta) * z[2]) AS v FROM embeddings, g, th WHERE vec_id % 20 = 0),
t AS (SELECT theta, m.qid, (m.label = e.label)::INT AS same, row_number() OVER (PARTITION BY theta, m.qid ORDER BY round(list_cosine_similarity(m.v, e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS k FROM m JOIN embeddings e ON e.vec_id <> m.qid) """


@book.query(_AXIS + f"SELECT theta, {rs('avg(p)')} AS precision FROM (SELECT theta, qid, sum(same) / 10 AS p FROM t WHERE k <= 10 GROUP BY ALL) GROUP BY 1")
def turned_queries(spark, d):
    """Queries turned towards the mean direction of all vectors."""
    q, out = vector_queries(spark, d).select("qid", "vec"), None
    axis = S.mean_axis(vectors(spark, d))
    for theta in (0.0, 0.5, 1.0):
        row = _precision(spark, d, S.off_axis(q, axis, theta)).select(F.lit(theta).alias("theta"), "precision")
        out = row if out is None else out.unionByName(row)
    return out


_LAB = """u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL) GROUP BY 1)"""


@book.query(f"""WITH {_LAB}, m0 AS (SELECT max(label) AS top FROM embeddings), sh(share) AS (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (1.0::DOUBLE)),
m AS (SELECT share, vec_id AS qid, e.label, CASE WHEN {mixed_sql("vec_id", "0")} < ceil(share * {PRIME}) THEN b.c ELSE a.c END AS v FROM embeddings e JOIN c a USING (label), m0, c b, sh WHERE vec_id % 20 = 0 AND b.label = (e.label + 1) % (top + 1)),
t AS (SELECT share, m.qid, (m.label = e.label)::INT AS same, row_number() OVER (PARTITION BY share, m.qid ORDER BY round(list_cosine_similarity(m.v, e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS k FROM m JOIN embeddings e ON e.vec_id <> m.qid)
SELECT share, {rs('avg(p)')} AS precision FROM (SELECT share, qid, sum(same) / 10 AS p FROM t WHERE k <= 10 GROUP BY ALL) GROUP BY 1""")
def hypothetical_answers(spark, d):
    """Search by a made-up answer (the label's mean direction), for a share of the queries of the next label."""
    own = vector_queries(spark, d).select("qid", F.col("qlabel").alias("label"))
    top = vectors(spark, d).agg(F.max("label")).first()[0]
    centres = written(mean_direction(vectors(spark, d), ["label"]).select("label", F.col("mu").alias("centroid")))
    gold = own.join(centres, "label").select("qid", "centroid")
    misled = own.withColumn("label", (F.col("label") + 1) % (top + 1)).join(centres, "label").select("qid", "centroid")
    out = None
    for share in (0.0, 0.3, 1.0):
        asked = S.hypothetical_centroids(gold, misled, share).withColumnRenamed("centroid", "vec")
        row = _precision(spark, d, asked, search=knn_of_equals).select(F.lit(share).alias("share"), "precision")
        out = row if out is None else out.unionByName(row)
    return out

