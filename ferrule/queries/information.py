"""Information-theoretic queries: documents are a query's ten nearest, answers are labels (their mean directions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import orthogonal_part
from ..operators import information as I
from ..operators.dense import knn, mean_direction
from ..plans.durable import written
from .base import RUN_SQL, Book, n, r, rs, vector_queries, vectors, walk_sql

book = Book()
TAU_DOC, TAU = 0.1, 0.25
_BASE = f"""WITH {RUN_SQL}, top AS (SELECT qid, doc_id, score, rank FROM run WHERE leg = 'full' AND rank <= 10),
rd AS (SELECT qid, doc_id, rank, exp((score - max(score) OVER w) / {TAU_DOC}) / sum(exp((score - mx) / {TAU_DOC})) OVER w AS pd FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS mx FROM top) WINDOW w AS (PARTITION BY qid)),
u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY ALL),
proto AS (SELECT label AS a, list(x / n ORDER BY pos) AS proto FROM c JOIN (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY 1) USING (label) GROUP BY 1),
s AS (SELECT t.qid, t.doc_id, p.a, list_dot_product(q.embedding::DOUBLE[], proto) + list_dot_product(e.embedding::DOUBLE[], proto) AS s FROM top t JOIN embeddings q ON q.vec_id = t.qid JOIN embeddings e ON e.vec_id = t.doc_id, proto p),
post AS (SELECT qid, doc_id, a, exp((s - mx) / {TAU}) / sum(exp((s - mx) / {TAU})) OVER (PARTITION BY qid, doc_id) AS p FROM (SELECT *, max(s) OVER (PARTITION BY qid, doc_id) AS mx FROM s)),
prior AS (SELECT qid, a, sum(pd * p) AS prior FROM post JOIN rd USING (qid, doc_id) GROUP BY ALL) """


def _parts(spark, d):
    q, c = vector_queries(spark, d), vectors(spark, d)
    top = written(knn(q, c, 10, "cosine"))  # read up to four times
    retrieval = I.retrieval_distribution(top, TAU_DOC)
    pairs = top.join(c.select("doc_id", F.col("vec").alias("dvec")), "doc_id").join(q.select("qid", F.col("vec").alias("qvec")), "qid")
    protos = mean_direction(c, ["label"]).select(F.col("label").alias("a"), F.col("mu").alias("proto"))
    posteriors = I.answer_posteriors(pairs.select("qid", "doc_id", "qvec", "dvec"), protos, TAU)
    return top, retrieval, posteriors, I.answer_priors(posteriors, retrieval), pairs


@book.query(_BASE + f"SELECT qid, doc_id, {rs('pd')} AS pd FROM rd")
def retrieval_distribution(spark, d):
    q, c = vector_queries(spark, d), vectors(spark, d)
    return I.retrieval_distribution(knn(q, c, 10, "cosine"), TAU_DOC).select("qid", "doc_id", r("pd").alias("pd"))


@book.query(_BASE + f""", pick AS (SELECT qid, min(CASE WHEN label_d = label_q THEN rank END) AS g, min(CASE WHEN label_d <> label_q THEN rank END) AS x FROM (SELECT t.*, q.label AS label_q, e.label AS label_d FROM top t JOIN embeddings q ON q.vec_id = t.qid JOIN embeddings e ON e.vec_id = t.doc_id) GROUP BY 1),
both2 AS (SELECT qid, g AS rank, 0 AS side FROM pick WHERE g IS NOT NULL AND x IS NOT NULL UNION ALL SELECT qid, x, 1 FROM pick WHERE g IS NOT NULL AND x IS NOT NULL),
b AS (SELECT b.qid, side, first(post.a ORDER BY round(p, 9) DESC, post.a) AS said, 1 - max(p) AS believed, sum(-p * log2(p)) AS entropy FROM both2 b JOIN top t ON t.qid = b.qid AND t.rank = b.rank JOIN post ON post.qid = t.qid AND post.doc_id = t.doc_id GROUP BY ALL),
m AS (SELECT b.qid, side, (said <> q.label)::INT AS realised, believed, entropy FROM b JOIN embeddings q ON q.vec_id = b.qid)
SELECT share, """ + ", ".join(f"{rs(f'avg((1 - share) * x.{c} + share * y.{c})')} AS {c}" for c in ("realised", "believed", "entropy")) + " FROM m x JOIN m y ON x.qid = y.qid AND x.side = 0 AND y.side = 1, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(share) GROUP BY 1")
def substituted_readings(spark, d):
    """A query's nearest document of its own label, replaced by its nearest of another with growing probability."""
    top, _, posteriors, _, _ = _parts(spark, d)
    labels = vectors(spark, d).select("doc_id", "label")
    own = vector_queries(spark, d).select("qid", F.col("qlabel").alias("a"))
    near = top.join(labels, "doc_id").join(own, "qid")
    pick = lambda same: near.where(F.col("label") == F.col("a") if same else F.col("label") != F.col("a")).groupBy("qid").agg(F.min_by("doc_id", "rank").alias("doc_id"))
    out = I.substitution_sweep(posteriors, pick(True), pick(False), own, [0.0, 0.25, 0.5, 1.0])
    return out.select("share", *[r(c).alias(c) for c in ("realised", "believed", "entropy")])


@book.query(_BASE + f"SELECT qid, a::BIGINT AS a, {rs('prior')} AS prior FROM prior")
def answer_prior(spark, d):
    return _parts(spark, d)[3].select("qid", n("a").alias("a"), r("prior").alias("prior"))


@book.query(_BASE + f"SELECT qid, doc_id, post.a::BIGINT AS a, {rs('log2(p / prior)')} AS pmi FROM post JOIN prior USING (qid, a) JOIN embeddings q ON q.vec_id = qid AND q.label = post.a")
def pointwise_information(spark, d):
    """Bits each document gives for the query's own label."""
    _, _, posteriors, priors, _ = _parts(spark, d)
    own = vector_queries(spark, d).select("qid", F.col("qlabel").alias("a"))
    return I.pointwise_information(posteriors, priors).join(own, ["qid", "a"]).select("qid", "doc_id", n("a").alias("a"), r("pmi").alias("pmi"))


@book.query(_BASE + f"SELECT qid, doc_id, {rs('sum(p * log2(p / prior))')} AS bits FROM post JOIN prior USING (qid, a) GROUP BY ALL")
def document_information(spark, d):
    _, _, posteriors, priors, _ = _parts(spark, d)
    return I.information_of_documents(posteriors, priors).select("qid", "doc_id", r("bits").alias("bits"))


@book.query(_BASE + f""", h0 AS (SELECT qid, sum(-prior * log2(prior)) AS h0 FROM prior GROUP BY 1), h AS (SELECT qid, doc_id, sum(-p * log2(p)) AS h FROM post GROUP BY ALL), h1 AS (SELECT qid, sum(pd * h) AS h1 FROM h JOIN rd USING (qid, doc_id) GROUP BY 1)
SELECT qid, {rs('h0')} AS prior_entropy, {rs('h1')} AS rest_entropy, {rs('h0 - h1')} AS bits FROM h0 JOIN h1 USING (qid)""")
def conditional_information(spark, d):
    _, retrieval, posteriors, priors, _ = _parts(spark, d)
    return I.conditional_information(posteriors, priors, retrieval).select("qid", *[r(c).alias(c) for c in ("prior_entropy", "rest_entropy", "bits")])


@book.query(_BASE + f", m AS (SELECT doc_id, sum(pd) / (SELECT count(DISTINCT qid) FROM rd) AS pm FROM rd GROUP BY 1) SELECT {rs('avg(kl)')} AS bits FROM (SELECT qid, sum(pd * log2(pd / pm)) AS kl FROM rd JOIN m USING (doc_id) GROUP BY 1)")
def query_document_information(spark, d):
    return I.query_document_information(_parts(spark, d)[1]).select(r("bits").alias("bits"))


@book.query(_BASE + f""", g AS (SELECT qid, sum(-p * log2(p)) AS h1, 1 - max(p) AS e1 FROM post JOIN rd USING (qid, doc_id) WHERE rank = 1 GROUP BY 1), b AS (SELECT qid, sum(-prior * log2(prior)) AS h0, 1 - max(prior) AS e0 FROM prior GROUP BY 1)
SELECT x AS recall, {rs('avg(x * h1 + (1 - x) * h0)')} AS entropy, {rs('avg(x * e1 + (1 - x) * e0)')} AS error FROM g JOIN b USING (qid), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS x) GROUP BY x""")
def erasure_channel(spark, d):
    top, _, posteriors, priors, _ = _parts(spark, d)
    gold = top.where("rank = 1").select("qid", "doc_id")
    return I.erasure_sweep(posteriors, priors, gold, [0.0, 0.25, 0.5, 0.75, 1.0]).select("recall", r("entropy").alias("entropy"), r("error").alias("error"))


@book.query(_BASE + f""", w AS (SELECT qid, doc_id, exp((score - mx) / 0.1) / sum(exp((score - mx) / 0.1)) OVER (PARTITION BY qid) AS w FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS mx FROM top WHERE rank <= 5)),
x AS (SELECT w.qid, w.w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM w JOIN embeddings e ON e.vec_id = w.doc_id), m AS (SELECT qid, pos, sum(w * x) AS x FROM x GROUP BY ALL)
SELECT qid, {rs('sqrt(sum(x * x))')} AS length FROM m GROUP BY 1""")
def attention_mixture(spark, d):
    """Length of the attention-weighted mean of a query's first five documents."""
    pairs = _parts(spark, d)[4]
    mix = I.attention_mixture(pairs.select("qid", "doc_id", "score", "rank", "dvec"), 5, 0.1)
    return mix.select("qid", r(F.sqrt(F.aggregate("mix", F.lit(0.0), lambda s, x: s + x * x))).alias("length"))


@book.query()
def context_selection(spark, d):
    """Four selectors of five contexts out of a query's fifty nearest."""
    q, c = vector_queries(spark, d), vectors(spark, d)
    pool = knn(q, c, 50, "cosine").join(c.select("doc_id", F.col("vec").alias("dvec")), "doc_id")
    parts = [I.select_contexts(pool, 5, m).withColumn("method", F.lit(m)) for m in ("top", "mmr", "coverage", "diverse")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@book.query(f"WITH {walk_sql(2)} SELECT hop1.qid, hop1.doc_id AS first, hop2.doc_id AS second FROM hop1 JOIN hop2 USING (qid)")
def second_hop(spark, d):
    """Two hops: the query is replaced by what its nearest document says beyond it; documents already read are skipped."""
    q, c = vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).select("doc_id", "vec")
    first = written(knn(q, c, 1, "cosine").select("qid", "doc_id"))
    asked = written(first.join(c, "doc_id").join(q.withColumnRenamed("vec", "qv"), "qid").select("qid", orthogonal_part("vec", "qv").alias("vec")))
    hop = knn(asked, c, 2, "cosine").join(first, ["qid", "doc_id"], "left_anti")
    best = hop.groupBy("qid").agg(F.min_by("doc_id", "rank").alias("second"))
    return first.withColumnRenamed("doc_id", "first").join(best, "qid")
