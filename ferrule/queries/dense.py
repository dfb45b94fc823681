"""Dense retrieval and geometry queries over the embeddings."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, dot, lift, norm, squared_distance
from ..operators import dense as D
from ..plans.ranking import top_k
from .base import RUN_SQL, Book, n, r, ranked, ranked_sql, rs, run, vector_queries, vectors

book = Book()
_PAIRS = "SELECT q.vec_id AS qid, e.vec_id AS doc_id, {score} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id"
_DOT = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_L2 = "list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


@book.query(ranked_sql(_PAIRS.format(score=_COS), 10))
def exact_cosine_topk(spark, d):
    return ranked(D.knn(vector_queries(spark, d), vectors(spark, d), 10, "cosine"))


@book.query(ranked_sql(_PAIRS.format(score=_DOT), 10))
def exact_inner_product_topk(spark, d):
    return ranked(D.knn(vector_queries(spark, d), vectors(spark, d), 10, "dot"))


@book.query(ranked_sql(_PAIRS.format(score=f"-pow({_L2}, 2)"), 10))
def exact_euclidean_topk(spark, d):
    return ranked(D.knn(vector_queries(spark, d), vectors(spark, d), 10, "euclidean"))


@book.query(ranked_sql(_PAIRS.format(score=_DOT), 1).replace("score, rank", "score"))
def lifted_inner_product_search(spark, d):
    """The best inner product found as the nearest neighbour after the lift."""
    c = vectors(spark, d)
    most = c.agg(F.max(dot("vec", "vec")).alias("m"))
    lifted = c.crossJoin(F.broadcast(most)).select("doc_id", lift("vec", F.col("m")).alias("vec"))
    q = vector_queries(spark, d).select("qid", F.concat(F.col("vec").cast("array<double>"), F.array(F.lit(0.0))).alias("vec"))
    best = D.knn(q, lifted, 1, "euclidean").select("qid", "doc_id")
    pairs = best.join(c, "doc_id").join(vector_queries(spark, d).select("qid", F.col("vec").alias("qv")), "qid")
    return pairs.select("qid", "doc_id", r(dot("qv", "vec")).alias("score"))


@book.query(f"""WITH s AS (SELECT q.vec_id AS qid, {_L2} AS dist FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT qid, {rs('(max(dist) - min(dist)) / min(dist)')} AS contrast FROM s GROUP BY 1""")
def relative_contrast(spark, d):
    q, c = vector_queries(spark, d), vectors(spark, d)
    near = D.knn(q, c, 1, "euclidean").select("qid", F.sqrt(F.greatest(-F.col("score"), F.lit(0.0))).alias("low"))
    # the farthest vector is the nearest to the mirrored query up to norms, so it is looked for as the lowest score
    far = D.knn(q.withColumn("vec", F.transform("vec", lambda x: -x.cast("double"))), c, 1, "dot").select("qid", "doc_id")
    away = far.join(c, "doc_id").join(q.select("qid", F.col("vec").alias("qv")), "qid").select("qid", F.sqrt(squared_distance("qv", "vec")).alias("high"))
    return near.join(away, "qid").select("qid", r((F.col("high") - F.col("low")) / F.col("low")).alias("contrast"))


@book.query(f"SELECT {rs('avg(x)')} AS mean, {rs('var_pop(x)')} AS variance, {rs('var_pop(x * x) / pow(avg(x * x), 2)')} AS relative_variance FROM (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM embeddings)")
def norm_concentration(spark, d):
    x = vectors(spark, d).select(norm("vec").alias("x"))
    return x.agg(r(F.avg("x")).alias("mean"), r(F.var_pop("x")).alias("variance"), r(F.var_pop(F.col("x") * F.col("x")) / F.pow(F.avg(F.col("x") * F.col("x")), 2)).alias("relative_variance"))


@book.query(f"WITH s AS ({ranked_sql(_PAIRS.format(score=_COS), 10)}) SELECT qid, {rs('avg(score)')} AS mean, {rs('var_pop(score)')} AS variance FROM s GROUP BY 1")
def neighbour_cosine_moments(spark, d):
    near = ranked(D.knn(vector_queries(spark, d), vectors(spark, d), 10, "cosine"))
    return near.groupBy("qid").agg(r(F.avg("score")).alias("mean"), r(F.var_pop("score")).alias("variance"))


_MEAN = """u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY ALL), m AS (SELECT label, sqrt(sum(x * x)) AS rbar FROM c GROUP BY 1), k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)"""


@book.query(f"WITH {_MEAN} SELECT label::BIGINT AS label, n, {rs('rbar')} AS rbar, {rs('rbar * (64 - rbar * rbar) / (1 - rbar * rbar)')} AS kappa FROM m JOIN k USING (label)")
def label_concentration(spark, d):
    """Mean resultant length and concentration of each label's directions."""
    v = vectors(spark, d)
    mean = D.mean_direction(v, ["label"]).join(v.groupBy("label").agg(F.count("*").alias("n")), "label")
    x = F.col("rbar")
    return mean.select(n("label").alias("label"), "n", r("rbar").alias("rbar"), r(x * (64 - x * x) / (1 - x * x)).alias("kappa"))


@book.query(f"WITH {_MEAN} SELECT label::BIGINT AS label, n, {rs('(pow(rbar * n, 2) - n) / (n * (n - 1))')} AS cosine FROM m JOIN k USING (label)")
def label_pairwise_cosine(spark, d):
    return D.mean_pairwise_cosine(vectors(spark, d), ["label"]).select(n("label").alias("label"), "n", r("cosine").alias("cosine"))


@book.query(f"WITH {_MEAN} SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, {rs('sqrt(sum(pow(a.x - b.x, 2)))')} AS gap FROM c a JOIN c b ON a.label < b.label AND a.pos = b.pos GROUP BY ALL")
def centroid_gaps(spark, d):
    """Length of the difference of two groups' centroids."""
    c = D.centroid(vectors(spark, d), ["label"])
    a, b = c.select(F.col("label").alias("a"), F.col("centroid").alias("x")), c.select(F.col("label").alias("b"), F.col("centroid").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select(n("a").alias("a"), n("b").alias("b"), r(F.sqrt(squared_distance("x", "y"))).alias("gap"))


@book.query(f"""WITH {RUN_SQL}, hit AS (SELECT f.qid, f.doc_id, h.doc_id AS found FROM (SELECT * FROM run WHERE leg = 'full' AND rank <= 10) f LEFT JOIN (SELECT * FROM run WHERE leg = 'head' AND rank <= 10) h ON f.qid = h.qid AND f.doc_id = h.doc_id)
SELECT qid, {rs('avg(CASE WHEN found IS NULL THEN 0.0 ELSE 1.0 END)')} AS recall FROM hit GROUP BY 1""")
def prefix_recall(spark, d):
    every = run(spark, d, 10)
    out = D.recall_against(every.where("leg = 'head'"), every.where("leg = 'full'"))
    return out.select("qid", r("recall").alias("recall"))


_PRE = _PAIRS.format(score="-pow(list_distance(list_slice(q.embedding, 1, 16)::DOUBLE[], list_slice(e.embedding, 1, 16)::DOUBLE[]), 2)")


@book.query(f"WITH s AS ({ranked_sql(_PRE, 50)}) " + ranked_sql(f"SELECT s.qid, s.doc_id, -pow({_L2}, 2) AS score FROM s JOIN embeddings q ON q.vec_id = s.qid JOIN embeddings e ON e.vec_id = s.doc_id", 10))
def funnel_retrieval(spark, d):
    return ranked(D.funnel(vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).select("doc_id", "vec"), 16, 50, 10))


_TOK = " + ".join("greatest(" + ", ".join(f"list_dot_product(list_slice(q.embedding, {16 * i + 1}, {16 * i + 16})::DOUBLE[], list_slice(e.embedding, {16 * j + 1}, {16 * j + 16})::DOUBLE[])" for j in range(4)) + ")" for i in range(4))


@book.query(f"WITH {RUN_SQL} " + ranked_sql(f"SELECT r.qid, r.doc_id, {_TOK} AS score FROM run r JOIN embeddings q ON q.vec_id = r.qid JOIN embeddings e ON e.vec_id = r.doc_id WHERE leg = 'full'", 10))
def maxsim_rerank(spark, d):
    """Late interaction: each vector is four tokens of 16 coordinates; the cosine top 50 are ranked again."""
    c, q = vectors(spark, d), vector_queries(spark, d)
    slices = F.array(*[F.slice(F.col("vec").cast("array<double>"), 16 * i + 1, 16) for i in range(4)])
    pairs = D.knn(q, c, 50, "cosine").select("qid", "doc_id")
    score = D.maxsim(q.select("qid", F.posexplode(slices).alias("qtok", "qvec")), c.select("doc_id", F.explode(slices).alias("dvec")), pairs)
    return ranked(top_k(score, 10))


@book.query(f"WITH {_MEAN}, v AS (SELECT pos, var_samp(x) AS v FROM u GROUP BY 1) SELECT {rs('sum(v)')} AS total_variance, {rs('sum(v) * sum(v) / sum(v * v)')} AS diagonal_rank FROM v")
def coordinate_variances(spark, d):
    v = vectors(spark, d).select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.var_samp(F.col("x").cast("double")).alias("v"))
    return v.agg(r(F.sum("v")).alias("total_variance"), r(F.sum("v") * F.sum("v") / F.sum(F.col("v") * F.col("v"))).alias("diagonal_rank"))


@book.query()
def principal_spectrum(spark, d):
    """Eigenvalues with the share explained so far."""
    _, values, _ = D.principal_axes(vectors(spark, d))
    share = D.explained_variance(values)
    return spark.createDataFrame([(i + 1, round(float(a), 6), round(float(b), 6)) for i, (a, b) in enumerate(zip(values, share, strict=True))], "component long, eigenvalue double, explained double")


@book.query()
def projection_recall(spark, d):
    """Recall of the ten nearest after PCA, Gaussian, sign and sparse projections to 16 and 32 coordinates."""
    q, c = vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).select("doc_id", "vec")
    truth = D.knn(q, c, 10, "euclidean")
    mean, _, axes = D.principal_axes(c)
    out = None
    for k in (16, 32):
        matrices = {"pca": axes[:k]} | {f: D.random_projection(len(mean), k, f, seed=7) for f in ("gaussian", "rademacher", "sparse")}
        for family, matrix in matrices.items():
            shift = mean if family == "pca" else None
            found = D.knn(D.project(q, matrix, shift), D.project(c, matrix, shift), 10, "euclidean")
            row = D.recall_against(found, truth).agg(r(F.avg("recall")).alias("recall")).select(F.lit(family).alias("family"), F.lit(k).cast("bigint").alias("k"), "recall")
            out = row if out is None else out.unionByName(row)
    return out


@book.query()
def intrinsic_dimension(spark, d):
    return spark.createDataFrame([(round(float(D.intrinsic_dimension(vectors(spark, d))), 6),)], "dimension double")


@book.query(f"""WITH {RUN_SQL}, p AS (SELECT r.qid, r.doc_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM run r JOIN embeddings q ON q.vec_id = r.qid JOIN embeddings e ON e.vec_id = r.doc_id WHERE leg = 'full' AND rank <= 10)
SELECT qid, {rs('avg(2 - 2 * c)')} AS alignment, {rs('ln(avg(exp(-2 * (2 - 2 * c))))')} AS log_potential FROM p GROUP BY 1""")
def alignment_and_potential(spark, d):
    """Mean squared distance of unit vectors to their neighbours, and the logarithm of their mean Gaussian potential."""
    q, c = vector_queries(spark, d), vectors(spark, d)
    p = D.knn(q, c, 10, "cosine").join(c, "doc_id").join(q.select("qid", F.col("vec").alias("qv")), "qid").select("qid", (2 * cosine_distance("qv", "vec")).alias("s"))
    return p.groupBy("qid").agg(r(F.avg("s")).alias("alignment"), r(F.log(F.avg(F.exp(-2 * F.col("s"))))).alias("log_potential"))


