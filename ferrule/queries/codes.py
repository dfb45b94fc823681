"""Queries over codes on both sides, tokens kept as codes, and several codebooks at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import ann as A
from ..operators import codes as C
from ..operators.cascade import centroid_topk, token_cells, token_scores
from ..operators.dense import knn, maxsim_topk, recall_against
from ..plans.durable import written
from ..plans.ranking import top_k
from .ann import _ADC, _CODES, _L2, _M, _PARTS, K, _books
from .base import RUN_SQL, Book, n, r, ranked, ranked_sql, rs, vector_queries, vectors
from .cascades import _TOK, _parts

book = Book()

_TABLES = ", " + ", ".join(f"t{j} AS (SELECT a.cell AS a{j}, b.cell AS b{j}, {_L2.format(a=f'list_slice(a.c, {x}, {z})', b=f'list_slice(b.c, {x}, {z})')} AS d{j} FROM book a, book b)" for j, (x, z) in enumerate(_PARTS)) + " "
_SDC = "SELECT q.doc_id AS qid, c.doc_id, " + " + ".join(f"t{j}.d{j}" for j in range(_M)) + " AS e FROM codes q JOIN codes c ON q.doc_id % 20 = 0 AND q.doc_id <> c.doc_id " + " ".join(f"JOIN t{j} ON t{j}.a{j} = q.code{j} AND t{j}.b{j} = c.code{j}" for j in range(_M))


def _coded_queries(encoded):
    return encoded.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "codes")


@book.query(_CODES + _TABLES + ranked_sql(f"SELECT qid, doc_id, -e AS score FROM ({_SDC})", 10))
def symmetric_code_topk(spark, d):
    """Queries and documents are codes; distances are looked up between codewords."""
    books = _books(spark, d)
    encoded = written(A.encode(vectors(spark, d), books))
    return ranked(C.code_to_code(_coded_queries(encoded), encoded, books))


_TRUE = _L2.format(a="q.embedding", b="e.embedding")
_ADC_ALL = f"SELECT q.vec_id AS qid, doc_id, {_ADC} AS e FROM codes JOIN book b0 ON b0.cell = code0 JOIN book b1 ON b1.cell = code1 JOIN book b2 ON b2.cell = code2 JOIN book b3 ON b3.cell = code3 JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> doc_id"


@book.query(_CODES + _TABLES + f", s AS ({_SDC}), a AS ({_ADC_ALL}), t AS (SELECT a.qid, a.e - {_TRUE} AS x, s.e - {_TRUE} AS y FROM a JOIN s USING (qid, doc_id) JOIN embeddings q ON q.vec_id = a.qid JOIN embeddings e ON e.vec_id = a.doc_id) SELECT qid, count(*) AS pairs, {rs('avg(x * x)')} AS asymmetric, {rs('avg(y * y)')} AS symmetric FROM t GROUP BY 1")
def code_estimation_errors(spark, d):
    """How far both estimates are from the squared distances, over all pairs."""
    out = C.estimation_errors(vector_queries(spark, d).select("qid", "vec"), vectors(spark, d), _books(spark, d))
    return out.select("qid", "pairs", r("asymmetric").alias("asymmetric"), r("symmetric").alias("symmetric"))


_STARTS = 4
_MANY = f"""WITH b0 AS (SELECT vec_id // {K} AS start, vec_id % {K} AS cell, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < {_STARTS * K}),
a0 AS (SELECT start, vec_id, cell, d FROM (SELECT start, e.vec_id, cell, pow(list_distance(e.embedding::DOUBLE[], c), 2) AS d FROM embeddings e, b0) QUALIFY row_number() OVER (PARTITION BY start, vec_id ORDER BY round(d, 9), cell) = 1),
m AS (SELECT start, cell, list(x ORDER BY pos) AS c FROM (SELECT start, cell, pos, avg(x) AS x FROM (SELECT start, cell, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM a0 JOIN embeddings USING (vec_id)) GROUP BY ALL) GROUP BY ALL),
b1 AS (SELECT start, cell, coalesce(m.c, b0.c) AS c FROM b0 LEFT JOIN m USING (start, cell)),
a1 AS (SELECT start, min(d) AS d FROM (SELECT start, e.vec_id, pow(list_distance(e.embedding::DOUBLE[], c), 2) AS d FROM embeddings e, b1) GROUP BY start, vec_id),
h AS (SELECT start, 0 AS round, sum(d) AS d FROM a0 GROUP BY 1 UNION ALL SELECT start, 1, sum(d) FROM a1 GROUP BY 1)
SELECT start, round::BIGINT AS round, {rs('d')} AS distortion, row_number() OVER (PARTITION BY round ORDER BY round(d, 9), start) = 1 AS best FROM h"""


@book.query(_MANY)
def codebook_starts(spark, d):
    """Distortion of four codebooks (16 vectors each) before and after one round, all in one scan a round, and which is best."""
    v = vectors(spark, d)
    rows = v.where(F.col("doc_id") < _STARTS * K).orderBy("doc_id").select(F.col("vec").cast("array<double>")).collect()
    first = np.array([x[0] for x in rows]).reshape(_STARTS, K, -1)
    books, history = C.lloyd_many(v, first, 1)
    totals = [[h[0] for h in history], C.many_cell_sums(v, books)[2].tolist()]
    return spark.createDataFrame([(s, i, round(t, 6), s == int(np.round(row, 9).argmin())) for i, row in enumerate(totals) for s, t in enumerate(row)], "start long, round long, distortion double, best boolean")


@book.query()
def best_codebook(spark, d):
    """Distortion of four trained codebooks of D^2-weighted starts, round by round; the last is after the last update."""
    _, best, history = C.best_codebook(vectors(spark, d), K, starts=4, rounds=6, seed=3)
    return spark.createDataFrame([(s, i, round(t, 6), s == best) for s, h in enumerate(history) for i, t in enumerate(h)], "start long, round long, distortion double, best boolean")


_BITS = 2
_LEVELS = _TOK + f""", res AS (SELECT t.doc_id, t.j, cells.cell, unnest(list_transform(list_zip(v, c), lambda z: z[1] - z[2])) AS x, unnest(c) AS c, unnest(range(16)) AS pos FROM t JOIN cells ON cells.doc_id = t.doc_id AND cells.j = t.j JOIN cent ON cent.cell = cells.cell),
h AS (SELECT max(abs(x)) AS h FROM res), lev AS (SELECT doc_id, j, cell, pos, x, c, h, least(greatest(floor((x + h) / (2 * h) * {1 << _BITS}), 0), {(1 << _BITS) - 1}) AS level FROM res, h),
dec AS (SELECT *, (level + 0.5::DOUBLE) * (2 * h) / {1 << _BITS} - h AS y FROM lev)"""


@book.query(_LEVELS + f" SELECT doc_id, j::BIGINT AS tok, cell::BIGINT AS cell, sum(level * pow(4, pos % 8))::BIGINT AS digits, {rs('sum((x - y) * (x - y))')} AS error FROM dec GROUP BY ALL")
def token_residual_codes(spark, d):
    """Every token as a centroid and two bits a residual coordinate: a sum that tells the levels, and the squared error of decoding."""
    _, tokens, centroids = _parts(spark, d)
    reach = C.residual_reach(tokens, centroids)
    encoded = C.encode_tokens(tokens, centroids, _BITS, reach)
    decoded = C.decode_tokens(encoded, centroids, _BITS, reach).withColumnRenamed("dvec", "y")
    digit = F.aggregate(
        F.sequence(F.lit(0), F.lit(15)),
        F.lit(0).cast("bigint"),
        lambda a, i: a + F.floor(F.conv(F.hex("code"), 16, 10).cast("double") / F.pow(F.lit(4), 15 - i)) % 4 * F.pow(F.lit(4), i % 8).cast("bigint"),
    )
    joined = encoded.join(decoded, ["doc_id", "dtok"]).join(tokens, ["doc_id", "dtok"])
    error = F.aggregate(F.zip_with("dvec", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return joined.select("doc_id", n("dtok").alias("tok"), "cell", digit.alias("digits"), r(error).alias("error"))


@book.query(_LEVELS + f", {RUN_SQL}, dv AS (SELECT doc_id, j, list(c + y ORDER BY pos) AS v FROM dec GROUP BY ALL), p AS (SELECT run.qid, run.doc_id, t.j, max(list_dot_product(t.v, dv.v)) AS s FROM run JOIN t ON t.doc_id = run.qid JOIN dv ON dv.doc_id = run.doc_id WHERE leg = 'full' GROUP BY ALL) " + ranked_sql("SELECT qid, doc_id, sum(s) AS score FROM p GROUP BY ALL", 10))
def compressed_maxsim_topk(spark, d):
    """The cosine top 50 ranked again by late interaction with tokens decoded from two bits a coordinate."""
    q, tokens, centroids = _parts(spark, d)
    reach = C.residual_reach(tokens, centroids)
    pairs = written(knn(vector_queries(spark, d), vectors(spark, d), 50, "cosine").select("qid", "doc_id"))
    return ranked(top_k(C.compressed_maxsim(q, C.encode_tokens(tokens, centroids, _BITS, reach), pairs, centroids, _BITS, reach), 10))


@book.query()
def compressed_cascade_recall(spark, d):
    """Recall of the whole cascade over coded tokens against exact late interaction with every document, by bits and survivors."""
    q, tokens, centroids = _parts(spark, d)
    reach = C.residual_reach(tokens, centroids)
    truth = written(maxsim_topk(q, tokens.select("doc_id", "dvec"), 10).select("qid", "doc_id"))
    # cells, and so survivors, don't depend on the bits, and few survivors are the first of many
    kept = written(centroid_topk(token_scores(q, centroids), token_cells(tokens, centroids), 4, 160).select("qid", "doc_id", F.col("rank").alias("place")))
    out = None
    for bits in (1, 2, 4):
        encoded = C.encode_tokens(tokens, centroids, bits, reach)
        scored = written(C.compressed_maxsim(q, encoded, kept.select("qid", "doc_id"), centroids, bits, reach).join(kept, ["qid", "doc_id"]).where("qid <> doc_id"))
        for keep in (40, 160):
            found = top_k(scored.where(F.col("place") <= keep).select("qid", "doc_id", "score"), 10)
            row = recall_against(found, truth).agg(F.lit(bits).cast("bigint").alias("bits"), F.lit(keep).cast("bigint").alias("keep"), r(F.avg("recall")).alias("recall"))
            out = row if out is None else out.unionByName(row)
    return out
