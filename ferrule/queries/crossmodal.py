"""Cross-modal queries: vectors 2i and 2i + 1 are the two sides of pair i."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossmodal as X
from .base import Book, r, rs, vectors

book = Book()
ALPHAS, THETA = (0.0, 0.5, 1.0), 0.1
_PAIRS = """WITH p AS (SELECT a.vec_id // 2 AS pair_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
u AS (SELECT pair_id, generate_subscripts(x, 1) AS i, unnest(x) - unnest(y) AS d FROM p), m AS (SELECT i, avg(d) AS m, avg(d * d) AS s FROM u GROUP BY 1),
gap AS (SELECT list(m ORDER BY i) AS g FROM m), al(alpha) AS (VALUES """ + ", ".join(f"({a}::DOUBLE)" for a in ALPHAS) + """),
k AS (SELECT alpha, pair_id, list_transform(list_zip(y, g), lambda z: z[1] + alpha * z[2]) AS y FROM p, gap, al) """


def _pairs(spark, d):
    v = vectors(spark, d)
    one = v.where("doc_id % 2 = 0").select(F.expr("doc_id div 2").alias("pair_id"), F.col("vec").alias("x"))
    return one.join(v.where("doc_id % 2 = 1").select(F.expr("doc_id div 2").alias("pair_id"), F.col("vec").alias("y")), "pair_id")


@book.query(_PAIRS + f"SELECT {rs('sum(s)')} AS alignment, {rs('sum(m * m)')} AS gap2, {rs('sum(s) - sum(m * m)')} AS dispersion FROM m")
def alignment_parts(spark, d):
    return X.alignment_parts(_pairs(spark, d)).select(*[r(c).alias(c) for c in ("alignment", "gap2", "dispersion")])


def _recall_sql(score: str) -> str:
    return _PAIRS + f"""SELECT alpha, {rs('avg((place <= 10)::INT)')} AS recall FROM (SELECT k.alpha, p.pair_id, k.pair_id AS other, row_number() OVER (PARTITION BY k.alpha, p.pair_id ORDER BY round({score}, 9) DESC, k.pair_id) AS place FROM p, k) WHERE pair_id = other GROUP BY 1"""


@book.query(_recall_sql("list_cosine_similarity(p.x, k.y)"))
def moved_cosine_recall(spark, d):
    return X.pair_recall(_pairs(spark, d), list(ALPHAS), 10, "cosine").select("alpha", r("recall").alias("recall"))


@book.query(_recall_sql("list_dot_product(p.x, k.y)"))
def moved_dot_recall(spark, d):
    """The same for every alpha: a move of all keys adds one number to a query's scores."""
    return X.pair_recall(_pairs(spark, d), list(ALPHAS), 10, "dot").select("alpha", r("recall").alias("recall"))


@book.query(_PAIRS + f"SELECT alpha, {rs('avg(c)')} AS cosine, {rs(f'avg((c >= {THETA})::INT)')} AS passed FROM (SELECT alpha, list_cosine_similarity(p.x, k.y) AS c FROM p JOIN k USING (pair_id)) GROUP BY 1")
def pair_pass_rates(spark, d):
    return X.pass_rates(_pairs(spark, d), list(ALPHAS), THETA).select("alpha", r("cosine").alias("cosine"), r("passed").alias("passed"))


@book.query(_PAIRS + f"SELECT {rs('avg(list_dot_product(x, y))')} AS dot FROM p")
def pair_dot(spark, d):
    return X.mean_dot(_pairs(spark, d)).select(r("dot").alias("dot"))
