"""How queries are registered, and the views and SQL that many of them share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dense import knn
from ..operators.evaluation import SameLabel
from ..sources.tables import table

DIGITS = 6


class Book:
    """Queries of one domain with their SQL, if SQL can express them."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def r(c: str | Column) -> Column:
    """Rounded for comparing: sums in another order must not differ."""
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS)


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b in double as DuckDB has it: NaN or infinite, not an error, where b is 0."""
    x = a.cast("double")
    zero = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b != 0, F.try_divide(x, b)).when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(zero)


def rounded_float(c: Column) -> Column:
    """r() that leaves NaN and infinities as they are."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(r(c))


def rs(x: str) -> str:
    """The same in SQL, without a negative zero."""
    return f"(round({x}, {DIGITS}) + 0.0)"


def n(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


#: Whether every vector is a query; see every_vector_asks().
_EVERY = ContextVar("every vector asks", default=False)


@contextmanager
def every_vector_asks() -> Iterator[None]:
    """Inside, vector_queries() are all vectors: for what is said of all of them, not of the answers to some."""
    token = _EVERY.set(True)
    try:
        yield
    finally:
        _EVERY.reset(token)


# Vectors: every vector whose id is divisible by 20 is a query against all others.
def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    asked = vectors(spark, d) if _EVERY.get() else vectors(spark, d).where("doc_id % 20 = 0")
    return asked.select(F.col("doc_id").alias("qid"), "vec", F.col("label").alias("qlabel"))


#: The three legs of the runs: all coordinates by cosine, the first 16, the last 16.
LEGS = {"full": (1, 64), "head": (1, 16), "tail": (49, 16)}
RUN_DEPTH = 50


def run(spark: SparkSession, d: str, depth: int = RUN_DEPTH, only: tuple[str, ...] = tuple(LEGS)) -> DataFrame:
    """(leg, qid, doc_id, score, rank) of every leg, or of those named; a search keeps ``depth`` rows a query and task, so ask for no more than is read."""
    q, c = vector_queries(spark, d), vectors(spark, d)
    legs = []
    for leg, (start, length) in ((leg, LEGS[leg]) for leg in only):
        cut = lambda df: df.withColumn("vec", F.slice("vec", start, length))  # noqa: E731, B023
        legs.append(knn(cut(q), cut(c), depth, "cosine").withColumn("leg", F.lit(leg)))
    out = legs[0]
    for other in legs[1:]:
        out = out.unionByName(other)
    return out


def graded(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id, grade): other vectors of the query's label, graded 1 to 3."""
    q = vector_queries(spark, d).select("qid", F.col("qlabel").alias("label"))
    return q.join(vectors(spark, d).select("doc_id", "label"), "label").where("doc_id <> qid").select("qid", "doc_id", n(1 + F.col("doc_id") % 3).alias("grade"))


def judged(spark: SparkSession, d: str) -> SameLabel:
    """graded() without a row a pair."""
    items = vectors(spark, d).select("doc_id", "label", n(1 + F.col("doc_id") % 3).alias("grade"))
    return SameLabel(vector_queries(spark, d).select("qid", F.col("qlabel").alias("label")), items)


_UNIT = "list_cosine_similarity(list_slice(q.embedding, {a}, {b})::DOUBLE[], list_slice(e.embedding, {a}, {b})::DOUBLE[])"
RUN_SQL = f"""
scored AS (
{" UNION ALL ".join(f"SELECT '{leg}' AS leg, q.vec_id AS qid, e.vec_id AS doc_id, {_UNIT.format(a=s, b=s + k - 1)} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id" for leg, (s, k) in LEGS.items())}
),
run AS (SELECT * FROM (SELECT leg, qid, doc_id, score, row_number() OVER (PARTITION BY leg, qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= {RUN_DEPTH}),
qrels AS (SELECT q.vec_id AS qid, e.vec_id AS doc_id, 1 + e.vec_id % 3 AS grade FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
"""


def walk_sql(hops: int) -> str:
    """CTEs hop1, hop2, ... (qid, doc_id): read the nearest unread vector, go on with what it says beyond the question."""
    out = ["ask1 AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0)"]
    for k in range(1, hops + 1):
        unread = "".join(f" AND NOT EXISTS (SELECT 1 FROM hop{i} WHERE hop{i}.qid = a.qid AND hop{i}.doc_id = e.vec_id)" for i in range(1, k))
        out.append(f"""hop{k} AS (SELECT qid, doc_id FROM (SELECT a.qid, e.vec_id AS doc_id, row_number() OVER (PARTITION BY a.qid ORDER BY round(list_cosine_similarity(a.v, e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS k
          FROM ask{k} a JOIN embeddings e ON e.vec_id <> a.qid{unread}) WHERE k = 1)""")
        out.append(f"""ask{k + 1} AS (SELECT qid, list_transform(o, lambda x: x / sqrt(list_dot_product(o, o))) AS v FROM (
          SELECT qid, list_transform(list_zip(w, v), lambda z: z[1] - p * z[2]) AS o FROM (SELECT h.qid, e.embedding::DOUBLE[] AS w, a.v, list_dot_product(e.embedding::DOUBLE[], a.v) AS p FROM hop{k} h JOIN ask{k} a USING (qid) JOIN embeddings e ON e.vec_id = h.doc_id)))""")
    return ", ".join(out)


# Texts: benchmark passages are queries against all documents.
def text_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


INDEX_SQL = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT d.doc_id, coalesce(t.dl, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1) t USING (doc_id)),
terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY 1),
coll AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum(dl)::BIGINT AS coll_len FROM lens),
qtok AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM qtok GROUP BY ALL)
"""


def ranked_sql(scores: str, k: int) -> str:
    return f"SELECT qid, doc_id, {rs('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({scores})) WHERE rank <= {k}"


def ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "doc_id", r("score").alias("score"), n("rank").alias("rank"))


# Scored and labelled rows: a claim is a vector in a query's ten nearest, its score the cosine, its label whether the labels agree.
def claims(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, p, y): p is a probability-like score in [0, 1]."""
    near = run(spark, d, k, ("full",))
    label = vectors(spark, d).select("doc_id", "label")
    own = label.select(F.col("doc_id").alias("qid"), F.col("label").alias("qlabel"))
    y = F.coalesce(F.col("label") == F.col("qlabel"), F.lit(False)).cast("int")
    return near.join(label, "doc_id").join(own, "qid").select("qid", "doc_id", "rank", F.round((1 + F.col("score")) / 2, 9).alias("p"), y.alias("y"))


CLAIMS_SQL = RUN_SQL + """,
claims AS (SELECT r.qid, r.doc_id, r.rank, round((1 + r.score) / 2, 9) AS p, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS y FROM run r LEFT JOIN qrels g ON r.qid = g.qid AND r.doc_id = g.doc_id WHERE r.leg = 'full' AND r.rank <= 10)
"""
