"""Approximate search queries. The SQL ones use the 16 vectors of the smallest ids as a codebook."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.dice import PRIME, mixed
from ..operators import ann as A
from ..operators.dense import knn, recall_against
from ..plans.durable import written
from .base import RUN_SQL, Book, n, r, ranked, ranked_sql, rs, run, vector_queries, vectors

book = Book()
K = 16
_L2 = "pow(list_distance({a}::DOUBLE[], {b}::DOUBLE[]), 2)"
_ASSIGN = f"""WITH book AS (SELECT vec_id AS cell, embedding AS c FROM embeddings WHERE vec_id < {K}),
dist AS (SELECT e.vec_id AS doc_id, cell, {_L2.format(a='e.embedding', b='c')} AS d FROM embeddings e, book),
cells AS (SELECT doc_id, cell, d FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 9), cell) AS k FROM dist) WHERE k = 1) """


def _book(spark, d):
    rows = vectors(spark, d).where(F.col("doc_id") < K).orderBy("doc_id").select(F.col("vec").cast("array<double>")).collect()
    return np.array([x[0] for x in rows])


@book.query(_ASSIGN + f"SELECT doc_id, cell, {rs('d')} AS residual2 FROM cells")
def codeword_assignment(spark, d):
    return A.assign(vectors(spark, d).select("doc_id", "vec"), _book(spark, d)).select("doc_id", "cell", r("residual2").alias("residual2"))


@book.query(_ASSIGN + f", u AS (SELECT cell, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM cells JOIN embeddings ON vec_id = doc_id), m AS (SELECT cell, pos, avg(x) AS x FROM u GROUP BY ALL), k AS (SELECT cell, count(*) AS n FROM cells GROUP BY 1) SELECT cell, n, {rs('sqrt(sum(x * x))')} AS length FROM m JOIN k USING (cell) GROUP BY ALL")
def codebook_update(spark, d):
    """One update of the codebook: size of each cell and length of its mean."""
    sums, counts, _ = A.cell_sums(vectors(spark, d), _book(spark, d))
    rows = [(i, int(c), round(float(np.linalg.norm(s / c)), 6)) for i, (s, c) in enumerate(zip(sums, counts, strict=True)) if c > 0]
    return spark.createDataFrame(rows, "cell long, n long, length double")


@book.query(_ASSIGN + f"SELECT {rs('sum(d)')} AS distortion FROM cells")
def codebook_distortion(spark, d):
    return A.assign(vectors(spark, d).select("doc_id", "vec"), _book(spark, d)).agg(r(F.sum("residual2")).alias("distortion"))


@book.query()
def trained_codebook(spark, d):
    """Distortion of each round of Lloyd's algorithm from D^2-weighted seeds."""
    v = vectors(spark, d).select("doc_id", "vec")
    _, history = A.lloyd(v, A.seed_codebook(v, K), 6)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(history)], "round long, distortion double")


_PROBE = _ASSIGN + f""", qc AS (SELECT doc_id AS qid, cell FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 9), cell) AS k FROM dist WHERE doc_id % 20 = 0) WHERE k <= 4),
pairs AS (SELECT qc.qid, c.doc_id, -{_L2.format(a='q.embedding', b='e.embedding')} AS score FROM qc JOIN cells c ON c.cell = qc.cell AND c.doc_id <> qc.qid JOIN embeddings q ON q.vec_id = qc.qid JOIN embeddings e ON e.vec_id = c.doc_id) """


@book.query(_PROBE + ranked_sql("SELECT * FROM pairs", 10))
def cell_probe_topk(spark, d):
    return ranked(A.probe(vector_queries(spark, d), vectors(spark, d), _book(spark, d), 4))


@book.query(_PROBE + f"SELECT {rs('avg(n / t)')} AS fraction FROM (SELECT qid, count(*) AS n FROM pairs GROUP BY 1), (SELECT count(*) AS t FROM embeddings)")
def candidate_fraction(spark, d):
    v = vectors(spark, d)
    total = v.count()
    return A.probed(vector_queries(spark, d), v, _book(spark, d), 4).agg(r(F.avg(F.col("scanned") / F.lit(float(total)))).alias("fraction"))


_M = 4
_PARTS = [(16 * j + 1, 16 * j + 16) for j in range(_M)]
_CODES = f"WITH book AS (SELECT vec_id AS cell, embedding AS c FROM embeddings WHERE vec_id < {K}), " + ", ".join(
    f"c{j} AS (SELECT doc_id, cell AS code{j}, d AS d{j} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 9), cell) AS k FROM (SELECT e.vec_id AS doc_id, cell, {_L2.format(a=f'list_slice(e.embedding, {a}, {b})', b=f'list_slice(c, {a}, {b})')} AS d FROM embeddings e, book)) WHERE k = 1)" for j, (a, b) in enumerate(_PARTS)
) + ", codes AS (SELECT * FROM c0 JOIN c1 USING (doc_id) JOIN c2 USING (doc_id) JOIN c3 USING (doc_id)) "


def _books(spark, d):
    whole = _book(spark, d)
    return [whole[:, p] for p in A.subspaces(whole.shape[1], _M)]


@book.query(_CODES + f"SELECT doc_id, code0, code1, code2, code3, {rs('d0 + d1 + d2 + d3')} AS error FROM codes")
def product_codes(spark, d):
    out = A.encode(vectors(spark, d), _books(spark, d))
    return out.select("doc_id", *[n(F.col("codes")[j]).alias(f"code{j}") for j in range(_M)], r("error").alias("error"))


_ADC = " + ".join(_L2.format(a=f"list_slice(q.embedding, {a}, {b})", b=f"list_slice(b{j}.c, {a}, {b})") for j, (a, b) in enumerate(_PARTS))


@book.query(_CODES + ranked_sql(f"SELECT q.vec_id AS qid, doc_id, -({_ADC}) AS score FROM codes JOIN book b0 ON b0.cell = code0 JOIN book b1 ON b1.cell = code1 JOIN book b2 ON b2.cell = code2 JOIN book b3 ON b3.cell = code3 JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> doc_id", 10))
def asymmetric_code_topk(spark, d):
    books = _books(spark, d)
    return ranked(A.code_search(vector_queries(spark, d), A.encode(vectors(spark, d), books), books))


#: The residuals' books are the differences of the first vectors from the first one, in the same parts.
_RES = _ASSIGN + ", " + ", ".join(
    f"""r{j} AS (SELECT doc_id, cell, code{j}, rb FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 9), code{j}) AS k FROM (
      SELECT c.doc_id, c.cell, y.vec_id AS code{j}, rb, list_sum(list_transform(list_zip(x, rb), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM (
        SELECT cells.doc_id, cells.cell, list_transform(list_zip(e.embedding::DOUBLE[], b.embedding::DOUBLE[])[{a}:{z}], lambda z: z[1] - z[2]) AS x FROM cells JOIN embeddings e ON e.vec_id = cells.doc_id JOIN embeddings b ON b.vec_id = cells.cell) c,
        (SELECT e.vec_id, list_transform(list_zip(e.embedding::DOUBLE[], o.embedding::DOUBLE[])[{a}:{z}], lambda z: z[1] - z[2]) AS rb FROM embeddings e JOIN embeddings o ON o.vec_id = 0 WHERE e.vec_id < {K}) y)) WHERE k = 1)"""
    for j, (a, z) in enumerate(_PARTS)
) + f""", qcell AS (SELECT doc_id AS qid, cell FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 9), cell) AS k FROM dist WHERE doc_id % 20 = 0) WHERE k <= 4),
qres AS (SELECT qid, cell, list_transform(list_zip(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] - z[2]) AS x FROM qcell JOIN embeddings q ON q.vec_id = qid JOIN embeddings b ON b.vec_id = cell) """
_RESD = " + ".join(f"list_sum(list_transform(list_zip(x[{a}:{z}], r{j}.rb), lambda z: (z[1] - z[2]) * (z[1] - z[2])))" for j, (a, z) in enumerate(_PARTS))


def _residual_books(spark, d):
    whole = _book(spark, d)
    return [whole[:, p] - whole[0, p] for p in A.subspaces(whole.shape[1], _M)]


@book.query(_RES + ranked_sql(f"SELECT qid, r0.doc_id, -({_RESD}) AS score FROM qres JOIN r0 USING (cell) JOIN r1 USING (doc_id) JOIN r2 USING (doc_id) JOIN r3 USING (doc_id) WHERE r0.doc_id <> qid", 10))
def residual_code_topk(spark, d):
    """Cells of the first vectors, codes of the residuals in them, four cells probed."""
    book_, books = _book(spark, d), _residual_books(spark, d)
    coded = A.residual_codes(vectors(spark, d).select("doc_id", "vec"), book_, books)
    return ranked(A.residual_search(vector_queries(spark, d), coded, book_, books, 4, 10))


@book.query(_ASSIGN + f""", u AS (SELECT generate_subscripts(e.embedding, 1) AS i, unnest(e.embedding)::DOUBLE AS x, unnest(e.embedding)::DOUBLE - unnest(b.embedding)::DOUBLE AS y FROM cells JOIN embeddings e ON e.vec_id = doc_id JOIN embeddings b ON b.vec_id = cell)
SELECT {rs('sum(vx)')} AS raw, {rs('sum(vy)')} AS residual FROM (SELECT var_pop(x) AS vx, var_pop(y) AS vy FROM u GROUP BY i)""")
def residual_variance(spark, d):
    v = A.residual_variance(vectors(spark, d), _book(spark, d))
    return spark.createDataFrame([(round(v["raw"], 6), round(v["residual"], 6))], "raw double, residual double")


@book.query(f"""WITH pv AS (SELECT vec_id AS p, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 4), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT qid, min(list_distance(q.v, e.embedding::DOUBLE[])) AS r FROM q JOIN embeddings e ON e.vec_id <> qid GROUP BY 1), dq AS (SELECT qid, p, list_distance(q.v, pv.v) AS dq FROM q, pv), dx AS (SELECT vec_id, p, list_distance(embedding::DOUBLE[], pv.v) AS dx FROM embeddings, pv),
k AS (SELECT qid, vec_id, bool_and(round(abs(dq - dx), 9) <= round(r, 9)) AS kept FROM dq JOIN dx USING (p) JOIN r USING (qid) WHERE vec_id <> qid GROUP BY ALL) SELECT qid, {rs('avg(kept::INT)')} AS share FROM k GROUP BY 1""")
def inspected_share(spark, d):
    """Candidates that the first four vectors as pivots leave for an exact nearest-neighbour search."""
    return A.inspected_share(vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).select("doc_id", "vec"), _book(spark, d)[:4]).select("qid", r("share").alias("share"))


@book.query()
def rotated_codebooks(spark, d):
    """Distortion of product codes while codebooks and rotation are trained in turn."""
    _, _, history = A.train_rotated(vectors(spark, d).select("doc_id", "vec"), 64, _M, 16, rounds=3, steps=2)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(history)], "round long, distortion double")


@book.query()
def anisotropic_codebook(spark, d):
    """Weighted distortion of each round when the residual along a vector counts four times."""
    _, history = A.anisotropic_lloyd(vectors(spark, d).select("doc_id", "vec"), _book(spark, d), 4.0, 4)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(history)], "round long, distortion double")


@book.query()
def code_search_recall(spark, d):
    """Recall of asymmetric and symmetric search with trained codebooks, plain and after a balancing rotation."""
    from ..operators.dense import principal_axes, project

    q, c = vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).select("doc_id", "vec")
    truth = knn(q, c, 10, "euclidean")
    _, values, axes = principal_axes(c)
    turn = A.parametric_rotation(values, axes, _M)
    out = None
    for name, qv, cv in (("plain", q, c), ("rotated", project(q, turn), project(c, turn))):
        books = A.train_product(cv, 64, _M, 16, rounds=3)
        codes = A.encode(cv, books)
        for symmetric in (False, True):
            found = A.code_search(qv, codes, books, 10, symmetric)
            row = recall_against(found, truth).agg(r(F.avg("recall")).alias("recall")).select(F.lit(name).alias("codes"), F.lit(symmetric).alias("symmetric"), "recall")
            out = row if out is None else out.unionByName(row)
    return out


_TABLES, _BITS = 4, 6
_PLANES = [A.hyperplanes(64, _BITS, seed=t) for t in range(_TABLES)]
_SIG = " UNION ALL ".join(
    f"SELECT vec_id AS doc_id, {t} AS tbl, " + " + ".join(f"(round(list_dot_product(embedding::DOUBLE[], [{', '.join(repr(float(x)) for x in h)}]::DOUBLE[]), 9) >= 0)::BIGINT * {1 << i}" for i, h in enumerate(planes)) + " AS sig FROM embeddings" for t, planes in enumerate(_PLANES)
)


@book.query(f"WITH sig AS ({_SIG}) SELECT doc_id, tbl::BIGINT AS tbl, sig FROM sig")
def hash_signatures(spark, d):
    return A.signatures(vectors(spark, d), _PLANES).select("doc_id", F.col("table").alias("tbl"), "sig")


@book.query(f"WITH sig AS ({_SIG}), cand AS (SELECT DISTINCT a.doc_id AS qid, b.doc_id FROM sig a JOIN sig b ON a.tbl = b.tbl AND a.sig = b.sig AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0) " + ranked_sql(f"SELECT qid, cand.doc_id, -{_L2.format(a='q.embedding', b='e.embedding')} AS score FROM cand JOIN embeddings q ON q.vec_id = qid JOIN embeddings e ON e.vec_id = cand.doc_id", 10))
def hash_table_topk(spark, d):
    return ranked(A.hash_topk(vector_queries(spark, d), vectors(spark, d), _PLANES))


@book.query(f"""WITH {RUN_SQL}, p AS (SELECT 1 - acos(greatest(-1, least(1, score))) / pi() AS p FROM run WHERE leg = 'full' AND rank <= 10)
SELECT k::BIGINT AS k, l::BIGINT AS l, count(*) AS pairs, {rs('avg(1 - pow(1 - pow(p, k), l))')} AS probability FROM p, (SELECT unnest([4, 8]) AS k), (SELECT unnest([1, 4, 16]) AS l) GROUP BY k, l""")
def collision_curve(spark, d):
    """Chance that a query and one of its ten nearest share a bucket in one of l tables of k signs, over all such pairs."""
    near = run(spark, d).where("leg = 'full' and rank <= 10").select((1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score"))) / math.pi).alias("p"))
    shapes = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(t).cast("bigint").alias("l")) for k in (4, 8) for t in (1, 4, 16)])).alias("s")
    chance = 1 - F.pow(1 - F.pow("p", "k"), "l")
    return near.select("p", shapes).select("p", "s.*").groupBy("k", "l").agg(F.count("*").alias("pairs"), r(F.avg(chance)).alias("probability"))


@book.query()
def graph_search_recall(spark, d):
    """Recall and mean work of flat and layered graphs at two beam widths."""
    q, c = vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).select("doc_id", "vec")
    truth = knn(q, c, 10, "euclidean")
    out = None
    for layered in (False, True):
        stored = A.store_graph(c, layered=layered)
        for width in (16, 64):
            found = written(A.search_graph(q, stored, 10, width))  # read for recall and for work
            work = found.groupBy("qid").agg(F.max("work").alias("w")).agg(r(F.avg("w")).alias("work"))
            row = recall_against(found, truth).agg(r(F.avg("recall")).alias("recall")).crossJoin(work).select(F.lit(layered).alias("layered"), F.lit(width).cast("bigint").alias("width"), "recall", "work")
            out = row if out is None else out.unionByName(row)
    return out


@book.query()
def deleted_graph_recall(spark, d):
    """Recall among the living when three tenths of the vectors are dead: left in the graph as tombstones, or taken out with repair."""
    q, c = vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).withColumn("live", mixed("doc_id", F.lit(0)) >= int(0.3 * PRIME))
    truth = knn(q, c.where("live").select("doc_id", "vec"), 10, "euclidean")
    marked, whole = A.store_graph(c, live="live"), A.store_graph(c)
    repaired = A.delete_from_graph(whole, c.where("not live"))
    few = A.search_graph(q, whole, 10, 64).join(c.where("live").select("doc_id"), "doc_id", "left_semi")
    out = None
    for how, found in (("dropped", few), ("tombstones", A.search_graph(q, marked, 10, 64)), ("repaired", A.search_graph(q, repaired, 10, 64))):
        row = recall_against(found, truth).agg(r(F.avg("recall")).alias("recall")).select(F.lit(how).alias("how"), "recall")
        out = row if out is None else out.unionByName(row)
    return out


_PAIRS = f"SELECT q.vec_id AS qid, e.vec_id AS doc_id, e.label, -{_L2.format(a='q.embedding', b='e.embedding')} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id"


@book.query(ranked_sql(f"SELECT qid, doc_id, score FROM ({_PAIRS}) WHERE label < 3", 10))
def filtered_before_search(spark, d):
    return ranked(A.filter_then_search(vector_queries(spark, d), vectors(spark, d), F.col("label") < 3))


@book.query(ranked_sql(f"SELECT qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS k FROM ({_PAIRS})) WHERE k <= 50 AND label < 3", 10))
def filtered_after_search(spark, d):
    return ranked(A.search_then_filter(vector_queries(spark, d), vectors(spark, d), F.col("label") < 3))


@book.query()
def filtered_graph_recall(spark, d):
    q, c = vector_queries(spark, d).select("qid", "vec"), vectors(spark, d).withColumn("live", F.col("label") < 3)
    truth = A.filter_then_search(q, c, F.col("live"))
    found = A.graph_search(q, c, 10, 64, live="live")
    return recall_against(found, truth).agg(r(F.avg("recall")).alias("recall"))
