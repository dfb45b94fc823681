"""Spectral communities of the vectors' graph, and connectivity under predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import spectral as S
from ..operators.ann import store_graph
from ..plans.durable import written
from .base import Book, n, r, rs, vectors
from .graphs import _EDGES, _edges

book = Book()
LABELS = list(range(10))


@book.query()
def spectral_communities(spark, d):
    """Ten communities by the leading eigenvectors of the vectors' graph: size of each, the eigenvalue of its rank (a lower bound after twelve rounds), and the modularity."""
    edges, nodes = written(_edges(spark, d)), vectors(spark, d).select(F.col("doc_id").alias("node"))
    linked = written(nodes.join(G.degrees(edges).select("node"), "node", "left_semi"))
    labels, values = S.spectral_communities(linked, edges, 10, rounds=12)
    q = G.modularity(edges, labels)
    sizes = labels.groupBy("label").agg(F.count("*").alias("nodes"))
    rank = spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(values)], "label long, eigenvalue double")
    return rank.join(F.broadcast(sizes), "label", "left").crossJoin(q).select("label", "eigenvalue", F.coalesce("nodes", F.lit(0)).alias("nodes"), r("q").alias("q"))


@book.query(_EDGES + f""", own AS (SELECT e.src, e.dst, a.label FROM two e JOIN embeddings a ON a.vec_id = e.src JOIN embeddings b ON b.vec_id = e.dst AND b.label = a.label),
reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings WHERE label BETWEEN 0 AND 9 UNION SELECT reach.node, own.dst FROM reach JOIN own ON own.src = reach.seen),
comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY 1), size AS (SELECT label, c, count(*) AS n FROM comp JOIN embeddings ON vec_id = node GROUP BY ALL), k AS (SELECT label, count(*) // 2 AS edges FROM own GROUP BY 1)
SELECT 'label ' || label AS predicate, sum(n)::BIGINT AS nodes, coalesce(any_value(edges), 0)::BIGINT AS edges, count(*) AS components, {rs('max(n) / sum(n)')} AS giant FROM size LEFT JOIN k USING (label) GROUP BY label""")
def label_connectivity(spark, d):
    """What stays connected of the vectors' graph when only one label may be walked through."""
    nodes = vectors(spark, d).select(F.col("doc_id").alias("node"), "label")
    out = S.predicate_connectivity(nodes, _edges(spark, d), {f"label {x}": F.col("label") == x for x in LABELS})
    return out.select("predicate", n("nodes").alias("nodes"), n("edges").alias("edges"), n("components").alias("components"), r("giant").alias("giant"))


@book.query()
def search_graph_connectivity(spark, d):
    """Connectivity of stored search graphs of four and of eight links under predicates of falling selectivity."""
    corpus = vectors(spark, d).select("doc_id", "vec", "label")
    nodes = corpus.select(F.col("doc_id").alias("node"), "label")
    predicates = {f"{10 * x} %": F.col("label") < x for x in (1, 2, 5, 8, 10)}
    out = None
    for m in (4, 8):
        edges = written(S.stored_links(store_graph(corpus.select("doc_id", "vec"), m)))
        part = S.predicate_connectivity(nodes, edges, predicates).select(F.lit(m).cast("bigint").alias("links"), "predicate", n("nodes").alias("nodes"), n("edges").alias("edges"), n("components").alias("components"), r("giant").alias("giant"))
        out = part if out is None else out.unionByName(part)
    return out
