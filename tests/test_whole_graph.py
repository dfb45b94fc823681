"""The hierarchy of communities is that of the graph of all vectors."""

from pyspark.sql import functions as F

from ferrule.operators import graphs
from ferrule.queries import base
from ferrule.queries import graphs as graph_queries


def test_every_vector_is_linked_to_its_nearest(spark, sf_dir, monkeypatch):
    seen = []

    def told(nodes, edges, **named):
        seen.append((nodes, edges, named["levels"]))
        return None, [(1, 0.5)]

    monkeypatch.setattr(graphs, "local_moves", lambda *a, **named: None)
    monkeypatch.setattr(graphs, "hierarchy", told)
    assert graph_queries.community_hierarchy(spark, sf_dir).count() == 2
    nodes, edges, levels = seen[0]
    every = {r["doc_id"] for r in base.vectors(spark, sf_dir).collect()}
    assert {r[0] for r in nodes.collect()} == every
    assert {x for r in edges.collect() for x in (r["src"], r["dst"])} == every
    around = graphs.degrees(edges).agg(F.min("degree")).first()[0]
    assert around >= 5  # its five nearest at least, whatever its id
    assert levels is None  # no level is left out
    # what the other queries ask stays as their SQL has it
    assert {r["qid"] for r in base.vector_queries(spark, sf_dir).collect()} == {x for x in every if x % 20 == 0}
