"""Blocks of the postings of the queries' terms, without an index of all terms."""

import math
import random
from collections import Counter

import pytest

from ferrule.operators import lexical
from ferrule.queries import lexical as lexical_queries


@pytest.mark.parametrize("ranges", [1, 5])
@pytest.mark.parametrize("most", [1000, 1])  # small tables sent to all tasks, and joined by shuffle
def test_blocks_against_plain_postings(spark, monkeypatch, ranges, most):
    monkeypatch.setattr(lexical, "MOST_SENT", most)
    rng = random.Random(9)
    docs = {i * 3: " ".join(rng.choice(["Red", "green", "blue", "x1"]) for _ in range(rng.randrange(12))) for i in range(60)}
    docs[500] = None
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    terms = spark.createDataFrame([("red",), ("blue",), ("red",), ("none",)], "term string")
    tf = {i: Counter((t or "").lower().split()) for i, t in docs.items()}
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    want = []
    for term in ("blue", "red"):
        ids = sorted(i for i in tf if tf[i][term])
        idf = math.log((len(tf) - len(ids) + 0.5) / (len(ids) + 0.5) + 1)
        weight = {i: idf * tf[i][term] * 2.5 / (tf[i][term] + 1.5 * (0.25 + 0.75 * sum(tf[i].values()) / mean)) for i in ids}
        want += [(term, b, ids[b * 4 : b * 4 + 4][-1], round(max(weight[i] for i in ids[b * 4 : b * 4 + 4]), 9)) for b in range(-(-len(ids) // 4))]
    got = lexical.term_blocks(df, terms, block_size=4, ranges=ranges).collect()
    assert sorted((r["term"], r["block"], r["last_doc"], round(r["bound"], 9)) for r in got) == want


def test_query_equals_the_index_and_stores_none(spark, sf_dir, monkeypatch):
    want = lexical.posting_blocks(lexical_queries._index(spark, sf_dir), lexical_queries._queries(spark, sf_dir)).collect()

    def no_index(*more):
        raise AssertionError("all terms are stored")

    monkeypatch.setattr(lexical, "stored_index", no_index)
    rows = lambda df: sorted((r["term"], r["block"], r["last_doc"], round(r["bound"], 6)) for r in df)
    assert rows(lexical_queries.block_bounds(spark, sf_dir).collect()) == rows(want)
