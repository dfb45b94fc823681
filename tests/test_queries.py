"""Every registered query of the library runs; those with SQL equal DuckDB's answer."""

import os

import duckdb
import pytest

from ferrule import registry

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(FOLDER, t)}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    answer = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    got, expected = rows(df.columns, df.collect()), rows(columns, answer.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_contract(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["qid", "doc_id", "score", "rank"]


def test_order_inversions_of_a_lone_document(spark, monkeypatch):
    from ferrule.queries import principle

    ranked = [(1, 10, 1, 0.2), (1, 11, 2, 0.9), (1, 12, 3, 0.5), (2, 10, 1, 0.5), (3, 10, 1, 0.5), (3, 11, 2, 0.5)]
    monkeypatch.setattr(principle, "_ranking", lambda spark, d: spark.createDataFrame(ranked, "qid long, doc_id long, rank long, p double"))
    sql = f"WITH rk(qid, doc_id, rank, p) AS (VALUES {', '.join(map(str, ranked))}) " + principle.book.sql["order_inversions"].removeprefix(principle._BASE)
    got = {r["qid"]: r["inversions"] for r in principle.order_inversions(spark, "").collect()}
    assert got == dict(duckdb.sql(sql).fetchall()) == {1: 2, 2: None, 3: 0}
