"""The queries that SQL can express equal DuckDB on the small tables and on a hostile one."""

import duckdb
import pytest

from ferrule.llm import queries

from .fixtures import DOCS, hostile_texts
from .test_text_operators import SECRETS


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hostile"))
    rows = list(dict(hostile_texts(seed=9)).items()) + [(3000 + i, t) for i, t in dict(SECRETS).items()]
    spark.createDataFrame([(*r, ("en", "fr", None)[r[0] % 3]) for r in rows], DOCS + ", lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    base = [r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(30).collect()]
    near = [[x + 0.002 * ((i + k) % 7 - 3) for k, x in enumerate(base[0])] for i in range(12)]
    vectors = [(100 * i if i % 3 else i, e, i % 4 if i % 9 else None) for i, e in enumerate(base + near + [base[5], base[5]])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def rows_of(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("table", ["sf0.001", "hostile"])
def test_against_sql(spark, hostile, name, table):
    folder = hostile if table == "hostile" else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        pattern = f"{folder}/{t}.parquet" + ("/*.parquet" if table == "hostile" else "")
        con.execute(f"create view {t} as select * from '{pattern}'")
    df = queries.QUERIES[name](spark, folder)
    answer = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, answer.fetchall())
