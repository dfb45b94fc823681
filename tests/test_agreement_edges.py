"""A judge who says yes to everything: the corrected rate divides by zero, as in SQL."""

import math

import duckdb
import pytest

from ferrule.queries import agreement


@pytest.mark.parametrize("rows", [[(0.9, 1), (0.8, 0), (0.75, 1)], [(0.1, 1), (0.2, 0)], [(0.9, 1), (0.2, 0), (0.9, 0)], [(0.9, 1), (0.9, 1)]])
def test_corrected_rate_against_sql(spark, monkeypatch, rows):
    monkeypatch.setattr(agreement, "claims", lambda spark, d: spark.createDataFrame(rows, "p double, y int"))
    own = agreement.book.sql["corrected_rate"].split(", v AS (")[1]
    expected = duckdb.sql(f"WITH claims(p, y) AS (VALUES {', '.join(map(str, rows))}), v AS ({own}").fetchall()[0]
    got = tuple(agreement.corrected_rate(spark, "").first())
    assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got, expected, strict=True)), (got, expected)
