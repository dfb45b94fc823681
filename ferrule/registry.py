"""All registered queries of the retrieval library and their oracle SQL."""

from __future__ import annotations

from .queries import agreement, ann, cascades, codes, crossmodal, dense, evaluation, factor, fits, fusion, generation, graphs, information, learning, lexical, principle, relational, sampling, spectral

MODULES = (lexical, dense, fusion, evaluation, agreement, generation, information, learning, ann, graphs, cascades, relational, principle, crossmodal, sampling, factor, codes, fits, spectral)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.book.queries)
    ORACLE_SQL.update(_module.book.sql)
