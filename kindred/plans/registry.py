"""All queries of the record-linkage operators, and their SQL."""

from __future__ import annotations

from . import decision_queries, link_queries, pair_queries, text_queries

QUERIES = {**text_queries.QUERIES, **pair_queries.QUERIES, **link_queries.QUERIES, **decision_queries.QUERIES}
ORACLE_SQL = {**text_queries.ORACLE, **pair_queries.ORACLE, **link_queries.ORACLE, **decision_queries.ORACLE}
