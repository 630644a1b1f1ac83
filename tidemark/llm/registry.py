"""The queries of this package by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import queries_join, queries_search, queries_text

QUERIES = {**queries_text.QUERIES, **queries_join.QUERIES, **queries_search.QUERIES}
ORACLES = {**queries_text.ORACLES, **queries_join.ORACLES, **queries_search.ORACLES}
