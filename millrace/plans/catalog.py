"""All queries by name, and their SQL."""

from __future__ import annotations

from millrace.plans import relational, retrieval, streams

QUERIES = {**retrieval.query.queries, **relational.query.queries, **streams.query.queries}
ORACLE_SQL = {**retrieval.query.sql, **relational.query.sql, **streams.query.sql}
