"""All registered queries of the reconciliation library and their SQL."""

from tiersum.jobs import count_queries, diagnostic_queries, publication_queries, queries  # noqa: F401  (they register)

QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL
