"""All queries of the library itself and their SQL."""

from . import more_queries, queries

QUERIES = queries.QUERIES | more_queries.QUERIES
ORACLE: dict[str, str] = queries.ORACLE | more_queries.ORACLE
