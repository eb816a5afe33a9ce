"""Views over tables, composed extraction plans, and the registered queries."""

from figurant.plans import geometry_queries, record_queries, text_queries

QUERIES = {**geometry_queries.QUERIES, **text_queries.QUERIES, **record_queries.QUERIES}
ORACLE_SQL = {**geometry_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **record_queries.ORACLE_SQL}
