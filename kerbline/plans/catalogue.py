"""All queries of the library's own operators, by name, and their SQL."""

from __future__ import annotations

from . import kernel_queries, measure_queries, network_queries

QUERIES = network_queries.QUERIES | measure_queries.QUERIES | kernel_queries.QUERIES
ORACLE = network_queries.ORACLE | measure_queries.ORACLE | kernel_queries.ORACLE
