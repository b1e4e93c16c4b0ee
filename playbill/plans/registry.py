"""All queries on the given tables: callables, SQL, and operators covered."""

from . import catalog_queries, feed_queries, listing_queries, operations_queries, page_queries, resolution_queries, streaming_queries

MODULES = (listing_queries, operations_queries, feed_queries, page_queries, catalog_queries, resolution_queries, streaming_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}


def covers() -> dict:
    return {k: s for m in MODULES for k, s in m.COVERS.items()}
