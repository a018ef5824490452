"""The registry of queries and of their DuckDB twins."""

from propago.plans import book_queries, hawkes_queries, inference_queries, neural_queries, registry, sequence_queries, source_queries, summary_queries  # noqa: F401

FLAGSHIP = "orders_summary"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
