"""Registry of the annotation queries and their DuckDB equivalents."""

from __future__ import annotations

from annogrid.plans import annotation_queries, image_queries, model_queries, source_queries

QUERIES: dict = annotation_queries.QUERIES | image_queries.QUERIES | model_queries.QUERIES | source_queries.QUERIES
ORACLES: dict = annotation_queries.ORACLES | image_queries.ORACLES | model_queries.ORACLES | source_queries.ORACLES
