"""Registered queries of the audit operators, each with its SQL twin."""

from __future__ import annotations

from quarry.plans import context_queries, finding_queries, graph_queries, knowledge_queries, rule_queries, scan_queries, source_queries, stream_queries, usage_queries

PARTS = (scan_queries, usage_queries, finding_queries, graph_queries, knowledge_queries, context_queries, rule_queries, source_queries, stream_queries)
QUERIES = {name: run for part in PARTS for name, run in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
