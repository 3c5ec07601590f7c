"""All registered queries but those of the corpus operators."""

from __future__ import annotations

from ledgerloom.plans import chunk_queries, document_queries, extraction_queries, filing_queries, graph_queries, knowledge_queries, ledger_queries, market_queries, more_queries, ops_queries, record_queries, rule_queries, scan_queries, sink_queries, stage_queries, stream_queries, whole_queries

MODULES = (market_queries, knowledge_queries, graph_queries, extraction_queries, more_queries, ops_queries, ledger_queries, document_queries, chunk_queries, filing_queries, record_queries, rule_queries, scan_queries, sink_queries, stage_queries, stream_queries, whole_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
