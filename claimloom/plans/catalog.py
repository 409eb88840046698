"""All registered queries."""

from __future__ import annotations

import importlib

from claimloom.plans.registry import ORACLES, QUERIES, sql

FLAGSHIP = "k07_rerank_hybrid"
MODULES = (
    "text_queries", "retrieval_queries", "ingest_queries", "report_queries", "history_queries", "dedup_queries",
    "evidence_text_queries", "citation_queries", "evidence_queries", "placement_queries", "onpage_queries", "streaming_queries",
)

for _module in MODULES:
    importlib.import_module(f"claimloom.plans.{_module}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {name: sql(body, *needs) for name, (body, needs) in ORACLES.items()}
