"""All queries of the library but those of its separate subpackages."""

from __future__ import annotations

from . import check_queries, cohort_queries, content_queries, event_queries, evidence_queries, ingest_queries, lineage_queries, rule_queries, scoring_queries, source_queries, stream_queries, version_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
