"""All queries of the engine, by operator."""

from __future__ import annotations

from .plans import audit_queries, bank_queries, compose_queries, export_queries, formula_queries, job_queries, layout_queries, matching_queries, more_queries, numbering_queries, page_queries, section_queries, segment_queries, source_queries, stacked_queries, stream_queries  # noqa: F401  importing registers
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
