"""Every registered query of the survival-credit operators, with its DuckDB oracle."""

from __future__ import annotations

from tidemark.plans import analysis_queries, control_queries, data_queries, explain_queries, file_queries, model_queries, report_queries, survival_queries  # noqa: F401  they register themselves
from tidemark.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
