"""All core queries and their SQL, collected from the plan modules."""

from __future__ import annotations


from . import log_plans, page_plans, question_plans, search_plans, text_plans


def _modules():
    return (text_plans, question_plans, page_plans, search_plans, log_plans)


def queries() -> dict:
    """Name → callable(spark, sf_dir)."""
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracles() -> dict:
    """Name → DuckDB SQL."""
    return {k: v for m in _modules() for k, v in m.SQL.items()}
