"""The library's own queries, gathered from the plan modules."""

from __future__ import annotations

from annolens.plans import code_queries, contract_queries, run_queries, selection_queries, store_queries, study_queries, text_queries, whole_run_queries  # noqa: F401  register on import
from annolens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
