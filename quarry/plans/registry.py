"""Collects the queries of every module that offers ``QUERIES`` (name -> function) and ``ORACLE`` (name -> SQL)."""

from __future__ import annotations

import importlib

#: Modules with queries of the engine's own operators.
MODULES: tuple[str, ...] = ("quarry.plans.q_retrieval", "quarry.plans.q_index", "quarry.plans.q_eval", "quarry.plans.q_plan", "quarry.plans.q_state", "quarry.plans.q_more", "quarry.plans.q_rest", "quarry.plans.q_loop")
FLAGSHIP = "R01_bm25"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in importlib.import_module(m).ORACLE.items()}
