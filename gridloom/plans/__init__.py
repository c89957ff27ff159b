"""Registered queries of the library and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("fusion", "context", "cleaning", "ranking", "matching", "profiling", "geometry", "modelling", "publishing", "loading", "audits")


def registered() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for m in MODULES:
        plan = import_module(f"gridloom.plans.{m}")
        queries |= plan.QUERIES
        oracles |= plan.ORACLES
    return queries, oracles
