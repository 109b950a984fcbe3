"""All registered queries and their checking SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["link_queries", "quality_queries", "markup_queries", "corpus_queries"]


def load():
    queries, checks = {}, {}
    for name in MODULES:
        module = import_module(f"docweft.plans.{name}")
        queries.update(module.QUERIES)
        checks.update(module.ORACLES)
    return queries, checks
