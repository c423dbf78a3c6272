"""The query catalogue: each module has QUERIES (name -> function) and ORACLE (name -> DuckDB statement)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "stats", "graph", "edges", "linking", "metrics", "training", "records", "relational", "streaming", "sources")


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= import_module(f"querymill.plans.{m}").QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= import_module(f"querymill.plans.{m}").ORACLE
    return found


def FLAGSHIP(spark, sf_dir):  # noqa: N802
    return queries()["bm25_topk"](spark, sf_dir)
