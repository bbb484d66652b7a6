"""Registered queries of the core, by module."""

from __future__ import annotations

from lodegraph.plans import graphs, hierarchies, retrievals, streams, tables

MODULES = [hierarchies, graphs, retrievals, tables, streams]


def all_queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
