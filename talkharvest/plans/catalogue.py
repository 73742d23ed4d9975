"""All queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("text_queries", "message_queries", "vector_queries", "pipeline_queries")


def _modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLE
    return out
