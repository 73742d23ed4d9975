"""Operators for training-data work. Nothing outside this subpackage imports it."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "clusters",
    "sentences",
    "sampling",
    "arrivals",
    "encoding",
    "packing",
    "levels",
    "privacy",
    "languages",
)


def _modules():
    return [import_module(f"{__name__}.{m}") for m in MODULES]


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
