"""Queries over the given tables, with the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "text_queries",
    "cast_queries",
    "qc_queries",
    "script_queries",
    "timeline_queries",
    "source_queries",
]


def load() -> None:
    """Import every query module, which registers its queries."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
