"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "catalog_queries",
    "vocabulary_queries",
    "search_queries",
    "layout_queries",
    "signal_queries",
    "repeat_queries",
    "conversion_queries",
    "stream_queries",
)


def load() -> None:
    for name in MODULES:
        import_module(f"leafmill.plans.{name}")
