"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["metrics", "links", "pages", "selection", "scans", "tables", "search", "alerts", "markets", "streams"]


def load() -> None:
    for name in MODULES:
        import_module(f"pressmill.plans.{name}")


load()
