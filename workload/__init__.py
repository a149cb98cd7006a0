"""Queries over the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scoring", "leads", "pages", "caches", "texts", "grounding", "facts", "verdicts", "streams", "jobs")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"workload.{name}"), attribute))
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
