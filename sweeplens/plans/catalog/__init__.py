"""Registered queries: each family module has ``QUERIES`` and ``ORACLES``."""

from __future__ import annotations

import importlib

FAMILIES = (
    "config", "scoring", "analysis", "beam", "surrogate", "localization", "runs", "tabular", "streams",
)


def _collect(attribute: str) -> dict:
    found: dict = {}
    for family in FAMILIES:
        module = importlib.import_module(f"{__name__}.{family}")
        found.update(getattr(module, attribute))
    return found


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
