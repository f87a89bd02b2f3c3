"""Registered queries over the driver tables, each with its SQL twin where one exists."""

from __future__ import annotations

from fleetpulse.catalog.registry import ORACLE, QUERIES


def load() -> tuple[dict, dict]:
    """Import every query module; returns (queries, oracle SQL)."""
    import importlib

    for module in ("features", "explore", "prepare", "drift", "metrics", "ranking",
                   "models", "streams", "files"):
        importlib.import_module(f"fleetpulse.catalog.{module}")
    return QUERIES, ORACLE
