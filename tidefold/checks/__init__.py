"""Registered queries, each with the SQL it is compared against (or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("preparation", "comparison", "models", "studies", "rules", "files")


def catalog() -> dict:
    out: dict = {}
    for module in MODULES:
        for name, pair in import_module(f"tidefold.checks.{module}").CHECKS.items():
            if name in out:
                raise ValueError(f"The query {name} is registered twice.")
            out[name] = pair
    return out
