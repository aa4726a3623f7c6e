"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

from boxloom.plans.registry import REGISTRY, Query

#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("detection", "annotation", "duplication", "splitting", "severity", "profiling", "kernels")


def load_registry() -> dict[str, Query]:
    """Import every query module once and return the registry."""
    for module in MODULES:
        importlib.import_module(f"boxloom.plans.{module}")
    return REGISTRY
