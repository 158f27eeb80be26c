"""Registered queries, one module per area."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import ORACLES, PLANS


def load() -> dict:
    """Import every module of this package, which fills the registry."""
    for mod in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{mod.name}")
    return PLANS


__all__ = ["load", "PLANS", "ORACLES"]
