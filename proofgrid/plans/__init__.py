"""Operators bound to the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

MODULES = ["capture", "policy", "address", "geo", "discovery", "admission", "stores", "labels",
           "scenes", "points", "drawings", "catalog", "evaluation", "events"]


def load_all() -> None:
    """Import every binding module so that its queries register themselves."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
