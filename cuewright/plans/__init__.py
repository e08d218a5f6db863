"""Named queries: library operators bound to the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from cuewright.plans.registry import QUERIES, Query


def load_queries() -> dict[str, Query]:
    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return QUERIES
