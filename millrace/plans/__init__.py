"""Named queries over the driver tables, one module per family."""

from __future__ import annotations

from importlib import import_module

from millrace.plans.registry import CATALOG, Named

FAMILIES = [
    "payments",
    "maintenance",
    "supply",
    "food",
    "series",
    "finance",
    "models",
    "corpus",
    "retrieval",
    "exchange",
]


def catalog() -> dict[str, Named]:
    for family in FAMILIES:
        import_module(f"millrace.plans.{family}")
    return CATALOG
