"""Registered queries and their SQL twins over the shared tables."""

from importlib import import_module

MODULES = ("catalogue", "search", "vectors", "turns", "activity", "language", "assist", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
