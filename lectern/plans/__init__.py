"""Queries over the driver's tables; load() registers those of all modules."""

from importlib import import_module

MODULES = ("store", "sequences", "aggregates", "scalars", "models", "audio")


def load() -> None:
    for m in MODULES:
        import_module(f"lectern.plans.{m}")
