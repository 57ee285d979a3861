"""Registered queries: each operator on the shared test tables, with an independent SQL statement."""

from importlib import import_module

MODULES = ("cohorts", "evaluation", "catalogs", "drifts", "files", "models")


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"visitline.plans.{name}")
