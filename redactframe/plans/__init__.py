"""All registered queries."""

from importlib import import_module

from redactframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]

_MODULES = ("detection", "forms", "profiles", "documents", "pages", "audit", "agents", "geometry", "evaluation", "streams")


def load() -> None:
    """Import the query modules, which fill the catalogue."""
    for name in _MODULES:
        import_module(f"redactframe.plans.{name}")
