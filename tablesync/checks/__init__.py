"""Runnable queries over the given tables, each with its SQL twin where there is one."""

from importlib import import_module

_MODULES = ("scan", "identity", "mapping", "transforms", "sync", "ledger", "operations", "catalogs", "streams")


def load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
