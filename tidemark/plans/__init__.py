"""All registered queries."""

from importlib import import_module

MODULES = ("tables", "joins", "aggregates", "windows", "scalars", "survey", "landings", "shift", "models", "describe")


def load():
    from . import registry

    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return dict(registry.QUERIES), dict(registry.ORACLE)
