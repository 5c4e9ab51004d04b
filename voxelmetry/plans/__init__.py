"""Query plans over the given tables, one module per chapter of the inventory."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Imports every ``*_queries`` module, which registers its queries."""
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
