"""Query registry and plan helpers."""

from importlib import import_module

QUERY_MODULES = (
    "structured", "periods", "scalar_columns", "quality", "cleaning", "recipe_runs",
    "categories", "ledgers", "profit", "grids", "operations", "lineage", "streams",
)


def load_all() -> None:
    """Import every module that registers queries."""
    for name in QUERY_MODULES:
        try:
            import_module(f"reckonry.plans.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"reckonry.plans.{name}":
                raise
