"""Registered queries over the given tables, each with its DuckDB counterpart."""

from types import ModuleType


def load() -> ModuleType:
    """The registry with every query module imported."""
    # In this order: later modules use the SQL expressions of earlier ones.
    from jostle.catalog import registry  # noqa: F401
    from jostle.catalog import neighborhood, runs, inference, search, replicas, reconcile, files  # noqa: F401

    if "export_report_tables" not in registry.QUERIES:
        files.register_export()
    return registry
