"""Query catalogue: importing the modules fills the registry."""

import importlib

MODULES = ["sources", "filters", "joins", "windows", "aggregates", "evidence", "scenarios", "diagnostics",
           "options", "backtests", "classify", "estimators", "text", "portfolio", "composites"]


def load():
    from tidewright.catalog import registry

    for name in MODULES:
        importlib.import_module(f"tidewright.catalog.{name}")
    return registry.QUERIES, registry.ORACLE
