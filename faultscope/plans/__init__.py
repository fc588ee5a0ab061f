"""Registered queries and the SQL that checks them."""

from importlib import import_module

MODULES = ["panel_queries", "feature_queries", "reshape_queries", "evaluation_queries", "series_queries", "model_queries", "property_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"faultscope.plans.{name}")
