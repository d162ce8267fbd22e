"""Registered queries: each binds an operator to the test tables and, where SQL can say it, to an oracle."""

from importlib import import_module

FAMILIES = (
    "chain_queries",
    "record_queries",
    "quality_queries",
    "text_queries",
    "source_queries",
    "lifecycle_queries",
    "monitor_queries",
    "stream_queries",
    "function_queries",
)


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"blockloom.plans.{family}")
