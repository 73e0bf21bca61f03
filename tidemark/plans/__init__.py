"""The named queries. ``load`` imports every plan module and returns (queries, twins)."""

from importlib import import_module

MODULES = ["features", "evaluation", "joins", "stats", "gates", "news", "models", "streams"]


def load():
    for m in MODULES:
        import_module(f"tidemark.plans.{m}")
    from tidemark.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
