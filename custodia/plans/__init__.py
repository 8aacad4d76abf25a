"""Registered queries over the shared tables."""

import importlib

_MODULES = ["corpus_queries", "log_queries", "retrieval_queries", "source_queries", "stream_queries"]


def load_all():
    """Import every query module once and return the registry."""
    for name in _MODULES:
        importlib.import_module(f"custodia.plans.{name}")
    return importlib.import_module("custodia.plans.registry")
