"""Analyses built from the operators, and the registered queries with their SQL."""

import importlib

_MODULES = ("particle_queries", "grid_queries", "image_queries", "sampling_queries", "run_queries", "source_queries")


def load_all() -> None:
    """Import every query module, which fills the registry."""
    for name in _MODULES:
        importlib.import_module(f"fieldframe.plans.{name}")
