"""Registered queries over the supplied tables."""

import importlib

MODULES = ("catalog", "statistics", "evaluation", "rasters", "regions", "jobs", "geometry", "images", "patches", "streams")


def load() -> dict:
    """All queries by name."""
    for module in MODULES:
        importlib.import_module(f"rasterweave.plans.{module}")
    from rasterweave.plans.registry import QUERIES

    return QUERIES
