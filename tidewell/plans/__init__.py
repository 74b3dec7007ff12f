"""Registered queries over the given tables, each beside its SQL."""

from __future__ import annotations

import importlib

from tidewell.plans import registry

MODULES = (
    "window_queries", "clean_queries", "summary_queries", "shape_queries",
    "uncertainty_queries", "model_queries", "source_queries", "stream_queries", "report_queries", "exact_queries",
)


def _load():
    for name in MODULES:
        importlib.import_module(f"tidewell.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLE)
