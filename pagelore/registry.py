"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("search", "pages", "compare", "structure", "exchange", "history", "geometry", "glyphs", "stream", "annots", "moves", "jobs", "writing")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"pagelore.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
