"""Every operator bound to the driver's tables, with an equivalent DuckDB statement where there is one."""
from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ["relational", "cleaning", "profiling", "concentration", "series", "inference", "anomalies", "segments",
            "textual", "scenarios", "results"
            ]


def _sections():
    return [import_module(f"{__name__}.{s}") for s in SECTIONS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for s in _sections():
        for name, fn in s.book.runs.items():
            assert name not in out, name
            out[name] = fn
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for s in _sections() for name, sql in s.book.sql.items()}
