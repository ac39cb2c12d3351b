"""Every registered query of the engine with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfold.plans import analysis, audits, diagnostics, history, models, postings, samples

PARTS = [history, analysis, audits, postings, samples, models, diagnostics]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
