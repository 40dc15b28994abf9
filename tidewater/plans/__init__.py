"""Registered queries of the time-series engine, by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evidence, features, fitted, forecasts, panels, records, serving, studies, validation

FAMILIES = (features, forecasts, evidence, fitted, panels, records, serving, studies, validation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
