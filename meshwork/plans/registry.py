"""The library's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwork.plans import baselines, clusters, fits, geometry, graphs, inference, levels, outside, panels, relational, resamples, runs, summaries, trace, verdicts  # noqa: F401  they fill the register
from meshwork.plans.base import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
