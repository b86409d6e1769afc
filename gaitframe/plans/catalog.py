"""All motion queries by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaitframe.plans import motion, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in motion.QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
