"""Named queries over a data directory, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sekvant.plans import core, survey, survey_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core.QUERIES | survey.QUERIES


def oracles() -> dict[str, str]:
    return core.ORACLES | survey_sql.ORACLES
