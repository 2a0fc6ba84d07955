"""Rows that estimators, tests and graphs come back as."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

ESTIMATE = "method string, estimand string, term string, estimate double, std_error double, n long"
DIAGNOSTIC = "test string, statistic double, df1 double, df2 double, p_value double, passed boolean, error string"
EDGES = "src string, dst string, weight double, latent boolean"
DIGITS = 6


def rounded(x: float | None) -> float | None:
    """Six decimals, never minus zero; None for what is no number."""
    return None if x is None or not math.isfinite(x) else round(float(x), DIGITS) + 0.0


def estimate(spark: SparkSession, method: str, estimand: str, term: str, value: float, se: float | None, n: int) -> DataFrame:
    return spark.createDataFrame([(method, estimand, term, rounded(value), rounded(se), int(n))], ESTIMATE)


def diagnostic(spark: SparkSession, test: str, statistic: float | None, df1: float | None, df2: float | None, p: float | None, passed: bool | None, error: str | None = None) -> DataFrame:
    one = lambda x: None if x is None else rounded(float(x))
    return spark.createDataFrame([(test, one(statistic), one(df1), one(df2), one(p), None if passed is None else bool(passed), error)], DIAGNOSTIC)


def edges(spark: SparkSession, rows: list[tuple[str, str, float | None, bool]]) -> DataFrame:
    return spark.createDataFrame([(a, b, rounded(w), bool(x)) for a, b, w, x in sorted(rows, key=lambda r: r[:2])], EDGES)
