"""Which family the columns' distributions belong to: normal, exponential or Laplace, or discrete."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.dist import normal_cdf, normal_cdf_sql
from causeway.operators.moments import as_double
from causeway.operators.ranks import order_statistics, value_totals
from causeway.sources.tables import numeric_columns

SAMPLE, BINS, DRAWS = 100, 100, 500
SIMULATED = 1000  # most values of a simulated sample
LEAST_TAIL = 1e-12
FAMILIES = ("norm", "expon", "laplace")


def sample(df: DataFrame, key: list[str] | None = None, n: int = SAMPLE) -> DataFrame:
    """At most n rows, those of the smallest hashes of the key (or of the whole row)."""
    return df.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in (key or df.columns)])).limit(n)


@dataclass(frozen=True)
class Shape:
    """What the families' best parameters are made of, over all rows of a column."""

    n: int
    low: float
    high: float
    mean: float
    sd: float  # of the population
    median: float
    deviation: float  # mean absolute, from the median

    def parameters(self) -> dict[str, tuple[float, float]]:
        return {"norm": (self.mean, self.sd), "expon": (self.low, self.mean - self.low), "laplace": (self.median, self.deviation)}


def shape(df: DataFrame, column: str) -> Shape | None:
    """None for a column without numbers. The median is exact, found by refining histograms."""
    x = as_double(column)
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if not row["n"]:
        return None
    (median,) = order_statistics(df, column, shares=[0.5])
    deviation = df.agg(F.avg(F.abs(x - F.lit(median))).alias("d")).first()["d"]
    return Shape(row["n"], row["lo"], row["hi"], row["m"], row["s"], median, deviation)


def mle(df: DataFrame, column: str) -> DataFrame:
    """loc and scale of each family by maximum likelihood, over all rows; no rows for a column without numbers."""
    found = shape(df, column)
    rows = [(column, f, float(a), float(b)) for f, (a, b) in found.parameters().items()] if found else []
    return df.sparkSession.createDataFrame(rows, "column string, family string, loc double, scale double")


def table_errors(df: DataFrame, column: str, found: Shape | None = None) -> dict[str, float]:
    """squared_errors over all rows: the histogram's counts are one aggregate, and only they reach the driver."""
    found = found or shape(df, column)
    if not found or found.low == found.high:
        return {}
    x, width = as_double(column), (found.high - found.low) / BINS
    at = F.least(F.lit(BINS - 1), F.floor((x - found.low) / (found.high - found.low) * BINS)).cast("int")
    counts = {r["bin"]: r["n"] for r in df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).collect()}  # BINS rows
    heights = np.array([counts.get(i, 0) / (found.n * width) for i in range(BINS)])
    mid = found.low + (np.arange(BINS) + 0.5) * width
    return {f: float(((density(f, mid, *p) - heights) ** 2).sum()) for f, p in found.parameters().items()}


def cdf_sql(family: str) -> str:
    """The distribution function of a standardised value z."""
    if family == "norm":
        return normal_cdf_sql("z")
    return "CASE WHEN z > 0e0 THEN 1e0 - exp(-z) ELSE 0e0 END" if family == "expon" else "CASE WHEN z < 0e0 THEN 5e-1 * exp(z) ELSE 1e0 - 5e-1 * exp(-z) END"


def table_anderson_darling(df: DataFrame, column: str, found: Shape | None = None) -> dict[str, float]:
    """The Anderson-Darling statistic of each family over all rows.

    A value that m rows share, with r rows below, holds the ranks r + 1 to r + m, so a table of values with both numbers is
    all that the sum over ranks needs; ranks come from ranges of values and the ranges' totals."""
    found = found or shape(df, column)
    if not found or found.low == found.high:
        return {}
    at = found.parameters() | {"norm": (found.mean, found.sd * math.sqrt(found.n / max(1, found.n - 1)))}
    totals = value_totals(df, column)
    n, m, r, total = F.lit(float(found.n)), F.col("n").cast("double"), F.col("below").cast("double"), []
    for f, (loc, scale) in at.items():
        totals = totals.withColumn("z", (F.col("value") - loc) / max(scale, 1e-300)).withColumn(f, F.greatest(F.lit(LEAST_TAIL), F.least(F.lit(1 - LEAST_TAIL), F.expr(cdf_sql(f)))))
        total.append(F.sum(m * (2 * r + m) * F.ln(f) + m * (2 * n - 2 * r - m) * F.log1p(-F.col(f))).alias(f"__{f}"))
    row = totals.agg(*total).first()
    return {f: -found.n - row[f"__{f}"] / found.n for f in at}


def fitted(x: np.ndarray) -> dict[str, tuple[float, float]]:
    med = float(np.median(x))
    return {"norm": (float(x.mean()), float(x.std())), "expon": (float(x.min()), float(x.mean() - x.min())), "laplace": (med, float(np.abs(x - med).mean()))}


def density(family: str, x: np.ndarray, loc: float, scale: float) -> np.ndarray:
    z = (x - loc) / max(scale, 1e-300)
    if family == "norm":
        return np.exp(-z * z / 2) / (max(scale, 1e-300) * math.sqrt(2 * math.pi))
    return np.where(z >= 0, np.exp(-np.abs(z)), 0) / max(scale, 1e-300) if family == "expon" else np.exp(-np.abs(z)) / (2 * max(scale, 1e-300))


def cdf(family: str, x: np.ndarray, loc: float, scale: float) -> np.ndarray:
    z = (x - loc) / max(scale, 1e-300)
    if family == "norm":
        return np.array([normal_cdf(float(v)) for v in z])
    return np.where(z > 0, 1 - np.exp(-np.maximum(z, 0)), 0) if family == "expon" else np.where(z < 0, 0.5 * np.exp(-np.abs(z)), 1 - 0.5 * np.exp(-np.abs(z)))


def squared_errors(x: np.ndarray) -> dict[str, float]:
    """Of each family's density against a histogram's."""
    heights, ends = np.histogram(x, BINS, density=True)
    mid = (ends[1:] + ends[:-1]) / 2
    return {f: float(((density(f, mid, *p) - heights) ** 2).sum()) for f, p in fitted(x).items()}


def anderson_darling(u: np.ndarray) -> float:
    """The statistic of values of a distribution function."""
    u, n = np.clip(np.sort(u), LEAST_TAIL, 1 - LEAST_TAIL), len(u)
    i = np.arange(1, n + 1)
    return float(-n - ((2 * i - 1) * (np.log(u) + np.log1p(-u[::-1]))).mean())


def normal_ad_p(a2: float, n: int) -> float:
    """p-value where mean and variance are estimated (published approximation)."""
    a = a2 * (1 + 0.75 / n + 2.25 / n**2)
    if a > 10:
        return 0.0
    if a > 0.6:
        return math.exp(1.2937 - 5.709 * a + 0.0186 * a * a)
    if a > 0.34:
        return math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    return 1 - math.exp((-8.318 + 42.796 * a - 59.938 * a * a) if a > 0.2 else (-13.436 + 101.14 * a - 223.73 * a * a))


def simulated_p(family: str, statistic: float, n: int, seed: int = 0) -> float:
    """Share of samples of the family whose statistic, with fitted parameters, is as large.

    Samples have n values, SIMULATED at most: the statistic's law is the same beyond, to far less than the error of DRAWS draws."""
    rng, n = np.random.default_rng(seed), min(n, SIMULATED)
    draws = rng.exponential(size=(DRAWS, n)) if family == "expon" else rng.laplace(size=(DRAWS, n))
    return float(np.mean([anderson_darling(cdf(family, d, *fitted(d)[family])) >= statistic for d in draws]))


def goodness(family: str, x: np.ndarray, seed: int = 0) -> tuple[float, float]:
    """(statistic, p): the normal's by formula, the others' by simulation."""
    if family == "norm":
        s = float(x.std(ddof=1)) or 1e-300
        stat = anderson_darling(np.array([normal_cdf(float(v)) for v in (x - x.mean()) / s]))
        return stat, normal_ad_p(stat, len(x))
    stat = anderson_darling(cdf(family, x, *fitted(x)[family]))
    return stat, simulated_p(family, stat, len(x), seed)


def table_goodness(df: DataFrame, column: str, family: str, found: Shape | None = None) -> tuple[float, float]:
    """goodness over all rows."""
    found = found or shape(df, column)
    stat = table_anderson_darling(df, column, found)[family]
    return stat, normal_ad_p(stat, found.n) if family == "norm" else simulated_p(family, stat, found.n)


@dataclass(frozen=True)
class Family:
    family: str | None  # None if not trusted
    majority: str | None
    share: float
    trusted: bool
    per_column: dict[str, tuple[str, float]]


def detect_family(df: DataFrame, key: list[str] | None = None, whole: bool = False) -> Family:
    """The family of most columns, trusted if it has at least 80 % of them and every p exceeds 0.05.

    By a sample of SAMPLE rows, as the decision table of discovery has it, or over all rows."""
    numeric, found = numeric_columns(df), {}
    if whole:
        for c in df.columns:
            about = shape(df, c) if c in numeric else None
            if about is None or about.n < 8 or about.low == about.high:
                found[c] = ("discrete", 1.0)
                continue
            errors = table_errors(df, c, about)
            best = min(FAMILIES, key=errors.__getitem__)
            found[c] = (best, table_goodness(df, c, best, about)[1])
    else:
        rows = sample(df, key).select([as_double(c).alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns]).toPandas()  # SAMPLE rows
        for c in df.columns:
            x = rows[c].dropna().to_numpy(dtype=float) if c in numeric else np.zeros(0)
            if len(x) < 8 or x.std() == 0:
                found[c] = ("discrete", 1.0)
                continue
            best = min(FAMILIES, key=lambda f, e=squared_errors(x): e[f])
            found[c] = (best, goodness(best, x)[1])
    if not found:
        return Family(None, None, 0.0, False, {})
    majority, n = Counter(f for f, _ in found.values()).most_common(1)[0]
    share = n / len(found)
    trusted = share >= 0.8 and all(p > 0.05 for _, p in found.values())
    return Family(majority if trusted else None, majority, share, trusted, found)
