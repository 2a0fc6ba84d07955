"""Independence of columns given others beyond linear dependence: a kernel test by random Fourier features.

Kernels are replaced by cosines of random directions, so what a test over all pairs of rows would need becomes matrices of
features: one pass sums their products, a second the products of their residuals. Both are linear in rows, and what is
shuffled is one short vector for each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.dist import gamma_inc
from causeway.operators.moments import complete

FEATURES, GIVEN_FEATURES = 5, 25
RIDGE = 1e-8


def vector_sums(rows: DataFrame, vector_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a vector that a function gives for a matrix of rows (already summed over them); rows have doubles without nulls."""
    names = rows.columns

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                v = vector_of(np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in names]))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "value"])

    found = rows.mapInArrow(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()  # the vector's length
    return np.array([r["value"] for r in found])


class _Cosines:
    """Random features of some columns, after standardisation."""

    def __init__(self, at: list[int], mean: np.ndarray, sd: np.ndarray, features: int, rng: np.random.Generator):
        self.at, self.mean, self.sd = at, mean[at], np.where(sd[at] > 0, sd[at], 1.0)
        self.w = rng.standard_normal((len(at), features)) / np.sqrt(len(at))  # a kernel as wide as a standardised column's typical distance
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2) * np.cos((x[:, self.at] - self.mean) / self.sd @ self.w + self.b)


def kernel_test(df: DataFrame, a: str, b: str, given=(), features: int = FEATURES, given_features: int = GIVEN_FEATURES, seed: int = 0) -> tuple[float, float, int]:
    """(statistic, p, rows) of the test that a and b are independent given other columns, whatever the dependence's form.

    The features of a and b are regressed on those of the given columns; the statistic is the rows times the squared
    covariances of the residuals. Under independence it is a sum of weighted chi-square variables, whose law is taken as the gamma
    law with the same mean and variance. Features are the same at every run. Rows with a null in any column are left out."""
    columns = [a, b, *given]
    rows = complete(df, columns).toDF(*[f"c{i}" for i in range(len(columns))])
    about = rows.agg(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(rows.columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = about["n"]
    if n <= 2 * features + given_features:
        return 0.0, 1.0, n
    mean, sd = (np.array([about[f"{k}{i}"] for i in range(len(columns))], dtype=float) for k in "ms")
    rng = np.random.default_rng(seed)
    makers = [_Cosines([0], mean, sd, features, rng), _Cosines([1], mean, sd, features, rng)] + ([_Cosines(list(range(2, len(columns))), mean, sd, given_features, rng)] if given else [])
    width = 2 * features + (given_features if given else 0)

    def every(x: np.ndarray) -> np.ndarray:
        return np.column_stack([m(x) for m in makers])

    def products(x: np.ndarray) -> np.ndarray:
        f = every(x)
        return np.concatenate([f.sum(axis=0), (f.T @ f).ravel()])

    got = vector_sums(rows, products)
    centre = got[:width] / n
    cov = got[width:].reshape(width, width) / n - np.outer(centre, centre)
    xy, z = slice(0, 2 * features), slice(2 * features, width)
    coef = np.linalg.solve(cov[z, z] + RIDGE * np.eye(width - 2 * features), cov[z, xy]) if given else np.zeros((0, 2 * features))
    left = cov[xy, xy] - cov[xy, z] @ coef - coef.T @ cov[z, xy] + coef.T @ cov[z, z] @ coef
    statistic = n * float((left[:features, features:] ** 2).sum())

    def fourth(x: np.ndarray) -> np.ndarray:
        f = every(x) - centre
        r = f[:, xy] - f[:, z] @ coef
        pairs = (r[:, :features, None] * r[:, None, features:]).reshape(len(r), -1)
        return (pairs.T @ pairs).ravel()

    spread = vector_sums(rows, fourth).reshape(features**2, features**2) / n
    first, second = float(np.trace(spread)), 2 * float((spread * spread).sum())
    if first <= 0 or second <= 0:
        return statistic, 1.0, n
    return statistic, 1 - gamma_inc(first * first / second, statistic * first / second), n
