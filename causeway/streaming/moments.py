"""Moments of a stream: an extension, since sums of products can be updated row by row.

The stream's state is one row of sums for each group; a batch's rows are pre-aggregated before they reach it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from causeway.operators.moments import Moments, complete


def running_sums(stream: DataFrame, columns: list[str]) -> DataFrame:
    """n, sums and sums of products of the complete rows; write it in complete output mode."""
    x = [F.col(f"`{c}`") for c in columns]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return complete(stream, columns).groupBy().agg(F.count("*").alias("n"), *sums, *products)


def moments_of(row: Row, columns: list[str]) -> Moments:
    """Moments from a row of running sums. Columns should be near their means, as sums of squares lose digits."""
    p, n = len(columns), row["n"]
    means = np.array([(row[f"s{i}"] or 0.0) / n if n else 0.0 for i in range(p)])
    cross = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cross[i, j] = cross[j, i] = (row[f"p{i}_{j}"] or 0.0) - n * means[i] * means[j]
    return Moments(tuple(columns), n, float(n), means, cross)
