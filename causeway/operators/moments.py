"""Second moments of columns: the one aggregate that the linear operators share.

Spark computes counts, means and centred cross products in partial and final aggregates; what follows on the driver
is algebra on a matrix as wide as the columns. Rows with a null (or NaN) in any of the columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.dist import two_sided_t

CODEGEN_PAIRS = 91  # sums in one aggregate; wider ones are left to batches


def as_double(name: str) -> Column:
    """The column as double, NaN as null; booleans are 0 and 1."""
    # nanvl names its argument once: nullif names it twice, which doubles an expression each time that it goes through here
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))


def complete(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns as doubles where none is null; the columns of more as they are."""
    out = df.select(*[as_double(c).alias(c) for c in columns], *more)
    return out.dropna(subset=columns) if columns else out


@dataclass(frozen=True)
class Moments:
    names: tuple[str, ...]
    n: int
    weight: float  # sum of weights; n without weights
    means: np.ndarray
    cross: np.ndarray  # centred sums of products

    def at(self, columns: list[str]) -> list[int]:
        return [self.names.index(c) for c in columns]

    def part(self, rows: list[str], columns: list[str]) -> np.ndarray:
        return self.cross[np.ix_(self.at(rows), self.at(columns))]

    def mean(self, columns: list[str]) -> np.ndarray:
        return self.means[self.at(columns)]

    def correlation(self) -> np.ndarray:
        """NaN where a column is constant."""
        sd = np.sqrt(np.diag(self.cross))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = self.cross / np.outer(sd, sd)
        r[~np.isfinite(r)] = np.nan
        return np.clip(r, -1, 1)

    def covariance(self) -> np.ndarray:
        return self.cross / max(1, self.n - 1)


def moments(df: DataFrame, columns: list[str], weight: str | None = None) -> Moments:
    """Two aggregates over the complete rows: counts and means, then centred cross products."""
    columns = list(dict.fromkeys(columns))
    rows = complete(df, [*columns, *([weight] if weight and weight not in columns else [])])
    w = F.col(f"`{weight}`") if weight else F.lit(1.0)
    x = [F.col(f"`{c}`") for c in columns]
    first = rows.agg(F.count("*").alias("n"), F.sum(w).alias("w"), *[F.sum(w * c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    n, total = first["n"], first["w"] or 0.0
    p = len(columns)
    means = np.array([(first[f"s{i}"] or 0.0) / total if total else 0.0 for i in range(p)])
    cross = np.zeros((p, p))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    if n:
        for at in range(0, len(pairs), CODEGEN_PAIRS * 8):
            some = pairs[at : at + CODEGEN_PAIRS * 8]
            row = rows.agg(*[F.sum(w * (x[i] - float(means[i])) * (x[j] - float(means[j]))).alias(f"c{i}_{j}") for i, j in some]).first()
            for i, j in some:
                cross[i, j] = cross[j, i] = row[f"c{i}_{j}"]
    return Moments(tuple(columns), int(n), float(total), means, cross)


@dataclass(frozen=True)
class Fit:
    """Least squares with an intercept."""

    terms: tuple[str, ...]
    coef: np.ndarray
    intercept: float
    rss: float
    df: int
    inverse: np.ndarray  # of the centred cross products of the terms
    n: int
    rank: int

    @property
    def sigma2(self) -> float:
        return self.rss / self.df if self.df > 0 else math.nan

    def se(self, term: str) -> float:
        i = self.terms.index(term)
        return math.sqrt(max(0.0, self.sigma2 * self.inverse[i, i])) if self.df > 0 else math.nan

    def of(self, term: str) -> float:
        """NaN where there are no rows to tell."""
        return float(self.coef[self.terms.index(term)]) if self.n else math.nan

    def p_value(self, term: str) -> float:
        se = self.se(term)
        return two_sided_t(self.of(term) / se, self.df) if se > 0 else math.nan

    def predict(self, values: dict[str, Column]) -> Column:
        out = F.lit(float(self.intercept))
        for t, b in zip(self.terms, self.coef, strict=True):
            out = out + F.lit(float(b)) * values[t]
        return out

    def predicted(self) -> Column:
        return self.predict({t: F.col(f"`{t}`") for t in self.terms})


def scaled_inverse(a: np.ndarray) -> tuple[np.ndarray, int]:
    """Pseudo-inverse after scaling to a unit diagonal, and the rank; collinear columns share their effect."""
    if not len(a):
        return a.copy(), 0
    d = np.sqrt(np.maximum(np.diag(a), 0))
    s = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0)
    scaled = a * np.outer(s, s)
    return np.linalg.pinv(scaled, rcond=1e-11, hermitian=True) * np.outer(s, s), int(np.linalg.matrix_rank(scaled, tol=1e-11 * len(a), hermitian=True))


def regress(m: Moments, y: str, terms: list[str]) -> Fit:
    """y on an intercept and terms. Repeated terms and y itself among them are taken out."""
    terms = [t for t in dict.fromkeys(terms) if t != y]
    inverse, rank = scaled_inverse(m.part(terms, terms))
    xy = m.part(terms, [y])[:, 0] if terms else np.zeros(0)
    coef = inverse @ xy
    yy = float(m.part([y], [y])[0, 0])
    rss = max(0.0, yy - float(coef @ xy)) if terms else yy
    intercept = float(m.mean([y])[0] - (coef @ m.mean(terms) if terms else 0.0))
    return Fit(tuple(terms), coef, intercept, rss, m.n - rank - 1, inverse, m.n, rank)


def partial_correlation(m: Moments, a: str, b: str, given: list[str]) -> float:
    """Correlation of a and b given the others; 0 where either has nothing left."""
    s = [a, b, *given]
    inv, _ = scaled_inverse(m.part(s, s))
    d = inv[0, 0] * inv[1, 1]
    return float(np.clip(-inv[0, 1] / math.sqrt(d), -1, 1)) if d > 0 else 0.0
