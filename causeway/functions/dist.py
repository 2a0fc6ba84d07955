"""Distribution functions of the normal, t, F and chi-square laws (pure Python, for driver-side p-values), and the normal one as SQL."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 2000):
        an, b = -i * (i - a), b + 2
        d, c = an * d + b, b + an / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * out


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def f_cdf(x: float, df1: float, df2: float) -> float:
    return beta_inc(df1 / 2, df2 / 2, df1 * x / (df1 * x + df2)) if x > 0 else 0.0


def chi2_cdf(x: float, df: float) -> float:
    return gamma_inc(df / 2, x / 2)


def two_sided_t(x: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + x * x)) if df > 0 and math.isfinite(x) else math.nan


def two_sided_normal(x: float) -> float:
    return math.erfc(abs(x) / math.sqrt(2))


#: Hart's rational approximation of the normal tail, from the highest power down (absolute error below 1e-15).
TAIL_ABOVE = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf_sql(z: str) -> str:
    """The normal distribution function of an expression (best a column, as it is named often), in SQL that Spark and DuckDB read."""
    number = lambda v: format(v, ".17e")  # noqa: E731  a double, not a decimal
    x = f"abs({z})"

    def horner(values: tuple[float, ...]) -> str:
        out = number(values[0])
        for v in values[1:]:
            out = f"({out} * {x} + {number(v)})"
        return out

    fraction = f"({x} + 1e0 / ({x} + 2e0 / ({x} + 3e0 / ({x} + 4e0 / ({x} + 6.5e-1)))))"
    tail = f"CASE WHEN {x} > 37e0 THEN 0e0 WHEN {x} < 7.07106781186547e0 THEN exp(-{z} * {z} / 2e0) * {horner(TAIL_ABOVE)} / {horner(TAIL_BELOW)} ELSE exp(-{z} * {z} / 2e0) / {fraction} / 2.506628274631e0 END"
    return f"CASE WHEN {z} > 0e0 THEN 1e0 - ({tail}) ELSE ({tail}) END"
