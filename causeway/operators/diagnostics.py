"""Tests of identifying assumptions. Each gives rows (test, statistic, df1, df2, p_value, passed, error)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.dist import chi2_cdf, f_cdf
from causeway.operators import ranks
from causeway.operators.estimators import clean, dml_divisions, hashed_fold, rdd_fit, two_stage
from causeway.operators.moments import Moments, as_double, complete, moments, regress
from causeway.operators.results import diagnostic

ALPHA = 0.05


def partial_f(rss0: float, rss1: float, q: int, df: int) -> tuple[float, float]:
    f = (rss0 - rss1) / q / (rss1 / df) if q > 0 and df > 0 and rss1 > 0 else math.nan
    return f, 1 - f_cdf(f, q, df) if math.isfinite(f) else math.nan


def reset(df: DataFrame, outcome: str, covariates) -> DataFrame:
    """Linearity: whether the squared prediction adds to the regression on the covariates."""
    x = clean(covariates, outcome)
    fit = regress(moments(df, [outcome, *x]), outcome, x)
    rows = complete(df, [outcome, *x])
    yhat = fit.predicted()
    wide = rows.select("*", ((yhat - float(fit.intercept)) * (yhat - float(fit.intercept))).alias("__sq"))
    more = regress(moments(wide, [outcome, *x, "__sq"]), outcome, [*x, "__sq"])
    f, p = partial_f(fit.rss, more.rss, 1, more.df)
    return diagnostic(df.sparkSession, "linearity", f, 1, more.df, p, p > ALPHA)


def durbin_wu_hausman(df: DataFrame, treatment: str, outcome: str, exogenous, instruments) -> DataFrame:
    """Exogeneity: whether the first stage's residual matters in the outcome equation."""
    z = clean(instruments, treatment, outcome)
    x = clean(exogenous, treatment, outcome, *z)
    if not z:
        return diagnostic(df.sparkSession, "exogeneity", None, None, None, None, False, "no instruments")
    first = regress(moments(df, [treatment, *x, *z, outcome]), treatment, [*x, *z])
    rows = complete(df, [treatment, *x, *z, outcome])
    wide = rows.select("*", (F.col(f"`{treatment}`") - first.predicted()).alias("__v"))
    second = regress(moments(wide, [outcome, treatment, *x, "__v"]), outcome, [treatment, *x, "__v"])
    t, p = second.of("__v") / second.se("__v"), second.p_value("__v")
    return diagnostic(df.sparkSession, "exogeneity", t, None, second.df, p, p > ALPHA)


def positivity(scored: DataFrame, eps: float = 0.05, share: float = 0.9) -> DataFrame:
    """Share of rows whose propensity __p is inside [eps, 1 - eps]."""
    inside = scored.agg(F.avg(F.col("__p").between(eps, 1 - eps).cast("double")).alias("s")).first()["s"]
    return diagnostic(scored.sparkSession, "positivity", inside, None, None, None, inside is not None and inside > share)


def lead_interactions(df: DataFrame, treatment: str, outcome: str, group: str, order: list[str], leads: int = 4, test: str = "parallel_trends") -> DataFrame:
    """For each lead of the treatment within groups: the t statistic of its interaction with the group.

    Leads come from ranges of (group, order), so a group may hold any share of the rows."""
    names = [f"__l{k}" for k in range(1, leads + 1)]
    columns = list(dict.fromkeys([outcome, group, treatment, *order]))
    rows = ranks.leads(df.select([F.col(f"`{c}`") for c in columns]), group, order, as_double(treatment), names)
    ahead = [F.coalesce(F.col(n), F.lit(0.0)).cast("int").cast("double").alias(n[2:]) for n in names]
    wide = rows.select(as_double(outcome).alias("y"), as_double(group).alias("g"), *ahead)
    wide = wide.select("*", *[(F.col(f"l{k}") * F.col("g")).alias(f"x{k}") for k in range(1, leads + 1)])
    m = moments(wide, ["y", "g", *[f"{a}{k}" for k in range(1, leads + 1) for a in "lx"]])
    rows = []
    for k in range(1, leads + 1):
        fit = regress(m, "y", ["g", f"l{k}", f"x{k}"])
        p = fit.p_value(f"x{k}")
        se = fit.se(f"x{k}")
        rows.append(diagnostic(df.sparkSession, f"{test}_lead{k}", fit.of(f"x{k}") / se if se > 0 else math.nan, None, fit.df, p, p > ALPHA))
    return reduce(DataFrame.unionByName, rows)


def no_anticipation(df: DataFrame, treatment: str, outcome: str, group: str, order: list[str], leads: int = 4) -> DataFrame:
    return lead_interactions(df, treatment, outcome, group, order, leads, "no_anticipation")


def rdd_continuity(df: DataFrame, running: str, outcome: str, cutoff: float, bandwidth: float | None = None) -> DataFrame:
    """The t statistic of the jump; a true effect at the cutoff fails, as the reference test has it."""
    fit = rdd_fit(df, running, outcome, cutoff, (), bandwidth)
    p = fit.p_value("__d")
    return diagnostic(df.sparkSession, "rdd_continuity", fit.of("__d") / fit.se("__d"), None, fit.df, p, p > ALPHA)


def rdd_diagnose(df: DataFrame, running: str, treatment: str, outcome: str, cutoff: float, covariates=(), sharp: float = 0.8) -> DataFrame:
    """Sharpness of assignment, bunching at the cutoff, balance of covariates, and rows near the cutoff."""
    x, t = as_double(running) - float(cutoff), as_double(treatment)
    names = clean(covariates, running, treatment, outcome)
    sd = df.agg(F.stddev_samp(as_double(running)).alias("s")).first()["s"] or 0.0
    side = lambda above, v, f=F.avg: f(F.when((x >= 0) if above else (x < 0), v))
    near = lambda lo, hi: F.sum(((x >= lo) & (x < hi)).cast("long"))
    cols = [side(True, t).alias("t1"), side(False, t).alias("t0"), F.avg((x >= 0).cast("double")).alias("assigned"), F.avg(t).alias("mt"), near(0, 0.02 * sd).alias("b1"), near(-0.02 * sd, 0).alias("b0"), F.sum((F.abs(x) <= 0.25 * sd).cast("long")).alias("near")]
    for i, c in enumerate(names):
        v = as_double(c)
        cols += [side(a, v, f).alias(f"{k}{int(a)}_{i}") for a in (True, False) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    row = df.agg(*cols).first()
    spark = df.sparkSession
    if row["assigned"] is None or row["mt"] is None:
        return diagnostic(spark, "sharpness", None, None, None, None, None, "no rows")
    jump = abs((row["t1"] or 0.0) - (row["t0"] or 0.0))
    most = max(row["b1"] or 0, row["b0"] or 0)
    bunch = abs((row["b1"] or 0) - (row["b0"] or 0)) / most if most else 0.0
    rows = [diagnostic(spark, "sharpness", jump, None, None, None, jump >= sharp), diagnostic(spark, "assigned_minus_treated", abs(row["assigned"] - row["mt"]), None, None, None, None), diagnostic(spark, "bunching", bunch, None, None, None, bunch <= 0.2), diagnostic(spark, "rows_near_cutoff", row["near"], None, None, None, (row["near"] or 0) >= 50)]
    from causeway.functions.dist import two_sided_t

    for i, c in enumerate(names):
        n1, n0 = row[f"n1_{i}"], row[f"n0_{i}"]
        if n1 < 2 or n0 < 2:
            rows.append(diagnostic(spark, f"balance_{c}", None, None, None, None, None, "too few rows on a side"))
            continue
        pooled = ((n1 - 1) * row[f"v1_{i}"] + (n0 - 1) * row[f"v0_{i}"]) / (n1 + n0 - 2)
        s = (row[f"m1_{i}"] - row[f"m0_{i}"]) / math.sqrt(pooled * (1 / n1 + 1 / n0)) if pooled > 0 else math.nan
        p = two_sided_t(s, n1 + n0 - 2)
        rows.append(diagnostic(spark, f"balance_{c}", s, None, n1 + n0 - 2, p, not p < ALPHA))
    return reduce(DataFrame.unionByName, rows)


def rdd_ok(df: DataFrame, running: str, treatment: str, outcome: str, cutoff: float, covariates=()) -> bool:
    return all(r["passed"] is not False and r["error"] != "no rows" for r in rdd_diagnose(df, running, treatment, outcome, cutoff, covariates).collect())


def iv_first_stage(df: DataFrame, treatment: str, exogenous, instruments) -> DataFrame:
    """Partial F of the instruments in the first stage; passed above 10."""
    z = clean(instruments, treatment)
    x = clean(exogenous, treatment, *z)
    m = moments(df, [treatment, *x, *z])
    less, more = regress(m, treatment, x), regress(m, treatment, [*x, *z])
    f, p = partial_f(less.rss, more.rss, len(z), more.df)
    return diagnostic(df.sparkSession, "iv_strength", f, len(z), more.df, p, f > 10)


def sargan(df: DataFrame, treatment: str, outcome: str, exogenous, instruments) -> DataFrame:
    """Over-identification: n R-squared of two-stage residuals on all exogenous columns."""
    z = clean(instruments, treatment, outcome)
    x = clean(exogenous, treatment, outcome, *z)
    if len(z) <= 1:
        return diagnostic(df.sparkSession, "iv_overid", None, None, None, None, True, "not over-identified")
    m = moments(df, [outcome, treatment, *x, *z])
    beta, *_ = two_stage(m, outcome, treatment, z, x)
    mean = dict(zip(m.names, m.means, strict=True))
    rows = complete(df, list(m.names))
    e = (F.col(f"`{outcome}`") - float(mean[outcome])) - reduce(lambda a, b: a + b, [(F.col(f"`{c}`") - float(mean[c])) * float(b) for c, b in zip([treatment, *x], beta, strict=True)])
    mm = moments(rows.select("*", e.alias("__e")), ["__e", *x, *z])
    fit = regress(mm, "__e", [*x, *z])
    total = float(mm.part(["__e"], ["__e"])[0, 0])
    j = mm.n * (1 - fit.rss / total)
    p = 1 - chi2_cdf(j, len(z) - 1)
    return diagnostic(df.sparkSession, "iv_overid", j, len(z) - 1, None, p, p > ALPHA)


def mediation(df: DataFrame, treatment: str, outcome: str, mediators, covariates=()) -> DataFrame:
    """Complete mediation: the treatment's t statistic given the mediators."""
    ms = clean(mediators, treatment, outcome)
    terms = [treatment, *ms, *clean(covariates, treatment, outcome, *ms)]
    fit = regress(moments(df, [outcome, *terms]), outcome, terms)
    p = fit.p_value(treatment)
    return diagnostic(df.sparkSession, "complete_mediation", fit.of(treatment) / fit.se(treatment), None, fit.df, p, p > ALPHA)


def mediator_backdoor(df: DataFrame, mediators, covariates) -> DataFrame:
    """One row for each covariate of each mediator's regression on the covariates."""
    ms = clean(mediators)
    x = clean(covariates, *ms)
    m = moments(df, [*ms, *x])
    rows = []
    for name in ms:
        fit = regress(m, name, x)
        for c in x:
            p, se = fit.p_value(c), fit.se(c)
            rows.append(diagnostic(df.sparkSession, f"mediator_backdoor_{name}_{c}", fit.of(c) / se if se > 0 else math.nan, None, fit.df, p, p > ALPHA))
    if not rows:
        return diagnostic(df.sparkSession, "mediator_backdoor", None, None, None, None, True, "no covariates")
    return reduce(DataFrame.unionByName, rows)


def dml_stability(df: DataFrame, treatment: str, outcome: str, covariates, folds: list[Column], k: int | None = None) -> DataFrame:
    """Standard deviation of estimates over several divisions into folds, all from the same three aggregates."""
    folds = folds if k is None else [F.when(f.between(0, k - 1), f) for f in folds]
    values = [v for v, _, _ in dml_divisions(df, treatment, outcome, covariates, folds)]
    mean = sum(values) / len(values)
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return diagnostic(df.sparkSession, "dml_stability", sd, None, None, None, sd < 0.1 if math.isfinite(sd) else None)


def gcomp_rmse(df: DataFrame, outcome: str, covariates) -> DataFrame:
    """In-sample error of the outcome model against half of the outcome's standard deviation."""
    x = clean(covariates, outcome)
    m = moments(df, [outcome, *x])
    fit = regress(m, outcome, x)
    rmse = math.sqrt(fit.rss / m.n)
    sd = math.sqrt(float(m.part([outcome], [outcome])[0, 0]) / (m.n - 1))
    return diagnostic(df.sparkSession, "gcomp_rmse", rmse, None, None, None, rmse < 0.5 * sd)


def run_all(df: DataFrame, treatment: str, outcome: str, covariates, instruments=(), mediators=(), group: str | None = None, order: list[str] | None = None, running: str | None = None, cutoff: float | None = None, key: list[str] | None = None, strict_reference: bool = False) -> DataFrame:
    """All tests that the roles allow. A test that cannot be made has passed null (false with strict_reference) and the error's text."""
    x = clean(covariates, treatment, outcome, *instruments, *mediators)
    from causeway.operators.estimators import logistic_propensity

    tests: list[tuple[str, Callable[[], DataFrame]]] = [
        ("linearity", lambda: reset(df, outcome, x)),
        ("exogeneity", lambda: durbin_wu_hausman(df, treatment, outcome, x, instruments)),
        ("positivity", lambda: positivity(logistic_propensity(df, treatment, x))),
        ("gcomp_rmse", lambda: gcomp_rmse(df, outcome, x)),
    ]
    if group and order:
        tests += [("parallel_trends", lambda: lead_interactions(df, treatment, outcome, group, order)), ("no_anticipation", lambda: no_anticipation(df, treatment, outcome, group, order))]
    if running and cutoff is not None:
        tests.append(("rdd_continuity", lambda: rdd_continuity(df, running, outcome, cutoff)))
    if instruments:
        tests.append(("iv_strength", lambda: iv_first_stage(df, treatment, x, instruments)))
    if len(clean(instruments)) > 1:
        tests.append(("iv_overid", lambda: sargan(df, treatment, outcome, x, instruments)))
    if mediators:
        tests += [("complete_mediation", lambda: mediation(df, treatment, outcome, mediators, x)), ("mediator_backdoor", lambda: mediator_backdoor(df, mediators, x))]
    if key:
        tests.append(("dml_stability", lambda: dml_stability(df, treatment, outcome, x, [hashed_fold(key, 5, s) for s in range(5)], 5)))
    rows = []
    for name, test in tests:
        try:
            rows.append(test())
        except Exception as e:  # noqa: BLE001  one test's failure is a row of the report
            rows.append(diagnostic(df.sparkSession, name, None, None, None, None, False if strict_reference else None, str(e)[:200]))
    return reduce(DataFrame.unionByName, rows)


__all__ = ["Moments", "dml_stability", "durbin_wu_hausman", "gcomp_rmse", "iv_first_stage", "lead_interactions", "mediation", "mediator_backdoor", "no_anticipation", "positivity", "rdd_continuity", "rdd_diagnose", "rdd_ok", "reset", "run_all", "sargan"]
