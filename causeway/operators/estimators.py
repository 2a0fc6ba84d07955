"""Effect estimators. Data-sized work is aggregates; the algebra is on moment matrices."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.moments import Fit, Moments, as_double, complete, moments, regress, scaled_inverse
from causeway.operators.results import estimate

CLIP = 1e-3


def clean(columns, *without: str | None) -> list[str]:
    """Column names once each, without those given and without None."""
    return [c for c in dict.fromkeys(columns or ()) if c and c not in without]


def binary(df: DataFrame, treatment: str) -> DataFrame:
    """df, if the treatment is 0 or 1 in all rows; an error else."""
    row = df.agg(F.min(as_double(treatment)).alias("a"), F.max(as_double(treatment)).alias("b"), F.count_distinct(as_double(treatment)).alias("k")).first()
    if row["k"] != 2 or (row["a"], row["b"]) != (0.0, 1.0):
        raise ValueError(f"{treatment} must take the values 0 and 1")
    return df


def ols(df: DataFrame, treatment: str, outcome: str, adjust=(), method: str = "OLS") -> DataFrame:
    """Least squares of the outcome on treatment and adjustment set, classical standard error."""
    terms = [treatment, *clean(adjust, treatment, outcome)]
    fit = regress(moments(df, [outcome, *terms]), outcome, terms)
    return estimate(df.sparkSession, method, "ATE", treatment, fit.of(treatment), fit.se(treatment), fit.n)


def rct(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    return ols(df, treatment, outcome, (), "RCT")


def two_stage(m, outcome: str, treatment: str, instruments: list[str], exogenous: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Coefficients of [treatment, *exogenous], inverse of the fitted regressors' cross products, first-stage terms and coefficients."""
    first = [*exogenous, *instruments]
    inv, _ = scaled_inverse(m.part(first, first))
    regressors = [treatment, *exogenous]
    pi = inv @ m.part(first, regressors)
    bread, _ = scaled_inverse(pi.T @ m.part(first, first) @ pi)
    return bread @ (pi.T @ m.part(first, [outcome])[:, 0]), bread, first, pi


def iv_2sls(df: DataFrame, treatment: str, outcome: str, instruments, exogenous=()) -> DataFrame:
    """Two-stage least squares with an intercept; heteroskedasticity-robust standard error without small-sample factor."""
    z, x = clean(instruments, treatment, outcome), clean(exogenous, treatment, outcome, *instruments)
    if not z:
        raise ValueError("an instrument is needed")
    m = moments(df, [outcome, treatment, *x, *z])
    beta, bread, first, pi = two_stage(m, outcome, treatment, z, x)
    mean = dict(zip(m.names, m.means, strict=True))
    centred = {c: F.col(f"`{c}`") - float(mean[c]) for c in m.names}
    residual = centred[outcome] - reduce(lambda a, b: a + b, [centred[c] * float(b) for c, b in zip([treatment, *x], beta, strict=True)])
    fitted = [reduce(lambda a, b: a + b, [centred[c] * float(pi[i, k]) for i, c in enumerate(first)]) for k in range(len(beta))]
    rows = complete(df, list(m.names)).select(residual.alias("e"), *[f.alias(f"f{k}") for k, f in enumerate(fitted)])
    pairs = [(i, j) for i in range(len(beta)) for j in range(i, len(beta))]
    row = rows.agg(*[F.sum(F.col("e") * F.col("e") * F.col(f"f{i}") * F.col(f"f{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((len(beta), len(beta)))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = row[f"m{i}_{j}"] or 0.0
    var = bread @ meat @ bread
    return estimate(df.sparkSession, "IV", "LATE", treatment, float(beta[0]), math.sqrt(max(0.0, var[0, 0])), m.n)


def iv_wald(df: DataFrame, treatment: str, outcome: str, instrument: str) -> DataFrame:
    """Ratio of covariances for one instrument."""
    m = moments(df, [outcome, treatment, instrument])
    below = float(m.part([instrument], [treatment])[0, 0])
    return estimate(df.sparkSession, "IV", "LATE", treatment, float(m.part([instrument], [outcome])[0, 0]) / below if below else math.nan, None, m.n)


def did_fit(df: DataFrame, treatment: str, outcome: str, group: str, time: str, covariates=()) -> tuple[Fit, int, float]:
    """(fit of demeaned data, degrees of freedom, standard error): unit effects are swept out by group means, periods are dummies.

    Exact for unbalanced panels; the number of periods must be small, as each is a column."""
    x = clean(covariates, treatment, outcome, group, time)
    rows = complete(df.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{time}`").isNotNull()), [outcome, treatment, *x], f"`{group}`", f"`{time}`")
    periods = [r[0] for r in rows.select(F.col(f"`{time}`")).distinct().orderBy(F.col(f"`{time}`")).limit(1001).collect()]
    if len(periods) > 1000:
        raise ValueError("more than 1000 periods")
    dummies = [f"__p{k}" for k in range(1, len(periods))]
    wide = rows.select("*", *[(F.col(f"`{time}`") == F.lit(p)).cast("double").alias(d) for p, d in zip(periods[1:], dummies, strict=True)])
    columns = [outcome, treatment, *x, *dummies]
    # means of each group by aggregation and join, so that a group of any size is never one task's partition
    means = wide.groupBy(F.col(f"`{group}`").alias("__g")).agg(*[F.avg(F.col(f"`{c}`")).alias(f"__m{i}") for i, c in enumerate(columns)])
    demeaned = wide.join(means, F.col(f"`{group}`") == F.col("__g")).select([(F.col(f"`{c}`") - F.col(f"__m{i}")).alias(c) for i, c in enumerate(columns)])
    m = moments(demeaned, columns)
    fit = regress(m, outcome, columns[1:])
    df_left = m.n - means.count() - fit.rank
    i = fit.terms.index(treatment)
    se = math.sqrt(max(0.0, fit.rss / df_left * fit.inverse[i, i])) if df_left > 0 else math.nan
    return fit, df_left, se


def did(df: DataFrame, treatment: str, outcome: str, group: str, time: str, covariates=()) -> DataFrame:
    """Two-way fixed effects; classical standard error, effects counted in the degrees of freedom."""
    fit, _, se = did_fit(df, treatment, outcome, group, time, covariates)
    return estimate(df.sparkSession, "DiD", "ATT", treatment, fit.of(treatment), se, fit.n)


def did_2x2(df: DataFrame, treated: Column, after: Column, outcome: str) -> DataFrame:
    """Difference of the four cell means."""
    y = as_double(outcome)
    cell = lambda a, b: F.avg(F.when((treated == a) & (after == b), y))
    row = df.agg(((cell(True, True) - cell(True, False)) - (cell(False, True) - cell(False, False))).alias("d"), F.count(y).alias("n")).first()
    return estimate(df.sparkSession, "DiD", "ATT", "treated:after", row["d"] if row["d"] is not None else math.nan, None, row["n"])


def rdd_fit(df: DataFrame, running: str, outcome: str, cutoff: float, covariates=(), bandwidth: float | None = None, kernel: str = "uniform", order: int = 1) -> Fit:
    x = as_double(running) - F.lit(float(cutoff))
    names = clean(covariates, running, outcome)
    weight = F.greatest(F.lit(0.0), 1 - F.abs(x) / F.lit(float(bandwidth or 1.0))) if kernel == "triangular" else F.lit(1.0)
    rows = df if bandwidth is None else df.where(F.abs(x) <= bandwidth)
    above = (x >= 0).cast("double")
    powers = [F.pow(x, F.lit(float(p))).alias(f"__x{p}") for p in range(1, order + 1)]
    crossed = [(above * F.pow(x, F.lit(float(p)))).alias(f"__dx{p}") for p in range(1, order + 1)]
    wide = rows.select(as_double(outcome).alias("__y"), above.alias("__d"), *powers, *crossed, *[as_double(c).alias(c) for c in names], weight.alias("__w"))
    terms = ["__d", *[f"__x{p}" for p in range(1, order + 1)], *[f"__dx{p}" for p in range(1, order + 1)], *names]
    return regress(moments(wide.where("__w > 0"), ["__y", *terms], "__w"), "__y", terms)


def rdd(df: DataFrame, running: str, outcome: str, cutoff: float, covariates=(), bandwidth: float | None = None, kernel: str = "uniform", order: int = 1) -> DataFrame:
    """Jump of the outcome where the running variable passes the cutoff, by (weighted) polynomials on both sides."""
    if kernel not in ("uniform", "triangular") or (kernel == "triangular" and not bandwidth):
        raise ValueError("a triangular kernel needs a bandwidth; other kernels are not known")
    fit = rdd_fit(df, running, outcome, cutoff, covariates, bandwidth, kernel, order)
    return estimate(df.sparkSession, "RDD", "LATE", "above", fit.of("__d"), fit.se("__d"), fit.n)


def strata_propensity(df: DataFrame, treatment: str, strata: list[str]) -> DataFrame:
    """df with the treated share of each stratum, clipped."""
    keys = [F.col(f"`{s}`").alias(f"__s{i}") for i, s in enumerate(strata)]
    shares = df.groupBy(*keys).agg(F.avg(as_double(treatment)).alias("__p"))
    on = reduce(lambda a, b: a & b, [F.col(f"`{s}`").eqNullSafe(F.col(f"__s{i}")) for i, s in enumerate(strata)])
    joined = df.join(shares, on)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("__p"))).alias("__p"))


def logistic_propensity(df: DataFrame, treatment: str, covariates: list[str], reg: float = 0.0, elastic: float = 0.0, folds: int = 0, seed: int = 42) -> DataFrame:
    """df with logistic propensities, clipped; with folds, an elastic net chosen by cross-validation."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = df.select("*", as_double(treatment).alias("__t"), *[as_double(c).alias(f"__c{i}") for i, c in enumerate(covariates)])
    rows = rows.dropna(subset=["__t", *[f"__c{i}" for i in range(len(covariates))]])
    data = VectorAssembler(inputCols=[f"__c{i}" for i in range(len(covariates))], outputCol="__raw").transform(rows)
    data = StandardScaler(inputCol="__raw", outputCol="__f", withMean=True).fit(data).transform(data)
    model = LogisticRegression(featuresCol="__f", labelCol="__t", probabilityCol="__prob", rawPredictionCol="__margin", predictionCol="__hat", regParam=reg, elasticNetParam=elastic)
    if folds:
        grid = ParamGridBuilder().addGrid(model.regParam, [0.001, 0.01, 0.1]).addGrid(model.elasticNetParam, [0.0, 0.5, 1.0]).build()
        judge = BinaryClassificationEvaluator(labelCol="__t", rawPredictionCol="__margin")
        model = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed)
    p = vector_to_array("__prob")[1]
    scored = model.fit(data).transform(data)
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p)).alias("__p"))


def ipw(scored: DataFrame, treatment: str, outcome: str, method: str = "Propensity Score") -> DataFrame:
    """ATE, ATT and the plain mean of (T - p) Y / p, with standard errors, from rows with propensities __p."""
    t, y, p = as_double(treatment), as_double(outcome), F.col("__p")
    rows = scored.select(t.alias("t"), y.alias("y"), p.alias("p")).dropna()
    t, y = F.col("t"), F.col("y")
    ate = t * y / F.col("p") - (1 - t) * y / (1 - F.col("p"))
    ref = (t - F.col("p")) * y / F.col("p")
    att = (t - (1 - t) * F.col("p") / (1 - F.col("p"))) * y
    row = rows.agg(
        F.count("*").alias("n"), F.avg(ate).alias("ate"), F.stddev_samp(ate).alias("ate_sd"), F.avg(ref).alias("ref"), F.stddev_samp(ref).alias("ref_sd"), F.sum(att).alias("att"), F.sum(t).alias("nt"), F.avg(t).alias("share"), F.avg(att * att).alias("att2"), F.avg(att * t).alias("attt"),
    ).first()
    n = row["n"]
    theta = row["att"] / row["nt"] if row["nt"] else math.nan
    att_var = (row["att2"] - 2 * theta * row["attt"] + theta * theta * row["share"]) / row["share"] ** 2 / n if row["nt"] else math.nan
    parts = [("ATE", row["ate"], row["ate_sd"] / math.sqrt(n)), ("ATT", theta, math.sqrt(max(0.0, att_var))), ("ATT_ref", row["ref"], row["ref_sd"] / math.sqrt(n))]
    return reduce(DataFrame.unionByName, [estimate(scored.sparkSession, method, k, treatment, v, se, n) for k, v, se in parts])


def ipw_hajek(scored: DataFrame, treatment: str, outcome: str, estimand: str = "ATE") -> DataFrame:
    """Weighted least squares of outcome on treatment with inverse propensity weights."""
    t, p = as_double(treatment), F.col("__p")
    w = t / p + (1 - t) / (1 - p) if estimand == "ATE" else t + (1 - t) * p / (1 - p)
    fit = regress(moments(scored.select(as_double(outcome).alias("y"), t.alias("t"), w.alias("w")), ["y", "t"], "w"), "y", ["t"])
    return estimate(scored.sparkSession, "Propensity Score", f"{estimand}_hajek", treatment, fit.of("t"), fit.se("t"), fit.n)


def fold_count(n: int) -> int:
    return max(2, n if n < 100 else 20 if n < 500 else 10)


def hashed_fold(key: list[str], k: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key], F.lit(seed)), F.lit(k)).cast("int")


def plr(rows: DataFrame, treatment: str, n_method: str = "DML") -> DataFrame:
    """Partialling-out estimate from residuals u (outcome) and v (treatment)."""
    row = rows.agg(F.sum(F.col("u") * F.col("v")).alias("uv"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.count("*").alias("n")).first()
    theta = row["uv"] / row["vv"] if row["vv"] else math.nan
    psi = F.col("v") * (F.col("u") - theta * F.col("v"))
    got = rows.agg(F.avg(psi * psi).alias("a"), F.avg(F.col("v") * F.col("v")).alias("b")).first()
    se = math.sqrt(got["a"] / got["b"] ** 2 / row["n"]) if row["vv"] else math.nan
    return estimate(rows.sparkSession, n_method, "ATE", treatment, theta, se, row["n"])


@dataclass(frozen=True)
class FoldSums:
    """Counts, sums and sums of products by division and fold, of columns less a common shift."""

    names: tuple[str, ...]
    shift: np.ndarray
    n: dict[tuple[int, int], int]
    sums: dict[tuple[int, int], np.ndarray]
    products: dict[tuple[int, int], np.ndarray]

    def folds(self, division: int) -> list[int]:
        return sorted(f for d, f in self.n if d == division)

    def moments(self, division: int, folds: list[int]) -> Moments:
        """Of the rows of some folds together."""
        keys, p = [(division, f) for f in folds], len(self.names)
        n = sum(self.n[k] for k in keys)
        total, products = sum((self.sums[k] for k in keys), np.zeros(p)), sum((self.products[k] for k in keys), np.zeros((p, p)))
        mean = total / n if n else np.zeros(p)
        return Moments(self.names, n, float(n), mean + self.shift, products - n * np.outer(mean, mean))

    def without(self, division: int, fold: int) -> Moments:
        """Of the rows outside one fold: what models for that fold are fitted on."""
        return self.moments(division, [f for f in self.folds(division) if f != fold])


def by_division(rows: DataFrame, folds: list[str]) -> DataFrame:
    """Each row once for every division in which it has a fold, with division and fold."""
    each = F.array(*[F.struct(F.lit(d).alias("division"), F.col(f).cast("int").alias("fold")) for d, f in enumerate(folds)])
    return rows.withColumn("__at", F.explode(each)).select(*[F.col(f"`{c}`") for c in rows.columns if c not in folds], "__at.division", "__at.fold").where("fold is not null")


def fold_sums(rows: DataFrame, columns: list[str], folds: list[str]) -> FoldSums:
    """Two aggregates for any number of folds and divisions: means, by which the columns are shifted, then sums by fold.

    rows are complete; folds are columns of fold numbers, one for each division."""
    x = [F.col(f"`{c}`") for c in columns]
    first = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    shift = np.array([first[f"m{i}"] or 0.0 for i in range(len(x))])
    moved = by_division(rows, folds).select("division", "fold", *[(c - float(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(x, shift, strict=True))])
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(p)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in pairs]
    n, total, products = {}, {}, {}
    for r in moved.groupBy("division", "fold").agg(F.count("*").alias("n"), *sums).collect():  # one row for each fold of each division
        key = r["division"], r["fold"]
        n[key], total[key], products[key] = r["n"], np.array([r[f"s{i}"] for i in range(p)]), np.zeros((p, p))
        for i, j in pairs:
            products[key][i, j] = products[key][j, i] = r[f"c{i}_{j}"]
    return FoldSums(tuple(columns), shift, n, total, products)


def dml_divisions(df: DataFrame, treatment: str, outcome: str, covariates, folds: list[Column]) -> list[tuple[float, float, int]]:
    """(estimate, standard error, rows) of double machine learning with linear nuisances, for each division into folds.

    Three jobs whatever the number of folds and divisions: column means; sums of products by fold, from which the
    models for a fold come as all other folds' sums, and the estimate from each fold's own sums with those models; and the
    residuals' fourth moments for the standard error."""
    x = clean(covariates, treatment, outcome)
    columns, names = [outcome, treatment, *x], [f"__fold{d}" for d in range(len(folds))]
    rows = complete(df.select("*", *[f.cast("int").alias(n) for f, n in zip(folds, names, strict=True)]), columns, *names)
    s = fold_sums(rows, columns, names)
    theta, models = [], []
    for d in range(len(folds)):
        uv = vv = 0.0
        for f in s.folds(d):
            rest, own = s.without(d, f), s.moments(d, [f])
            if not rest.n:
                vv = math.nan  # one fold alone leaves nothing to fit on
                continue
            ly, lt = regress(rest, outcome, x), regress(rest, treatment, x)
            # residuals are linear in the columns, so their products are quadratic forms in the fold's own sums
            bu, bv = np.array([1.0, 0.0, *-ly.coef]), np.array([0.0, 1.0, *-lt.coef])
            au, av = float(bu @ own.means) - ly.intercept, float(bv @ own.means) - lt.intercept
            uv += float(bu @ own.cross @ bv) + own.n * au * av
            vv += float(bv @ own.cross @ bv) + own.n * av * av
            models.append((d, f, float(-ly.intercept), float(-lt.intercept), *map(float, -ly.coef), *map(float, -lt.coef)))
        theta.append(uv / vv if vv > 0 else math.nan)
    if not models:
        return [(math.nan, math.nan, 0)] * len(folds)
    fields = ["division int", "fold int", "u0 double", "v0 double", *[f"u_{i} double" for i in range(len(x))], *[f"v_{i} double" for i in range(len(x))]]
    fitted = df.sparkSession.createDataFrame(models, ", ".join(fields))  # one row for each fold of each division
    joined = by_division(rows, names).join(F.broadcast(fitted), ["division", "fold"])
    residual = lambda y, k: reduce(lambda a, i: a + F.col(f"`{x[i]}`") * F.col(f"{k}_{i}"), range(len(x)), F.col(f"`{y}`") + F.col(f"{k}0"))
    th = F.get(F.array(*[F.lit(float(t)) for t in theta]), F.col("division"))
    both = joined.select("division", residual(outcome, "u").alias("u"), residual(treatment, "v").alias("v"), th.alias("theta"))
    psi = F.col("v") * (F.col("u") - F.col("theta") * F.col("v"))
    got = {r["division"]: r for r in both.groupBy("division").agg(F.avg(psi * psi).alias("a"), F.avg(F.col("v") * F.col("v")).alias("b"), F.count("*").alias("n")).collect()}  # one row for each division
    se = lambda r: math.sqrt(r["a"] / r["b"] ** 2 / r["n"]) if r["b"] else math.nan
    return [(t, se(got[d]), got[d]["n"]) if d in got and math.isfinite(t) else (math.nan, math.nan, 0) for d, t in enumerate(theta)]


def dml_linear(df: DataFrame, treatment: str, outcome: str, covariates, fold: Column, k: int | None = None) -> DataFrame:
    """Double machine learning with linear nuisances, each fitted outside the fold that it predicts. Rows whose fold is not in 0 to k - 1 are left out."""
    fold = fold if k is None else F.when(fold.between(0, k - 1), fold)
    value, se, n = dml_divisions(df, treatment, outcome, covariates, [fold])[0]
    return estimate(df.sparkSession, "DML", "ATE", treatment, value, se, n)


def dml_forest(df: DataFrame, treatment: str, outcome: str, covariates, key: list[str], k: int, trees: int = 100, seed: int = 42) -> DataFrame:
    """Double machine learning with a random forest for the outcome and a logistic model for a binary treatment.

    Forests see covariates by their bins, so one pass over the rows gives the sums of all trees' bootstraps by fold and
    cell of bins, and the forest of a fold grows from the other folds' sums (forests.py). With more cells than such a
    table may have, the forests are MLlib's, each fitted on the rows, with a time of rows x trees x folds."""
    from pyspark.ml.feature import VectorAssembler

    from causeway.operators import forests

    x = clean(covariates, treatment, outcome)
    rows = complete(df.withColumn("__fold", hashed_fold(key, k, seed)), [outcome, treatment, *x], "__fold", *[F.col(f"`{c}`").alias(f"__key{i}") for i, c in enumerate(key)])
    keys = [f"__key{i}" for i in range(len(key))]
    # a small table can be one file with one task; equal rows are the only ones that this deals to one
    rows = rows.withColumn("__hash", F.xxhash64(*keys, *[F.col(f"`{c}`") for c in (outcome, treatment, *x)], F.lit(seed))).drop(*keys).repartition("__hash")
    data = VectorAssembler(inputCols=x, outputCol="__f").transform(rows).persist()
    try:
        cuts = forests.thresholds(data, x)
        if k * forests.cell_count(cuts) > forests.CELLS:
            return plr(_forest_residuals(data, treatment, outcome, k, trees, seed), treatment)
        cells = data.withColumn("__cell", forests.cell(x, cuts))
        means = forests.fitted(cells, outcome, cuts, k, trees, seed)
        joined = cells.join(F.broadcast(means), ["__fold", "__cell"]).join(F.broadcast(_logistic_by_fold(data, treatment, k)), "__fold")  # at most CELLS rows; k rows
        margin = reduce(lambda a, i: a + F.col("__b")[i] * F.col(f"`{x[i]}`"), range(len(x)), F.col("__b0"))
        residuals = joined.select((F.col(f"`{outcome}`") - F.col("__l")).alias("u"), (F.col(f"`{treatment}`") - 1 / (1 + F.exp(-margin))).alias("v"))
        return plr(residuals, treatment)
    finally:
        data.unpersist()


def _logistic_by_fold(data: DataFrame, treatment: str, k: int) -> DataFrame:
    """__fold, __b0, __b: of the logistic model that is fitted on the other folds."""
    from pyspark.ml.classification import LogisticRegression

    model, found = LogisticRegression(featuresCol="__f", labelCol=treatment, family="binomial"), []
    for f in range(k):
        got = model.fit(data.where(F.col("__fold") != f))
        found.append((f, float(got.intercept), [float(b) for b in got.coefficients]))
    return data.sparkSession.createDataFrame(found, "__fold int, __b0 double, __b array<double>")


def _forest_residuals(data: DataFrame, treatment: str, outcome: str, k: int, trees: int, seed: int) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    parts = []
    for f in range(k):
        train, test = data.where(F.col("__fold") != f), data.where(F.col("__fold") == f)
        forest = RandomForestRegressor(featuresCol="__f", labelCol=outcome, predictionCol="__l", numTrees=trees, seed=seed).fit(train)
        share = LogisticRegression(featuresCol="__f", labelCol=treatment, probabilityCol="__prob", rawPredictionCol="__r", predictionCol="__h").fit(train)
        scored = share.transform(forest.transform(test))
        parts.append(scored.select((F.col(f"`{outcome}`") - F.col("__l")).alias("u"), (F.col(f"`{treatment}`") - vector_to_array("__prob")[1]).alias("v")))
    return reduce(DataFrame.unionByName, parts)


def aipw_strata(df: DataFrame, treatment: str, outcome: str, strata: list[str], fold: Column, k: int) -> DataFrame:
    """Cross-fitted doubly robust estimate; propensities and outcome means are those of the strata in the other folds."""
    keys = [F.col(f"`{s}`").alias(f"s{i}") for i, s in enumerate(strata)]
    rows = df.select(*keys, as_double(treatment).alias("t"), as_double(outcome).alias("y"), fold.alias("f")).dropna(subset=["t", "y"])
    names = [f"s{i}" for i in range(len(strata))]
    cells = rows.groupBy(*names, "f").agg(F.count("*").alias("n"), F.sum("t").alias("n1"), F.sum(F.col("t") * F.col("y")).alias("y1"), F.sum((1 - F.col("t")) * F.col("y")).alias("y0"))
    whole = Window.partitionBy(*names)  # over strata times folds, not rows
    rest = lambda c: F.sum(c).over(whole) - F.col(c)
    models = cells.select(*[F.col(c).alias(f"k{c}") for c in names], F.col("f").alias("kf"), rest("n").alias("n"), rest("n1").alias("n1"), rest("y1").alias("y1"), rest("y0").alias("y0"))
    models = models.select(
        *[f"k{c}" for c in names], "kf", F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.try_divide("n1", "n"))).alias("p"), F.try_divide("y1", "n1").alias("q1"), F.try_divide("y0", F.col("n") - F.col("n1")).alias("q0")
    )
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k{c}")) for c in names], F.col("f") == F.col("kf"))
    t, y, p, q1, q0 = map(F.col, ("t", "y", "p", "q1", "q0"))
    psi = rows.join(models, on).select((q1 - q0 + t * (y - q1) / p - (1 - t) * (y - q0) / (1 - p)).alias("psi")).dropna()
    row = psi.agg(F.avg("psi").alias("m"), F.stddev_samp("psi").alias("s"), F.count("*").alias("n")).first()
    return estimate(df.sparkSession, "AIPW", "ATE", treatment, row["m"], row["s"] / math.sqrt(row["n"]), row["n"])


def gcomp(df: DataFrame, treatment: str, outcome: str, covariates=(), estimand: str = "ATE", interactions: bool = False) -> DataFrame:
    """Mean difference of an outcome model's predictions with the treatment set to 1 and to 0."""
    x = clean(covariates, treatment, outcome)
    rows = complete(df, [outcome, treatment, *x])
    t = F.col(f"`{treatment}`")
    crossed = [f"__tx{i}" for i in range(len(x))] if interactions else []
    wide = rows.select("*", *[(t * F.col(f"`{c}`")).alias(n) for c, n in zip(x, crossed, strict=bool(crossed))])
    fit = regress(moments(wide, [outcome, treatment, *x, *crossed]), outcome, [treatment, *x, *crossed])

    def at(level: float) -> Column:
        values = {treatment: F.lit(level)} | {c: F.col(f"`{c}`") for c in x} | {n: F.lit(level) * F.col(f"`{c}`") for c, n in zip(x, crossed, strict=bool(crossed))}
        return fit.predict(values)

    over = rows.where(t == 1) if estimand == "ATT" else rows
    row = over.agg(F.avg(at(1.0) - at(0.0)).alias("d"), F.count("*").alias("n")).first()
    return estimate(df.sparkSession, "G Computation", estimand, treatment, row["d"] if row["d"] is not None else math.nan, None, row["n"])


def frontdoor_linear(df: DataFrame, treatment: str, outcome: str, mediators, covariates=()) -> DataFrame:
    """Sum over mediators of (effect on the mediator) times (effect of the mediator given treatment), delta-method error."""
    ms = clean(mediators, treatment, outcome)
    x = clean(covariates, treatment, outcome, *ms)
    m = moments(df, [outcome, treatment, *ms, *x])
    second = regress(m, outcome, [treatment, *ms, *x])
    effect = var = 0.0
    for name in ms:
        first = regress(m, name, [treatment, *x])
        a, b = first.of(treatment), second.of(name)
        effect, var = effect + a * b, var + a * a * second.se(name) ** 2 + b * b * first.se(treatment) ** 2
    return estimate(df.sparkSession, "Frontdoor Adjustment", "ATE", treatment, effect, math.sqrt(var), m.n)


def frontdoor_plugin(df: DataFrame, treatment: str, outcome: str, mediator: str) -> DataFrame:
    """Sum over m of (P(m|1) - P(m|0)) times the sum over t of E[Y|t,m] P(t), for discrete treatment and mediator.

    Over the mediator's cells with both treatments, whose number must not grow with the table."""
    rows = df.select(as_double(treatment).alias("t"), F.col(f"`{mediator}`").alias("m"), as_double(outcome).alias("y")).dropna()
    cells = rows.groupBy("m").agg(*[F.sum((F.col("t") == v).cast("double")).alias(f"n{v}") for v in (0, 1)], *[F.avg(F.when(F.col("t") == v, F.col("y"))).alias(f"y{v}") for v in (0, 1)])
    total = rows.agg(F.count("*").alias("n"), F.sum("t").alias("n1")).first()
    n1 = total["n1"] or 0
    n0 = total["n"] - n1
    if not n1 or not n0:
        return estimate(df.sparkSession, "Frontdoor Adjustment", "ATE_plugin", treatment, math.nan, None, total["n"])
    share = n1 / total["n"]
    value = (F.col("n1") / n1 - F.col("n0") / n0) * (F.coalesce("y1", "y0") * share + F.coalesce("y0", "y1") * (1 - share))
    got = cells.agg(F.sum(value).alias("d")).first()["d"]
    return estimate(df.sparkSession, "Frontdoor Adjustment", "ATE_plugin", treatment, got, None, total["n"])
