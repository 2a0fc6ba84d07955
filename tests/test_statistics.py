import pandas as pd
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions.dist import chi2_cdf, f_cdf, normal_cdf, t_cdf
from causeway.operators import diagnostics as dg
from causeway.operators import estimators as es
from causeway.operators import likelihood as lk
from causeway.operators import prep
from causeway.operators.moments import moments, regress
from causeway.plans import discovery as ds
from causeway.plans import engine
from causeway.roles import CausalQuery
from causeway.sources.tables import read_csv, write_codebook, write_table


def table(spark, **columns):
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))


def test_distributions():
    assert math.isclose(t_cdf(1.5, 10), 0.91775, abs_tol=1e-5) and math.isclose(f_cdf(3, 2, 50), 0.94118, abs_tol=1e-5)
    assert math.isclose(chi2_cdf(3, 2), 0.77687, abs_tol=1e-5) and math.isclose(normal_cdf(1.959964), 0.975, abs_tol=1e-6)


def test_regression_against_numpy(spark):
    r = np.random.default_rng(1)
    x, z = r.normal(size=300), r.normal(size=300)
    y = 1 + 2 * x - z + r.normal(size=300)
    m = moments(table(spark, x=x, z=z, y=y, k=np.ones(300)), ["x", "z", "y", "k"])
    fit = regress(m, "y", ["x", "z"])
    a = np.column_stack([np.ones(300), x, z])
    b, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
    assert np.allclose([fit.intercept, *fit.coef], b) and math.isclose(fit.rss, rss[0])
    assert math.isclose(fit.se("x"), math.sqrt(rss[0] / 297 * np.linalg.inv(a.T @ a)[1, 1]))
    assert np.isnan(m.correlation()[0, 3])
    assert regress(m, "y", ["x", "k"]).rank == 1  # a constant adds nothing and does not fail
    same = es.iv_2sls(table(spark, x=x, y=y, w=x), "x", "y", ["w"]).first()["estimate"]
    assert math.isclose(same, es.ols(table(spark, x=x, y=y), "x", "y").first()["estimate"], abs_tol=1e-6)


def test_estimators_find_planted_effects(spark):
    r = np.random.default_rng(2)
    n = 1500
    s, u, z, w = r.integers(0, 3, n), r.normal(size=n), r.integers(0, 2, n), r.normal(size=n)
    t = (r.random(n) < 0.25 + 0.2 * s).astype(float)
    y = 2 * t + 1.5 * s + 0.1 * r.normal(size=n)
    df = table(spark, t=t, s=s, y=y, f=np.arange(n) % 5)
    for got in (es.ols(df, "t", "y", ["s"]), es.gcomp(df, "t", "y", ["s"], "ATT", True), es.ipw_hajek(es.strata_propensity(df, "t", ["s"]), "t", "y"), es.dml_linear(df, "t", "y", ["s"], F.col("f").cast("int"), 5), es.aipw_strata(df, "t", "y", ["s"], F.col("f").cast("int"), 5)):
        assert abs(got.first()["estimate"] - 2) < 0.05
    tt = 0.8 * z + u
    assert abs(es.iv_2sls(table(spark, t=tt, z=z, y=2 * tt + 3 * u, w=w), "t", "y", ["z"], ["w"]).first()["estimate"] - 2) < 0.6
    with pytest.raises(ValueError):
        es.binary(table(spark, t=[0, 1, 2]), "t")
    with pytest.raises(ValueError):
        es.rdd(df, "s", "y", 1.0, kernel="triangular")


def test_did_equals_dummies(spark):
    r = np.random.default_rng(3)
    g, p = np.repeat(np.arange(20), 5), np.tile(np.arange(5), 20)
    keep = r.random(100) < 0.9
    g, p = g[keep], p[keep]
    t = ((g % 2 == 0) & (p >= 2)).astype(float)
    y = 3 * t + g * 0.3 + p * 0.5 + r.normal(size=len(g))
    a = np.column_stack([t, *(g == k for k in range(20)), *(p == k for k in range(1, 5))]).astype(float)
    b, rss, rank, _ = np.linalg.lstsq(a, y, rcond=None)
    got = es.did(table(spark, g=g, p=p, t=t, y=y), "t", "y", "g", "p").first()
    assert math.isclose(got["estimate"], b[0], abs_tol=1e-6)
    assert math.isclose(got["std_error"], math.sqrt(rss[0] / (len(g) - rank) * np.linalg.inv(a.T @ a)[0, 0]), abs_tol=1e-6)


def test_preparation(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", " Yes", None), (2, "a", "no", 1.0), (3, None, "y", float("nan")), (4, "b", "N", 5.0)], "id int, k string, yn string, v double")
    assert prep.missing_profile(df).first()["n_missing"] == 2
    assert prep.handle_missing(df).count() == 2  # a share of exactly one half drops rows
    filled = {r["id"]: (r["k"], r["v"]) for r in prep.impute_mode(prep.impute_mean(df)).collect()}
    assert filled[1] == ("b", 3.0) and filled[3] == ("b", 3.0)
    assert [r["yn"] for r in prep.bool_encode(df, ["yn"]).orderBy("id").collect()] == [1, 0, 1, 0]
    assert [r["k"] for r in prep.label_encode(df, ["k"]).orderBy("id").collect()] == [1, 0, 1, 1]
    encoded, book = prep.encode_categoricals(df, 1.0)
    assert dict(encoded.dtypes)["k"] == "int" and book.where("column = 'k'").count() == 2
    dummies = spark.createDataFrame([(1, 0, 2.0), (0, 1, 4.0)], "reg1 int, reg2 int, x double")
    assert prep.drop_dummies(dummies).columns == ["x"]
    twins = spark.createDataFrame([(1.0, 2.0, 3.0, 7.0), (2.0, 4.0, 1.0, 7.0), (3.0, 6.0, 2.0, 7.0)], "a double, b double, c double, d double")
    assert prep.drop_correlated(twins).columns == ["a", "c", "d"]
    empty = df.where("id > 9")
    assert prep.missing_profile(empty).first()["share"] is None and prep.handle_missing(empty).count() == 0
    write_table(df.select("id", "v"), str(tmp_path / "t"))
    back = read_csv(spark, str(tmp_path / "t"))
    assert dict(back.dtypes) == {"id": "bigint", "v": "double"} and back.where("v is null").count() == 2
    write_codebook(book, str(tmp_path / "book"))
    assert list((tmp_path / "book").glob("column=*"))


def test_discovery_of_planted_graphs(spark):
    r = np.random.default_rng(0)
    n = 1500
    a, e, d = (r.normal(size=n) for _ in range(3))
    b = 0.8 * a + e
    chain = table(spark, a=a, b=b, c=0.8 * b + d)
    collider = table(spark, a=a, b=e, c=a + e + 0.5 * d)
    for find in (ds.pc, ds.ges, ds.notears):
        assert {frozenset(x) for x in find(chain, chain.columns).weights} == {frozenset("ab"), frozenset("bc")}
        assert set(find(collider, collider.columns).weights) == {("a", "c"), ("b", "c")}
    u = r.uniform(-1, 1, size=n)
    v = u + r.uniform(-1, 1, size=n)
    uniform = table(spark, c=u, a=v, b=v + r.uniform(-1, 1, size=n))
    assert ds.lingam_order(uniform, uniform.columns)[0] == ["c", "a", "b"]
    assert set(ds.lingam(uniform, uniform.columns).weights) == {("c", "a"), ("a", "b")}
    hidden = r.normal(size=n)
    latent = table(spark, a=a, b=a + hidden + 0.3 * d, c=e + hidden + 0.3 * r.normal(size=n), d=e)
    assert ds.fci(latent, latent.columns).latent == {"U_b_c"}
    assert ds.mmd(a[:50, None], a[:50, None]) == pytest.approx(0) and ds.mmd(a[:50, None], a[:50, None] + 3) > 0.1


def test_families(spark):
    r = np.random.default_rng(5)
    df = table(spark, n=r.normal(size=100), m=r.normal(size=100))
    assert lk.detect_family(df).majority == "norm"
    assert lk.normal_ad_p(0.2, 100) > 0.5 > lk.normal_ad_p(2.0, 100)
    mixed = spark.createDataFrame([("a",), ("b",)], "k string")
    assert lk.detect_family(mixed).family == "discrete"


def test_tests_and_engine(spark):
    r = np.random.default_rng(6)
    n = 400
    s = r.normal(size=n)
    t = (s + r.normal(size=n) > 0).astype(float)
    df = table(spark, t=t, s=s, y=2 * t + s + 0.3 * r.normal(size=n))
    rows = {r["test"]: r for r in dg.run_all(df, "t", "y", ["s"]).collect()}
    assert rows["exogeneity"]["passed"] is False and rows["linearity"]["p_value"] is not None
    assert dg.run_all(df.where("s > 99"), "t", "y", ["s"]).count() >= 4  # tests that fail are rows
    g = engine.CausalGraph.from_edges(["s -> t", "s -> y", "t -> y"])
    got = engine.answer(df, CausalQuery("t", "y"), g)
    assert got.plan.method == "OLS" and abs(got.effect.first()["estimate"] - 2) < 0.15
    assert engine.resolve("How does education affect wage?", ["id", "wage", "educ"]) == CausalQuery("educ", "wage")


def test_stream_moments(spark, tmp_path):
    from causeway.streaming.moments import moments_of, running_sums

    df = table(spark, a=[1, 2, 4], b=[2, 1, 0])
    df.write.parquet(str(tmp_path / "in"))
    q = running_sums(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["a", "b"]).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    try:
        q.processAllAvailable()
        m = moments_of(spark.table("sums").first(), ["a", "b"])
    finally:
        q.stop()
    assert np.allclose(m.cross, moments(df, ["a", "b"]).cross)


def test_planned_instruments_keep_covariates(spark):
    from causeway.plans.engine import estimate
    from causeway.plans.graph import CausalGraph
    from causeway.plans.planner import plan
    from causeway.roles import CausalQuery

    rng = np.random.default_rng(3)
    u, x = rng.normal(size=(2, 20_000))
    z = x + rng.normal(size=20_000)
    t = z + u + rng.normal(size=20_000)
    y = 2 * t + 3 * x + 3 * u + rng.normal(size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "y": y, "z": z, "x": x}))
    query = CausalQuery("t", "y", instruments=("z",))
    how = plan(query, CausalGraph.from_edges([("x", "z"), ("x", "y"), ("z", "t"), ("t", "y")]), 20_000)
    assert how.method == "IV" and how.adjustment == ("x",)
    assert abs(estimate(df, query, how).first()["estimate"] - 2) < 0.1
