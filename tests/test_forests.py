import numpy as np
import pytest

from causeway.operators import estimators as es
from causeway.operators import forests


def best_by_rows(x, y, w, depth):
    """Plain tree of one covariate over rows, by squared errors."""
    if depth and len(set(x)) > 1:
        sse = lambda m: float((w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum())
        cut = min(sorted(set(x))[:-1], key=lambda c: sse(x <= c) + sse(x > c))
        if sse(x <= cut) + sse(x > cut) < sse(x == x) - 1e-9:
            out = np.empty(len(x))
            for m in (x <= cut, x > cut):
                out[m] = best_by_rows(x[m], y[m], w[m], depth - 1)
            return out
    return np.full(len(x), np.average(y, weights=w))


def test_a_tree_of_sums_is_the_tree_of_its_rows():
    r = np.random.default_rng(3)
    x, w = r.integers(0, 24, 600), r.integers(1, 4, 600).astype(float)
    y = np.sin(x / 3) + 0.3 * r.normal(size=600)
    got = forests.grown(np.bincount(x, w, 24), np.bincount(x, w * y, 24), r)
    assert np.allclose(got[x], best_by_rows(x, y, w, forests.DEPTH))


def test_bootstrap_weights_are_poisson_and_independent_between_trees():
    h = np.random.default_rng(4).integers(0, 1 << 63, 200_000).astype(np.uint64)
    a, b = forests.weights(h, 0), forests.weights(h, 1)
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert abs((a == 0).mean() - np.exp(-1)) < 0.005


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(6)
    x, z = r.integers(0, 5, 1500), r.normal(size=1500)
    t = (r.random(1500) < 0.3 + 0.1 * x).astype(float)
    y = 2 * t + 0.5 * x + np.sin(z) + 0.2 * r.normal(size=1500)
    return spark.createDataFrame([(i, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(t, y, x, z, strict=True))], "id long, t double, y double, x double, z double").persist()


def test_rare_values_can_be_split_off(spark):
    df = spark.createDataFrame([(float(i % 100 > 0), float(i)) for i in range(1000)], "rare double, many double")
    rare, many = forests.thresholds(df, ["rare", "many"])
    assert rare == [0.5] and len(many) == forests.BINS - 1


def test_forests_are_not_fitted_on_the_rows_again_for_every_fold(rows, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    def never(*_):
        raise AssertionError("fitted on rows")

    monkeypatch.setattr(RandomForestRegressor, "fit", never)
    got = es.dml_forest(rows, "t", "y", ["x", "z"], ["id"], 3, 20).first()
    assert got["n"] == 1500 and abs(got["estimate"] - 2) < 5 * got["std_error"] < 0.5
    # and files and tasks that the rows come in make no difference
    assert abs(es.dml_forest(rows.repartition(7, "z"), "t", "y", ["x", "z"], ["id"], 3, 20).first()["estimate"] - got["estimate"]) < 2e-6


def test_too_many_cells_for_a_table_of_sums(rows, monkeypatch):
    monkeypatch.setattr(forests, "CELLS", 1)
    got = es.dml_forest(rows, "t", "y", ["x", "z"], ["id"], 2, 10).first()
    assert got["n"] == 1500 and abs(got["estimate"] - 2) < 5 * got["std_error"] < 0.5
