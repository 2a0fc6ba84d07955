"""The kernel test: finds what a linear test misses, keeps what is independent, and agrees with a plain version."""

import numpy as np
import pandas as pd
import pytest

from causeway.operators import independence as ind
from causeway.operators.moments import moments
from causeway.plans import discovery as ds


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    n = 3000
    x, z, w = r.normal(size=(3, n))
    df = frame(spark, x=x, square=x * x + 0.5 * r.normal(size=n), wave=np.cos(1.5 * z) + 0.4 * r.normal(size=n), bowl=z * z + 0.4 * r.normal(size=n), z=z, w=w)
    return df.persist()


def test_dependence_without_correlation(rows):
    assert ds.fisher_z(moments(rows, ["x", "square"]), "x", "square", [])[1] > 0.01
    assert ind.kernel_test(rows, "x", "square")[1] < 1e-6
    assert ind.kernel_test(rows, "x", "square", ["w"])[1] < 1e-6


def test_independence_is_kept(rows):
    assert ind.kernel_test(rows, "x", "w")[1] > 0.01
    assert ind.kernel_test(rows, "wave", "bowl")[1] < 1e-4 and ind.kernel_test(rows, "wave", "bowl", ["z"])[1] > 0.01
    assert ind.kernel_test(rows.limit(10), "x", "square")[1] == 1.0 and ind.kernel_test(rows.where("x > 99"), "x", "w") == (0.0, 1.0, 0)


def test_false_alarms_are_rare(spark):
    r = np.random.default_rng(8)
    n = 400
    df = frame(spark, **{f"c{i}": r.normal(size=n) for i in range(8)}).persist()
    p = [ind.kernel_test(df, f"c{i}", f"c{j}", seed=i)[1] for i in range(8) for j in range(i)]
    assert sum(v < 0.05 for v in p) <= 5 and min(p) > 1e-4


def test_skeletons_by_each_test(spark, rows):
    assert {frozenset(e) for e in ds.pc(rows, ["x", "square", "w"], alpha=0.001, test="kernel").weights} == {frozenset(("x", "square"))}
    r = np.random.default_rng(4)
    a = r.integers(0, 3, 2000)
    df = frame(spark, a=a, b=(a + r.integers(0, 2, 2000)) % 3, c=r.integers(0, 2, 2000))
    assert {frozenset(e) for e in ds.pc(df, ["a", "b", "c"], alpha=0.001, test="chisq").weights} == {frozenset("ab")}
    with pytest.raises(ValueError):
        ds.pc(df, ["a", "b"], test="magic")
