"""Order statistics, running totals, leads, value counts and one-pass folds against numpy and plain Python, with their numbers of jobs."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import diagnostics as dg
from causeway.operators import estimators as es
from causeway.operators import likelihood as lk
from causeway.operators import prep, ranks
from causeway.plans import discovery as ds


def table(spark, **columns):
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns))


def jobs_of(spark, work) -> int:
    """Jobs that work starts (an exchange may be a job of its own)."""
    sc = spark.sparkContext
    sc.setJobGroup(name := f"counted {id(work)}", name)
    try:
        work()
        return len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc._jsc.clearJobGroup()


VALUES = {
    "spread": np.random.default_rng(1).normal(size=3000) * 1e6,
    "skewed": np.exp(np.random.default_rng(2).normal(size=3000) * 6),
    "hot": np.where(np.arange(3000) % 3 == 0, 7.0, np.arange(3000) % 11),
    "even": np.array([1.0, 2.0]),
    "one": np.array([4.5]),
    "huge": np.array([-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300]),
}


@pytest.mark.parametrize("name", VALUES)
def test_order_statistics(spark, name):
    x = VALUES[name]
    df = table(spark, x=x).unionByName(spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    assert ranks.order_statistics(df, "x", ranks=[0, len(x) // 2, len(x) - 1]) == [np.sort(x)[k] for k in (0, len(x) // 2, len(x) - 1)]
    if name != "huge":  # numpy's own difference is infinite there
        assert np.allclose(ranks.order_statistics(df, "x", shares=shares), np.quantile(x, shares), rtol=1e-12)


def test_order_statistics_without_numbers(spark):
    assert all(map(math.isnan, ranks.order_statistics(spark.createDataFrame([(None,)], "x double"), "x", shares=[0.5, 0.9])))
    assert lk.mle(spark.createDataFrame([(None,)], "x double"), "x").count() == 0


def test_value_totals(spark):
    x = VALUES["hot"]
    got = {r["value"]: (r["n"], r["below"]) for r in ranks.value_totals(table(spark, x=x), "x").collect()}
    assert got == {v: (n, int((x < v).sum())) for v, n in Counter(x.tolist()).items()}


@pytest.mark.parametrize("name", ["spread", "hot", "skewed"])
def test_goodness_over_whole_tables(spark, name):
    x = np.abs(VALUES[name]) % 50
    df = table(spark, x=x)
    errors, plain = lk.table_errors(df, "x"), lk.squared_errors(x)
    assert all(math.isclose(errors[f], plain[f], rel_tol=0.02) for f in lk.FAMILIES)  # numpy corrects some values at the bins' edges
    got = lk.table_anderson_darling(df, "x")
    for f in ("expon", "laplace"):
        assert math.isclose(got[f], lk.anderson_darling(lk.cdf(f, x, *lk.fitted(x)[f])), rel_tol=1e-6)
    assert math.isclose(got["norm"], lk.goodness("norm", x)[0], rel_tol=1e-6)


def test_families_over_whole_tables(spark):
    r = np.random.default_rng(5)
    found = lk.detect_family(table(spark, a=r.normal(size=2000), b=r.normal(size=2000) * 3 + 1, c=r.normal(size=2000)), whole=True)
    assert found.family == "norm" and all(p > 0.05 for _, p in found.per_column.values())
    found = lk.detect_family(table(spark, a=r.exponential(size=2000), b=r.exponential(size=2000) * 4), whole=True)
    assert found.family == "expon"
    assert lk.detect_family(table(spark, a=np.ones(20)), whole=True).family == "discrete"


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_leads_over_ranges(spark, parts):
    """One group of most rows, groups smaller than the leads, ranges with fewer rows than the leads, ties and nulls."""
    r = np.random.default_rng(4)
    rows = [("big", int(k), float(v)) for k, v in enumerate(r.integers(0, 9, 60))] + [(f"g{i}", k, float(10 * i + k)) for i in range(6) for k in range(i % 3)] + [(None, 1, 1.0), (None, 2, None)]
    df = spark.createDataFrame(rows, "g string, o int, t double")
    got = {(x["g"], x["o"]): (x["l1"], x["l2"], x["l3"]) for x in ranks.leads(df, "g", ["o"], F.col("t"), ["l1", "l2", "l3"], parts).collect()}
    groups = defaultdict(list)
    for g, o, t in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        groups[g].append((o, t))
    want = {(g, o): tuple(seq[i + k][1] if i + k < len(seq) else None for k in (1, 2, 3)) for g, seq in groups.items() for i, (o, _) in enumerate(seq)}
    assert got == want
    assert ranks.leads(df.where("o > 999"), "g", ["o"], F.col("t"), ["l1"], parts).count() == 0


def test_lead_tests_of_one_group(spark):
    r = np.random.default_rng(8)
    n = 400
    df = table(spark, g=np.zeros(n), o=np.arange(n), t=r.integers(0, 2, n), y=r.normal(size=n))
    rows = dg.lead_interactions(df, "t", "y", "g", ["o"]).collect()
    assert len(rows) == 4 and all(x["statistic"] is None for x in rows)  # one group has no interaction with itself


def test_codes_and_modes_come_from_value_counts(spark):
    r = np.random.default_rng(3)
    words = [f"w{int(x) % 40:02d}" for x in r.integers(0, 1000, 600)]
    rows = [(i, "hot" if i % 2 else w, None if i % 5 == 0 else w, bool(i % 3), " Yes" if i % 4 else "no") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "id int, a string, b string, f boolean, yn string")
    for c, k in (("a", 1), ("b", 2)):
        values = sorted({x[k] for x in rows if x[k] is not None})
        book = {x["value"]: x["code"] for x in prep.codebook(df, ["a", "b"]).where(F.col("column") == c).collect()}
        assert book == {v: i for i, v in enumerate(values)}
    count = Counter(x[2] for x in rows if x[2] is not None)
    mode = min(count, key=lambda v: (-count[v], v))
    assert prep.modes(df, ["a", "b", "f"]) == {"a": "hot", "b": mode, "f": "true"}
    assert {x["b"] for x in prep.impute_mode(df).where("id % 5 = 0").collect()} == {mode}
    tied = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "k string")
    assert prep.modes(tied, ["k"]) == {"k": "a"} and prep.modes(tied.where("k is null"), ["k"]) == {"k": None}
    encoded, book = prep.encode_categoricals(df, 0.2)
    assert dict(encoded.dtypes)["a"] == dict(encoded.dtypes)["yn"] == "int" and {x["value"] for x in book.where("column = 'yn'").collect()} == {" Yes", "no"}
    prep.BROADCAST_CODES, held = 0, prep.BROADCAST_CODES  # the join that shuffles gives the same
    try:
        again = prep.encode_categoricals(df, 0.2)[0]
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, encoded.collect()))
    finally:
        prep.BROADCAST_CODES = held


def test_preparation_takes_few_jobs(spark):
    rows = [(i, f"k{i % 4}", "yes" if i % 2 else "no", f"p{i % 3}", float(i), 2.0 * i) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a string, yn string, b string, v double, w double")
    assert jobs_of(spark, lambda: prep.full_preprocess(df)) <= 20


def test_folds_in_three_jobs(spark):
    r = np.random.default_rng(2)
    n = 2000
    x, z = r.normal(size=n), r.normal(size=n)
    t = x + r.normal(size=n)
    df = table(spark, x=x, z=z, t=t, y=2 * t + x - z + r.normal(size=n), i=np.arange(n)).persist()
    df.count()
    folds = [F.expr(f"cast(floor(i / {7**d}) % 20 as int)") for d in range(5)]
    got = []
    # each is one aggregate; its exchange may count as a job, and so may the broadcast of the models
    assert jobs_of(spark, lambda: got.extend(es.dml_divisions(df, "t", "y", ["x", "z"], folds))) <= 8

    data = {c: np.array([q[c] for q in df.orderBy("i").collect()]) for c in ("x", "z", "t", "y", "i")}
    a = np.column_stack([np.ones(n), data["x"], data["z"]])
    assert math.isnan(got[4][0])  # all rows in one fold
    for d, (theta, se, rows) in enumerate(got[:4]):
        fold = (np.floor(data["i"] / 7**d) % 20).astype(int)
        u, v = np.zeros(n), np.zeros(n)
        for f in set(fold.tolist()):
            for target, residual in ((data["y"], u), (data["t"], v)):
                b = np.linalg.lstsq(a[fold != f], target[fold != f], rcond=None)[0]
                residual[fold == f] = target[fold == f] - a[fold == f] @ b
        want = (u * v).sum() / (v * v).sum()
        psi = v * (u - want * v)
        assert rows == n and math.isclose(theta, want, rel_tol=1e-9) and math.isclose(se, math.sqrt((psi * psi).mean() / (v * v).mean() ** 2 / n), rel_tol=1e-9)
    assert es.dml_linear(df.where("i < 0"), "t", "y", ["x"], folds[0]).first()["estimate"] is None
    df.unpersist()


def test_discrepancy_by_features(spark):
    r = np.random.default_rng(9)
    a, b = r.normal(size=400), r.normal(size=400) + 1
    c = r.normal(size=400)
    for left, right in ((np.column_stack([a]), np.column_stack([b])), (np.column_stack([a, c]), np.column_stack([b, c]))):
        df = [table(spark, **{f"x{i}": m[:, i] for i in range(m.shape[1])}) for m in (left, right)]
        got, error = ds.mmd_features(*df, features=256)
        assert 0 < error < 0.2 and abs(got - ds.mmd(left, right)) < 4 * error
    same = table(spark, x=a)
    assert ds.mmd_features(same, same)[0] == pytest.approx(0, abs=1e-12)


def test_chi_square_of_cells(spark):
    r = np.random.default_rng(11)
    n = 1500
    z, w = r.integers(0, 3, n), r.integers(0, 2, n)
    a = (z + r.integers(0, 2, n)) % 3
    b = (z + r.integers(0, 2, n)) % 4
    df = table(spark, a=a, b=b, z=z, w=w)

    def plain(given):
        stat = free = 0
        for g in {tuple(x) for x in given}:
            here = np.array([tuple(x) == g for x in given])
            cells = np.array([[((a == i) & (b == j) & here).sum() for j in range(4)] for i in range(4)], dtype=float)
            cells = cells[cells.sum(1) > 0][:, cells.sum(0) > 0]
            e = np.outer(cells.sum(1), cells.sum(0)) / cells.sum()
            stat, free = stat + ((cells - e) ** 2 / e).sum(), free + (cells.shape[0] - 1) * (cells.shape[1] - 1)
        return stat, free

    for names, given in (((), [()] * n), (("z",), list(zip(z))), (("z", "w"), list(zip(z, w)))):
        stat, free, p = ds.chi_square(df, "a", "b", names)
        want = plain(given)
        assert math.isclose(stat, want[0], rel_tol=1e-9) and free == want[1]
        assert (p < 1e-6) == (not names)
    assert ds.chi_square(df.where("a > 9"), "a", "b") == (0.0, 0, 1.0)
