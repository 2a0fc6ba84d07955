"""Generators of whole graphs: their gradient, tuning, and the direction of planted causes."""

import numpy as np
import pandas as pd

from causeway.plans import discovery as ds


def planted(n: int = 100):
    r = np.random.default_rng(0)
    x = r.uniform(-2, 2, size=n)
    y = np.tanh(3 * x) + 0.2 * r.normal(size=n)
    return x, y, y * y + 0.1 * r.normal(size=n)


def standard(*columns):
    m = np.column_stack(columns)
    return (m - m.mean(axis=0)) / m.std(axis=0)


def test_fitting_lowers_the_discrepancy():
    data = standard(*planted())
    before, after = (np.mean([ds.joint_loss(data, [[], [0], [1]], 10, s, steps) for s in range(2)]) for steps in (1, 150))
    assert after < before / 2
    assert ds.joint_loss(data, [[], [0], [1]], 5, 3, 20) == ds.joint_loss(data, [[], [0], [1]], 5, 3, 20)


def test_the_cause_explains_better():
    x, y, _ = planted()
    onward, back = ([ds.joint_loss(d, [[], [0]], 10, s) for s in range(4)] for d in (standard(x, y), standard(y, x)))
    assert np.mean(onward) < np.mean(back)


def test_tuning_stops_where_it_should(monkeypatch):
    trials = ds._Trials(None, np.zeros((2, 2)))
    losses = {5: 0.5, 10: 0.4, 20: 0.3995, 30: 0.1}
    monkeypatch.setattr(trials, "scores", lambda graphs, h, runs, start=0: [losses[h]])
    assert ds._tuned_hidden(trials, (), (5, 10, 20, 30), 8) == 10
    rng = np.random.default_rng(1)
    monkeypatch.setattr(trials, "scores", lambda graphs, h, runs, start=0: [1 + rng.normal() / runs])
    assert 8 <= ds._tuned_runs(trials, (), 5, 128) <= 128
    monkeypatch.setattr(trials, "scores", lambda graphs, h, runs, start=0: [float(start)])
    assert ds._tuned_runs(trials, (), 5, 64) == 64


def test_graph_of_three_columns(spark):
    x, y, z = planted()
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z}))
    g = ds.cgnn(df, ["x", "y", "z"], hidden=(5, 10), most_runs=8)
    assert g.is_dag() and len(g.weights) == 3 and g.has("x", "y")
    assert g.weights == ds.cgnn(df.repartition(3), ["x", "y", "z"], hidden=(5, 10), most_runs=8).weights
    assert not ds.cgnn(df.limit(0), ["x", "y"]).weights
