"""Conditional instruments and planned adjustment, FCI and GES against brute force, and questions put to a model."""

import json
import threading
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest

from causeway.operators.moments import Moments
from causeway.plans import discovery as ds
from causeway.plans import engine, intent
from causeway.plans.discovery import ARROW, CIRCLE, TAIL
from causeway.plans.graph import CausalGraph, backdoor_set, conditional_instruments
from causeway.plans.planner import plan
from causeway.roles import CausalQuery

G = CausalGraph.from_edges


# ---- instruments and adjustment


def brute_instruments(g, t, y):
    """The smallest W, then the alphabetically first instrument, by trying all."""
    cut, gone = g.without_outgoing([t]), g.descendants(t) | g.descendants(y)
    pool = [x for x in g.observed() if x not in (t, y) and x not in gone]
    for k in range(len(pool)):
        found = [(z, w) for z in pool for w in combinations([x for x in pool if x != z], k) if not g.separated([z], [t], w) and cut.separated([z], [y], w)]
        if found:
            return k, min(found)
    return None


@pytest.mark.parametrize("seed", range(25))
def test_conditional_instruments_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    names = list("abcdty")
    order = list(rng.permutation(names))
    g = G([(order[i], order[j]) for i, j in combinations(range(6), 2) if rng.random() < 0.35] + [("h", "t"), ("h", "y")], names, latent=["h"])
    if not g.is_dag():
        return
    got, want = conditional_instruments(g, "t", "y"), brute_instruments(g, "t", "y")
    assert (got is None) == (want is None)
    if got:
        z, w = got
        assert len(w) == want[0] and want[1][0] in z
        assert all(not g.separated([x], ["t"], w) and g.without_outgoing(["t"]).separated([x], ["y"], w) for x in z)


@pytest.mark.parametrize("seed", range(15))
def test_backdoor_sets_against_brute_force(seed):
    rng = np.random.default_rng(100 + seed)
    names = list("abcdty")
    order = list(rng.permutation(names))
    g = G([(order[i], order[j]) for i, j in combinations(range(6), 2) if rng.random() < 0.45], names)
    pool = sorted(set("abcd") - g.descendants("t"))
    cut = g.without_outgoing(["t"])
    want = next((list(z) for k in range(len(pool) + 1) for z in combinations(pool, k) if cut.separated(["t"], ["y"], z)), None)
    assert backdoor_set(g, "t", "y") == want


def test_named_instruments():
    g = G(["x -> z", "x -> y", "z -> t", "h -> t", "h -> y", "t -> y", "q -> t"], latent=["h"])
    assert conditional_instruments(g, "t", "y", ["z"]) == (["z"], ["x"])
    assert conditional_instruments(g, "t", "y", ["q", "z"]) == (["q", "z"], ["x"])
    assert conditional_instruments(g, "t", "y") == (["q"], [])
    assert conditional_instruments(g, "t", "y", ["y"]) is None and conditional_instruments(g, "t", "y", ["nowhere"]) is None
    how = plan(CausalQuery("t", "y", instruments=("x",)), g, 100)  # not valid, and said so
    assert how.method == "IV" and how.adjustment == () and "not confirm" in how.reason


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_planned_sets_give_the_effect(spark):
    """A collider that is no descendant of the treatment must stay out; a covariate that makes an instrument valid must come in."""
    r = np.random.default_rng(1)
    n = 30_000
    z, h, e = r.normal(size=(3, n))
    t = z + e
    y = 2 * t + 2 * h + r.normal(size=n)
    df = frame(spark, z=z, t=t, y=y, w=z + h + 0.5 * r.normal(size=n))
    how = plan(CausalQuery("t", "y"), g := G(["z -> t", "t -> y", "z -> w", "h -> w", "h -> y"], latent=["h"]), n)
    assert how.method == "IV" and how.instruments == ("z",) and how.adjustment == ()
    assert abs(engine.estimate(df, CausalQuery("t", "y"), how).first()["estimate"] - 2) < 0.1
    assert engine.asked_plan(CausalQuery("t", "y", algorithm="OLS"), g).adjustment == ()

    x = r.normal(size=n)
    z = x + r.normal(size=n)
    t = z + h + e
    df = frame(spark, x=x, z=z, t=t, y=2 * t + 3 * x + 3 * h + r.normal(size=n))
    how = plan(CausalQuery("t", "y"), G(["x -> z", "x -> y", "z -> t", "h -> t", "h -> y", "t -> y"], latent=["h"]), n)
    assert (how.method, how.instruments, how.adjustment) == ("IV", ("z",), ("x",))
    assert abs(engine.estimate(df, CausalQuery("t", "y"), how).first()["estimate"] - 2) < 0.1


def test_panels_and_cutoffs_adjust_for_what_is_justified():
    g = G(["c -> t", "c -> y", "t -> y", "t -> v", "g -> y", "m -> w", "y -> w"])
    panel = CausalQuery("t", "y", time="p", group="g")
    assert plan(panel, g, 100, did_ok=True).adjustment == ("c",)
    assert plan(panel, G(["t -> y", "z -> w", "h -> w", "h -> y", "z -> t"], latent=["h"]), 100, did_ok=True).adjustment == ()
    cutoff = CausalQuery("t", "y", running="r", cutoff=1.0)
    assert plan(cutoff, g, 100, rdd_ok=True).adjustment == ()
    assert plan(CausalQuery("t", "y", running="r", cutoff=1.0, adjustment=("c", "r")), g, 100, rdd_ok=True).adjustment == ("c",)


# ---- FCI


def ancestors(g, x, nodes):
    seen, todo = {x}, [x]
    while todo:
        v = todo.pop()
        for p in nodes:
            if (p, v) in g and g[p, v] == ARROW and g[v, p] == TAIL and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def ancestral(g, nodes):
    above = {x: ancestors(g, x, nodes) for x in nodes}
    for (a, b), mark in g.items():
        if mark == ARROW and b in above[a]:
            return None
        if mark == g[b, a] == TAIL and any((w, v) in g and g[w, v] == ARROW for v in (a, b) for w in nodes):
            return None
    return above


def m_separated(g, nodes, above, x, y, z):
    below = set().union(*[above[v] for v in z]) if z else set()
    todo, seen = [(x, v) for v in nodes if (x, v) in g], set()
    while todo:
        u, v = todo.pop()
        if v == y:
            return False
        if (u, v) in seen:
            continue
        seen.add((u, v))
        for w in nodes:
            if w != u and (v, w) in g:
                collider = g[u, v] == ARROW and g[w, v] == ARROW
                if v in below if collider else v not in z:
                    todo.append((v, w))
    return True


def brute_pag(nodes, separated, kinds):
    """Marks that all maximal ancestral graphs with these separations share, circles elsewhere."""
    sets = {(a, b): [z for k in range(len(nodes) - 1) for z in combinations([v for v in nodes if v not in (a, b)], k)] for a, b in combinations(nodes, 2)}
    truth = {p: tuple(separated(*p, z) for z in zs) for p, zs in sets.items()}
    edges, marks = [p for p, row in truth.items() if not any(row)], {}
    for choice in product(kinds, repeat=len(edges)):
        g = {}
        for (a, b), (at_a, at_b) in zip(edges, choice):
            g[b, a], g[a, b] = at_a, at_b
        above = ancestral(g, nodes)
        if above is not None and all(tuple(m_separated(g, nodes, above, *p, z) for z in zs) == truth[p] for p, zs in sets.items()):
            for e, m in g.items():
                marks.setdefault(e, set()).add(m)
    return {e: m.pop() if len(m) == 1 else CIRCLE for e, m in marks.items()}


HIDDEN = [(TAIL, ARROW), (ARROW, TAIL), (ARROW, ARROW)]


@pytest.mark.parametrize("size,selection", [(4, 0), (4, 1), (4, 2), (5, 0)])
def test_fci_against_brute_force(size, selection):
    rng, nodes, tried = np.random.default_rng(size + 10 * selection), list("abcde")[:size], 0
    while tried < (60 if size == 4 else 25):
        g = CausalGraph(set(nodes))
        order = list(rng.permutation(nodes))
        for i, j in combinations(range(size), 2):
            if rng.random() < 0.35:
                g.add(order[i], order[j])
        for h in range(rng.integers(0, 4)):
            for v in rng.choice(nodes, 2, replace=False):
                g.add(f"h{h}", str(v))
        held = [f"s{i}" for i in range(selection)]
        for s in held:
            for v in rng.choice(nodes, 2, replace=False):
                g.add(str(v), s)
        separated = lambda a, b, z, g=g, held=held: g.separated([a], [b], [*z, *held])
        got = ds.fci_from(nodes, separated)
        if len(got.marks) > 12:
            continue  # more than six edges take the plain version long
        tried += 1
        assert got.marks == brute_pag(nodes, separated, HIDDEN + [(TAIL, TAIL)] * bool(selection))


def test_fci_finds_large_separating_sets():
    """Five common causes must all be held to separate two nodes."""
    g = G([e for i in range(5) for e in ((f"c{i}", "a"), (f"c{i}", "b"))])
    got = ds.fci_from(sorted(g.nodes), lambda a, b, z: g.separated([a], [b], z))
    assert not got.is_edge("a", "b")


def test_fci_of_a_table_with_a_hidden_cause(spark):
    r = np.random.default_rng(2)
    a, d, f, u = r.normal(size=(4, 8000))
    b = a + d + 0.5 * r.normal(size=8000)
    df = frame(spark, a=a, d=d, f=f, b=b, c=b + u + 0.5 * r.normal(size=8000), e=f + u + 0.5 * r.normal(size=8000))
    found = ds.fci(df, df.columns, alpha=0.001)
    assert found.latent == {"U_c_e"} and set(found.weights) == {("b", "c"), ("U_c_e", "c"), ("U_c_e", "e")}


# ---- GES


def best_score(m, nodes):
    """The best total score of any graph without cycles, by programming over sets."""
    local = {(y, ps): ds.local_bic(m, y, ps) for y in nodes for k in range(len(nodes)) for ps in combinations([x for x in nodes if x != y], k)}
    best = {frozenset(): 0.0}
    for k in range(1, len(nodes) + 1):
        for some in map(frozenset, combinations(nodes, k)):
            best[some] = max(best[some - {y}] + max(local[y, ps] for j in range(k) for ps in combinations(sorted(some - {y}), j)) for y in some)
    return best[frozenset(nodes)]


@pytest.mark.parametrize("seed", range(30))
def test_ges_reaches_the_best_score_of_five_nodes(seed):
    """With the exact covariance of a random graph, as many rows would give it, the search must end in the best class."""
    rng, n, nodes = np.random.default_rng(seed), 10**7, list("abcde")
    b = np.array([[rng.choice([-1, 1]) * rng.uniform(0.5, 1) if j < i and rng.random() < 0.6 else 0.0 for j in range(5)] for i in range(5)])
    mix = np.linalg.inv(np.eye(5) - b)
    m = Moments(tuple(nodes), n, float(n), np.zeros(5), n * mix @ mix.T)
    dag = ds.extension(nodes, *ds.ges_from(m, nodes))
    got = sum(ds.local_bic(m, y, dag.parents(y)) for y in nodes)
    assert got == pytest.approx(best_score(m, nodes), abs=1e-3)


def test_cliques_of_any_size():
    adjacent = lambda a, b: {a, b} != {"a", "b"}
    got = {frozenset(s) for s in ds.cliques_with({"z"}, list("abcde"), adjacent)}
    assert got == {frozenset(s) for k in range(6) for s in combinations("abcde", k) if not {"a", "b"} <= set(s)}


# ---- questions


class Model:
    """Answers by the kind of question, and notes how many calls run at once."""

    def __init__(self, **answers):
        self.answers, self.asked, self.lock = answers, [], threading.Lock()

    def __call__(self, messages):
        assert [m["role"] for m in messages] == ["system", "user"]
        part = next(k for k, v in (intent.FIRST | intent.SECOND).items() if v.split("{")[0].split(". ")[-1][:25] in messages[1]["content"] and (k in intent.FIRST) == (not messages[1]["content"].startswith("Treatment:")) and self.marks(k, messages[1]["content"]))
        with self.lock:
            self.asked.append((part, messages[1]["content"]))
        return self.answers.get(part, "None")

    @staticmethod
    def marks(part, text):
        words = {"treatment": "is the treatment", "outcome": "is the outcome", "time": "periods", "running": "name a running", "cutoff": "name the cutoff", "group": "group or unit", "algorithm": "estimators", "instruments": "instruments:", "mediators": "mediators,", "graph": "causal graph"}
        return words[part] in text


COLUMNS = ["educ", "wage", "near", "age"]


def test_ten_answers_become_roles_and_a_graph():
    model = Model(
        treatment="<think>Perhaps wage? No.</think>\n educ", outcome="`Wage`", algorithm='```json\n{"inference_algorithm": "OLS", "confidence": "HIGH"}\n```', mediators="None", cutoff="None",
        graph='Here it is: {"causal_graph": "digraph G { educ -> wage; }", "edges": ["age -> educ", "age -> wage", "educ -> wage", "moon -> wage", "age -> age"]}',
    )
    got = intent.ask("How does education affect the wage?", "educ wage\n12 3.5", COLUMNS, model)
    assert got.query == CausalQuery("educ", "wage", algorithm="OLS")
    assert set(got.graph.weights) == {("age", "educ"), ("age", "wage"), ("educ", "wage")}
    assert len(model.asked) == 10 and {p for p, _ in model.asked[:7]} == set(intent.FIRST)
    assert all("Treatment: educ. Outcome: wage." in text for part, text in model.asked if part in intent.SECOND)
    low = Model(treatment="educ", outcome="wage", algorithm='{"inference_algorithm": "DML", "confidence": "LOW"}', instruments="near, educ, moon", graph="digraph { educ -> wage }")
    got = intent.ask("?", "", COLUMNS, low, least_confidence=0.5)
    assert got.query.algorithm == "IV" and got.query.instruments == ("near",) and set(got.graph.weights) == {("educ", "wage")}
    assert intent.answered_algorithm("magic", 0) is None and intent.answered_algorithm('{"inference_algorithm": "None"}', 0) is None
    assert intent.answered_graph("no graph", COLUMNS) is None and intent.answered_graph('{"edges": 3}', COLUMNS) is None
    with pytest.raises(ValueError):
        intent.ask("?", "", COLUMNS, Model(treatment="moon", outcome="wage"))


def test_a_question_is_answered(spark):
    r = np.random.default_rng(7)
    n = 3000
    age, h = r.normal(size=(2, n))
    near = age + r.normal(size=n)
    educ = near + h + r.normal(size=n)
    df = frame(spark, educ=educ, wage=2 * educ + age + 2 * h + r.normal(size=n), near=near, age=age)
    model = Model(treatment="educ", outcome="wage", instruments="near", graph='{"edges": ["age -> near", "age -> wage", "near -> educ", "educ -> wage"]}')
    got = engine.answer_question(df, "How does education affect the wage?", model)
    assert got.discovery == "given" and got.plan.method == "IV" and got.plan.adjustment == ("age",)
    assert abs(got.effect.first()["estimate"] - 2) < 0.1
    assert len(model.asked) == 10
