from itertools import combinations, product

import numpy as np
import pytest

from causeway.plans.graph import CausalGraph, backdoor_set, do_rule, frontdoor_set, instruments
from causeway.plans.planner import discovery_algorithm, named_algorithm, plan
from causeway.roles import CausalQuery, role_list

G = CausalGraph.from_edges


def brute_separated(g, a, b, given):
    """No path between a and b that is open given the set."""
    near = {x: g.parents(x) | g.children(x) for x in g.nodes}
    todo = [[a]]
    while todo:
        p = todo.pop()
        if p[-1] == b:
            open_ = True
            for x, y, z in zip(p, p[1:], p[2:]):
                collider = g.has(x, y) and g.has(z, y)
                if collider and not (({y} | g.descendants(y)) & set(given)) or not collider and y in given:
                    open_ = False
            if open_:
                return False
            continue
        todo += [[*p, n] for n in near[p[-1]] if n not in p]
    return True


@pytest.mark.parametrize("seed", range(12))
def test_separation_against_paths(seed):
    rng = np.random.default_rng(seed)
    names = list("abcde")
    g = G([(names[i], names[j]) for i, j in combinations(range(5), 2) if rng.random() < 0.45], names)
    for a, b in combinations(names, 2):
        rest = [x for x in names if x not in (a, b)]
        for k in range(4):
            for z in combinations(rest, k):
                assert g.separated([a], [b], z) == brute_separated(g, a, b, z)


def test_identification():
    g = G(["c -> t", "c -> y", "t -> y"])
    assert backdoor_set(g, "t", "y") == ["c"]
    assert backdoor_set(G(["t -> y"]), "t", "y") == []
    assert backdoor_set(G(["a -> b", "b -> a"]), "a", "b") is None
    front = G(["u -> t", "u -> y", "t -> m", "m -> y"], latent=["u"])
    assert frontdoor_set(front, "t", "y") == ["m"] and frontdoor_set(front, "t", "y", True) == []
    iv = G(["z -> t", "u -> t", "u -> y", "t -> y", "t -> d"], latent=["u"])
    assert instruments(iv, "t", "y") == ["z"]
    assert instruments(iv, "t", "y", "reference") == ["d"]  # as the documented predicate has it


def test_do_rules_and_cycles():
    g = G(["x -> z", "z -> y", "x -> y"])
    assert do_rule(g, 2, "y", "z", "x") and not do_rule(g, 1, "y", "z", "x")
    assert do_rule(G(["y -> z"]), 3, "y", "z") and not do_rule(g, 3, "y", "z", "x")
    assert do_rule(G(["z -> y"]), 3, "y", "z", mode="reference")
    with pytest.raises(ValueError):
        do_rule(g, 4, "y", "z")
    ring = G(["a -> b", "b -> c", "c -> a"])
    assert not ring.is_dag() and ring.without_cycles().is_dag() and ring.cycles() == [["a", "b", "c"]]
    assert CausalGraph.from_dot('digraph { a -> b -> c; "d" -> a [label=x] }').weights.keys() == {("a", "b"), ("b", "c"), ("d", "a")}


def test_discovery_table():
    for latent, family, large in product((True, False), ("norm", "expon", "laplace", "discrete", None), (True, False)):
        got = discovery_algorithm(latent, family, 50 if large else 49, 10)
        if latent:
            assert got == "FCI"
        elif family == "discrete":
            assert got == "GES"
        elif family == "norm":
            assert got == ("PC" if large else "NOTEARS")
        else:
            assert got == ("LiNGAM" if large else "CGNN")


def test_estimator_list():
    g, q = G(["c -> t", "c -> y", "t -> y"]), CausalQuery("t", "y")
    assert plan(CausalQuery("t", "y", randomized=True), g, 100).method == "RCT"
    assert plan(CausalQuery("t", "y", cutoff=1.0), g, 100, rdd_ok=True).method == "RDD"
    assert plan(CausalQuery("t", "y", time="w"), g, 100, did_ok=True).method == "DiD"
    assert plan(q, G(["z -> t", "t -> y", "c -> t", "c -> y"]), 100).method == "IV"
    assert [plan(q, g, n).method for n in (25, 24, 15, 14)] == ["OLS", "Propensity Score", "Propensity Score", "G Computation"]
    many = G([e for i in range(34) for e in ((f"c{i}", "t"), (f"c{i}", "y"))] + [("t", "y")])
    assert plan(CausalQuery("t", "y", latent=True), many, 500).method == "OLS"
    assert plan(q, G(["t -> y"]), 100).adjustment == ()


def test_names_and_roles():
    assert named_algorithm('{"algorithm": "OLS", "confidence": 0.9}') == "OLS" and named_algorithm("**None**") is None
    assert named_algorithm({"algorithm": "IV", "confidence": 0.1}, 0.5) is None
    with pytest.raises(ValueError):
        named_algorithm("magic")
    assert role_list("a, b") == ["a", "b"] and role_list("None") == []
    q = CausalQuery.of("educ", "wage", instruments="nearc2, nearc4", cutoff="12", time="None")
    assert q.algorithm == "IV" and q.cutoff == 12.0 and q.time is None
    with pytest.raises(ValueError):
        CausalQuery.of("None", "y")
    with pytest.raises(ValueError):
        q.check(["educ", "wage"])


def test_closure_of_long_chains_and_cycles(spark):
    from causeway.plans.graph import closure

    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(80)], "src string, dst string")
    assert closure(chain).count() == 81 * 80 // 2
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")], "src string, dst string")
    assert sorted(map(tuple, closure(ring).collect())) == [(x, y) for x in "abc" for y in "abc"]
    assert closure(ring.limit(0)).count() == 0
