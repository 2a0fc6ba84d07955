"""From a question to an effect: prepare, discover, test, choose an estimator, estimate."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from causeway.operators import diagnostics, estimators, prep
from causeway.plans.discovery import discover
from causeway.plans.graph import CausalGraph, backdoor_set
from causeway.plans.intent import Answerer, ask, resolve
from causeway.plans.planner import ESTIMATORS, covariates, instrument_plan, plan
from causeway.roles import CausalQuery, EffectPlan
from causeway.sources.tables import numeric_columns, preview


def estimate(df: DataFrame, query: CausalQuery, how: EffectPlan, key: list[str] | None = None) -> DataFrame:
    """The effect by one estimator."""
    t, y = query.treatment, query.outcome
    match how.method:
        case "OLS":
            return estimators.ols(df, t, y, how.adjustment)
        case "RCT":
            return estimators.rct(df, t, y)
        case "IV":
            return estimators.iv_2sls(df, t, y, how.instruments or query.instruments, how.adjustment)
        case "DiD":
            return estimators.did(df, t, y, query.group, query.time, how.adjustment)
        case "RDD":
            return estimators.rdd(df, query.running, y, query.cutoff, how.adjustment)
        case "Propensity Score":
            return estimators.ipw(estimators.logistic_propensity(estimators.binary(df, t), t, list(how.adjustment), folds=5), t, y)
        case "DML":
            k = estimators.fold_count(df.count())
            return estimators.dml_linear(df, t, y, how.adjustment, estimators.hashed_fold(key or df.columns, k), k)
        case "G Computation":
            return estimators.gcomp(df, t, y, how.adjustment)
        case "Frontdoor Adjustment":
            return estimators.frontdoor_linear(df, t, y, how.mediators or query.mediators)
    raise ValueError(f"no estimator is called {how.method!r}; there are {', '.join(ESTIMATORS)}")


@dataclass
class Answer:
    plan: EffectPlan
    graph: CausalGraph
    discovery: str
    effect: DataFrame
    diagnostics: DataFrame | None
    codebook: DataFrame


def asked_plan(query: CausalQuery, graph: CausalGraph) -> EffectPlan:
    """The plan for the estimator that the query names, with the sets that the query or the graph gives it."""
    how = EffectPlan(query.algorithm, query.adjustment, query.instruments, query.mediators, "asked for")
    match query.algorithm:
        case "IV":
            found = instrument_plan(query, graph)
            return replace(found, reason=f"asked for; {found.reason}") if found else how
        case "DiD":
            return replace(how, adjustment=covariates(query, graph))
        case "RCT" | "RDD" | "Frontdoor Adjustment":
            return how
    return replace(how, adjustment=query.adjustment or tuple(backdoor_set(graph, query.treatment, query.outcome) or ()))


def answer(df: DataFrame, query: CausalQuery, graph: CausalGraph | None = None, with_tests: bool = False, key: list[str] | None = None) -> Answer:
    """Prepare the table, find a graph if none is given, choose an estimator (or take the query's), and estimate."""
    query.check(df.columns)
    ready, book = prep.full_preprocess(df, keep=roles_of(query))
    ready = ready.persist()
    try:
        numeric = [c for c in numeric_columns(ready) if not key or c not in key]
        if graph is None:
            name, graph = discover(ready.select(numeric), numeric, query.latent)
        else:
            name = "given"
        if query.algorithm:
            how = asked_plan(query, graph)
        else:
            near = query.running and query.cutoff is not None and diagnostics.rdd_ok(ready, query.running, query.treatment, query.outcome, query.cutoff)
            trend = False
            if query.time and query.group and not query.randomized:
                rows = diagnostics.lead_interactions(ready, query.treatment, query.outcome, query.group, [query.time]).collect()  # one row for each lead
                trend = all(r["passed"] for r in rows)
            how = plan(query, graph, ready.count(), bool(near), trend)
        if how.method == "OLS" and not how.adjustment and query.adjustment:
            how = replace(how, adjustment=query.adjustment)
        tests = None
        if with_tests:
            tests = diagnostics.run_all(ready, query.treatment, query.outcome, [c for c in graph.observed() if c in numeric], how.instruments, how.mediators, query.group, [query.time] if query.time else None, query.running, query.cutoff, key)
        return Answer(how, graph, name, estimate(ready, query, how, key), tests, book)  # estimates and tests are rows already, not plans over ready
    finally:
        ready.unpersist()


def roles_of(query: CausalQuery) -> list[str]:
    named = [query.treatment, query.outcome, query.time, query.group, query.running, *query.instruments, *query.mediators, *query.adjustment]
    return list(dict.fromkeys(c for c in named if c))


def answer_question(df: DataFrame, question: str, ask_model: Answerer, order: list[str] | None = None, with_tests: bool = False, key: list[str] | None = None) -> Answer:
    """From a question in words: a model names the roles, perhaps an estimator and a graph; then as `answer`."""
    rows = [" ".join(map(str, r)) for r in preview(df, order or df.columns[:1]).collect()]  # three rows
    intent = ask(question, "\n".join([" ".join(df.columns), *rows]), df.columns, ask_model)
    return answer(df, intent.query, intent.graph, with_tests, key)


__all__ = ["Answer", "answer", "answer_question", "estimate", "resolve"]
