"""The two decision tables: which discovery algorithm, and which estimator."""

from __future__ import annotations

from causeway.plans.graph import CausalGraph, backdoor_set, conditional_instruments, frontdoor_set, instruments
from causeway.roles import CausalQuery, EffectPlan

#: Shares for the words of a confidence.
CONFIDENCE = {"HIGH": 0.9, "MID": 0.6, "LOW": 0.3}
ESTIMATORS = ("G Computation", "Propensity Score", "DML", "IV", "RDD", "DiD", "OLS", "Frontdoor Adjustment", "RCT")


def discovery_algorithm(latent: bool, family: str | None, n: int, p: int) -> str:
    """family: norm, expon, laplace, discrete or None (not trusted); a table is large from five rows a column."""
    if latent:
        return "FCI"
    if family == "discrete":
        return "GES"
    large = n >= 5 * p
    if family == "norm":
        return "PC" if large else "NOTEARS"
    return "LiNGAM" if large else "CGNN"


def covariates(query: CausalQuery, graph: CausalGraph) -> tuple[str, ...]:
    """Columns that a panel estimator adjusts for: those asked for, else the smallest set that the graph shows to close all back doors.

    Never the roles. None where the graph offers no such set: what it cannot justify may open a path as well as close one."""
    roles = {query.treatment, query.outcome, query.time, query.group, query.running, *query.instruments, *query.mediators}
    chosen = query.adjustment or backdoor_set(graph, query.treatment, query.outcome, [c for c in graph.observed() if c not in roles]) or ()
    return tuple(c for c in chosen if c not in roles)


def instrument_plan(query: CausalQuery, graph: CausalGraph, strict_reference: bool = False) -> EffectPlan | None:
    """Instruments, and the set given which they are valid; None if there are none.

    Named instruments are taken as they are, with the adjustment asked for, else with the smallest set that makes them valid
    in the graph (none if the graph shows none). Others are searched: first those that need no set, then the smallest set."""
    t, y = query.treatment, query.outcome
    if query.instruments:
        found = conditional_instruments(graph, t, y, query.instruments)
        adjust = query.adjustment or (found[1] if found else ())
        return EffectPlan("IV", instruments=tuple(query.instruments), adjustment=tuple(adjust), reason="instruments" if found or query.adjustment else "instruments that the graph does not confirm")
    if strict_reference:
        z = instruments(graph, t, y, "reference")
        return EffectPlan("IV", instruments=tuple(z), adjustment=query.adjustment, reason="instruments") if z else None
    found = conditional_instruments(graph, t, y)
    if not found:
        return None
    z, w = found
    return EffectPlan("IV", instruments=tuple(z), adjustment=tuple(dict.fromkeys([*w, *(c for c in query.adjustment if c not in z)])), reason=f"instruments given {', '.join(w)}" if w else "instruments")


def plan(query: CausalQuery, graph: CausalGraph, n: int, rdd_ok: bool = False, did_ok: bool = False, strict_reference: bool = False) -> EffectPlan:
    """The first estimator whose conditions hold; the graph's sets that identify the effect go with it.

    A design at a cutoff compares like with like, so it adjusts only for what is asked for."""
    t, y = query.treatment, query.outcome
    if query.randomized:
        return EffectPlan("RCT", reason="randomized")
    if query.cutoff is not None and rdd_ok:
        return EffectPlan("RDD", adjustment=tuple(c for c in query.adjustment if c not in (t, y, query.running)), reason="cutoff")
    if query.time is not None and did_ok:
        return EffectPlan("DiD", adjustment=covariates(query, graph), reason="time")
    if iv := instrument_plan(query, graph, strict_reference):
        return iv
    if m := frontdoor_set(graph, t, y, strict_reference):
        return EffectPlan("Frontdoor Adjustment", mediators=tuple(m), reason="front door")
    adjust = None if query.latent else backdoor_set(graph, t, y)
    if adjust:
        rows = n / len(adjust)
        method = "OLS" if rows >= 25 else "Propensity Score" if rows >= 15 else "DML" if n >= 500 else "G Computation"
        return EffectPlan(method, adjustment=tuple(adjust), reason=f"{rows:.1f} rows for each adjusted column")
    return EffectPlan("OLS", reason="no adjustment set")


def named_algorithm(answer, least_confidence: float = 0.0) -> str | None:
    """An estimator's name from an answer: a name, or JSON with inference_algorithm (or algorithm) and confidence; None leaves it to the plan."""
    import json

    if isinstance(answer, str) and answer.strip().startswith("{"):
        try:
            answer = json.loads(answer)
        except ValueError:
            return None
    if isinstance(answer, dict):
        sure = answer.get("confidence", 1.0)
        try:
            sure = CONFIDENCE[sure.strip().upper()] if isinstance(sure, str) and sure.strip().upper() in CONFIDENCE else float(sure)
        except (TypeError, ValueError):
            sure = 0.0
        sure = sure / 100 if sure > 1 else sure
        answer = answer.get("inference_algorithm", answer.get("algorithm")) if sure >= least_confidence else None
    if not isinstance(answer, str) or answer.strip().strip("*").lower() in ("", "none"):
        return None
    for name in ESTIMATORS:
        if name.lower() == answer.strip().lower():
            return name
    raise ValueError(f"no estimator is called {answer!r}")
