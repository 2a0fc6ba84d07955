"""From a question to roles: ten questions to a function that answers messages, or the columns that the question names."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from causeway.plans.graph import CausalGraph
from causeway.plans.planner import ESTIMATORS, named_algorithm
from causeway.roles import CausalQuery, role

Answerer = Callable[[list[dict]], str]

#: What is asked about each part. Those of the second wave are told the treatment and the outcome.
FIRST = {
    "treatment": "Which column is the treatment, whose effect is asked for? An instrument is not the treatment. Answer with one column name.",
    "outcome": "Which column is the outcome, which the treatment changes? Answer with one column name.",
    "time": "Which column tells periods before the treatment began from those after it, for all units alike? Answer with one column name, or None.",
    "running": "Does the question name a running variable, whose passing of a cutoff assigns the treatment? Answer with one column name, or None.",
    "cutoff": "Does the question name the cutoff of a running variable? Answer with one number, or None.",
    "group": "Which column tells which group or unit a row belongs to? Answer with one column name, or None.",
    "algorithm": 'Which of these estimators should be used: {estimators}? Answer with JSON, {{"inference_algorithm": one of the names or "None", "confidence": "100" if the question names it, else "HIGH", "MID" or "LOW"}}.',
}
SECOND = {
    "instruments": "Treatment: {treatment}. Outcome: {outcome}. Which columns surely are instruments: they move the treatment, and the outcome only through it? Answer with column names and commas, or None.",
    "mediators": "Treatment: {treatment}. Outcome: {outcome}. Which columns surely are mediators, on the way from the treatment to the outcome? Answer with column names and commas, or None.",
    "graph": 'Treatment: {treatment}. Outcome: {outcome}. Which causal graph of the columns are you sure of? Answer with JSON, {{"causal_graph": the graph in DOT, "edges": a list of "A -> B"}}.',
}
WORDS = re.compile(r"[a-z0-9]+")


def final_answer(text: str | None) -> str:
    """The answer without the reasoning before it and the fence around it."""
    text = (text or "").rsplit("</think>", 1)[-1].strip()
    fenced = re.fullmatch(r"```\w*\s*(.*?)\s*```", text, re.S)
    return fenced[1] if fenced else text


def as_json(text: str):
    """The JSON object of a text, also with words around it; None if there is none."""
    start, end = text.find("{"), text.rfind("}")
    try:
        return json.loads(text[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        return None


def answered_graph(text: str, columns: list[str]) -> CausalGraph | None:
    """The edges of an answer, as a list or in DOT, that join two different columns; None without any."""
    got = as_json(text) if not text.lstrip().startswith("digraph") else {"causal_graph": text}
    if not isinstance(got, dict):
        return None
    listed = got.get("edges")
    pairs = [tuple(x.strip().strip('"') for x in e.split("->")) for e in listed if isinstance(e, str)] if isinstance(listed, list) else []
    if not pairs and isinstance(got.get("causal_graph"), str):
        body = re.sub(r"^\s*(strict\s+)?digraph\s*\w*\s*", "", got["causal_graph"])
        pairs = list(CausalGraph.from_dot(body).weights)
    known = [p for p in dict.fromkeys(pairs) if len(p) == 2 and p[0] != p[1] and set(p) <= set(columns)]
    return CausalGraph.from_edges(known) if known else None


def answered_algorithm(text: str, least_confidence: float) -> str | None:
    """The estimator of an answer; None for none, for names that are not known, and below the confidence."""
    got = as_json(text)
    try:
        return named_algorithm(got if got is not None else text, least_confidence)
    except ValueError:
        return None


@dataclass(frozen=True)
class Intent:
    query: CausalQuery
    graph: CausalGraph | None = None
    answers: dict[str, str] = field(default_factory=dict)


def _column(text: str, columns: list[str]) -> str | None:
    """The column that an answer names, whatever its case or quotes; the bare answer if it is none of them."""
    bare = role(text.strip().strip("\"'`*. "))
    return next((c for c in columns if bare and c.lower() == bare.lower()), bare)


def ask(question: str, context: str, columns: list[str], answer: Answerer, least_confidence: float = 0.0) -> Intent:
    """Ten calls in two waves, those of a wave at once. Named instruments decide on the estimator IV."""

    def one(item: tuple[str, str], told: dict[str, str]) -> tuple[str, str]:
        part, what = item
        system = f"A table with the columns {', '.join(columns)}; its first rows:\n{context}\nA causal question about it: {question}\nUse only these columns, and add no explanation."
        return part, final_answer(answer([{"role": "system", "content": system}, {"role": "user", "content": what.format(estimators=", ".join(ESTIMATORS), **told)}]))

    with ThreadPoolExecutor(max_workers=len(FIRST)) as pool:
        found = dict(pool.map(lambda item: one(item, {}), FIRST.items()))
        told = {k: str(_column(found[k], columns)) for k in ("treatment", "outcome")}
        found |= dict(pool.map(lambda item: one(item, told), SECOND.items()))
    known = lambda part: _column(found[part], columns) if _column(found[part], columns) in columns else None
    listed = lambda part: [c for c in dict.fromkeys(_column(x, columns) for x in found[part].split(",")) if c in columns and c not in told.values()]
    query = CausalQuery.of(
        told["treatment"], told["outcome"], time=known("time"), running=known("running"), group=known("group"), cutoff=found["cutoff"],
        algorithm=answered_algorithm(found["algorithm"], least_confidence), instruments=listed("instruments"), mediators=listed("mediators"),
    )
    query.check(columns)
    return Intent(query, answered_graph(found["graph"], columns), found)


def named_columns(question: str, columns: list[str]) -> list[str]:
    """Columns one of whose words the question has, in the order of the question."""
    words = WORDS.findall(question.lower())
    spot = {}
    for c in columns:
        tokens = WORDS.findall(c.lower().replace("_", " "))
        places = [i for i, w in enumerate(words) if any(w == t or (len(t) > 3 and (w.startswith(t) or t.startswith(w)) and len(w) > 3) for t in tokens)]
        if places:
            spot[c] = places[0]
    return sorted(spot, key=lambda c: (spot[c], c))


def resolve(question: str, columns: list[str], answer: Answerer | None = None, context: str = "") -> CausalQuery:
    """Roles from a question. Without a function that answers messages: the first two columns that the question names."""
    if answer:
        return ask(question, context, columns, answer).query
    named = named_columns(question, columns)
    if len(named) < 2:
        raise ValueError("the question names fewer than two columns")
    return CausalQuery(named[0], named[1])
