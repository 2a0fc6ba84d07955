"""Causal graphs on the driver (tens of nodes): paths, separation, identification, rules of the do-calculus."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.results import edges as edge_rows
from causeway.sources.tables import checkpointed


@dataclass
class CausalGraph:
    nodes: set[str] = field(default_factory=set)
    weights: dict[tuple[str, str], float | None] = field(default_factory=dict)  # (from, to) -> weight
    latent: set[str] = field(default_factory=set)

    @classmethod
    def from_edges(cls, edges: Iterable, nodes: Iterable[str] = (), latent: Iterable[str] = ()) -> CausalGraph:
        """Edges as pairs, triples with a weight, or texts 'A -> B'."""
        g = cls(set(nodes), {}, set(latent))
        for e in edges:
            a, b, *w = [x.strip() for x in e.split("->")] if isinstance(e, str) else e
            g.add(a, b, w[0] if w else None)
        g.nodes |= g.latent
        return g

    @classmethod
    def from_dot(cls, text: str) -> CausalGraph:
        """Edges of a DOT text; chains A -> B -> C are two edges."""
        out: dict[tuple[str, str], None] = {}
        for statement in re.split(r"[;{}\n]", text):
            names = [x.strip().strip('"') for x in re.sub(r"\[.*?\]", "", statement).split("->")]
            out |= dict.fromkeys(zip(names, names[1:], strict=False))
        return cls.from_edges(e for e in out if all(e))

    @classmethod
    def from_table(cls, edges: DataFrame, most: int = 10_000) -> CausalGraph:
        """Edges of a table with src and dst; an error where there are more than a graph of columns can have."""
        found = edges.select("src", "dst").dropna().distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} edges")
        return cls.from_edges(sorted((r["src"], r["dst"]) for r in found))

    def add(self, a: str, b: str, weight: float | None = None) -> None:
        self.nodes |= {a, b}
        self.weights[a, b] = weight

    def copy(self) -> CausalGraph:
        return CausalGraph(set(self.nodes), dict(self.weights), set(self.latent))

    def has(self, a: str, b: str) -> bool:
        return (a, b) in self.weights

    def drop(self, a: str, b: str) -> None:
        self.weights.pop((a, b), None)

    def parents(self, x: str) -> set[str]:
        return {a for a, b in self.weights if b == x}

    def children(self, x: str) -> set[str]:
        return {b for a, b in self.weights if a == x}

    def _reach(self, starts: Iterable[str], step) -> set[str]:
        seen, todo = set(), list(starts)
        while todo:
            for y in step(todo.pop()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    def descendants(self, *xs: str) -> set[str]:
        return self._reach(xs, self.children)

    def ancestors(self, *xs: str) -> set[str]:
        return self._reach(xs, self.parents)

    def is_dag(self) -> bool:
        return not any(x in self.descendants(x) for x in self.nodes)

    def order(self) -> list[str]:
        """A topological order, alphabetical among equals."""
        left, out = {x: len(self.parents(x)) for x in self.nodes}, []
        while ready := sorted(x for x, n in left.items() if not n):
            out.append(ready[0])
            del left[ready[0]]
            for y in self.children(ready[0]):
                left[y] -= 1
        if left:
            raise ValueError("the graph has a cycle")
        return out

    def paths(self, a: str, b: str) -> list[list[str]]:
        """Directed paths without repeated nodes."""
        out, todo = [], [[a]]
        while todo:
            p = todo.pop()
            for y in sorted(self.children(p[-1]), reverse=True):
                if y == b:
                    out.append([*p, y])
                elif y not in p:
                    todo.append([*p, y])
        return out

    def cycles(self) -> list[list[str]]:
        """Simple cycles, each once, from its smallest node."""
        return [p[:-1] for x in sorted(self.nodes) for p in self.paths(x, x) if min(p) == x]

    def without_cycles(self, last: bool = True) -> CausalGraph:
        """For each cycle its closing (or first) edge is taken out, if it is still there."""
        g = self.copy()
        for c in self.cycles():
            ring = list(zip(c, [*c[1:], c[0]], strict=True))
            if all(g.has(*e) for e in ring):
                g.drop(*(ring[-1] if last else ring[0]))
        return g

    def without_incoming(self, xs: Iterable[str]) -> CausalGraph:
        xs, g = set(xs), self.copy()
        g.weights = {e: w for e, w in g.weights.items() if e[1] not in xs}
        return g

    def without_outgoing(self, xs: Iterable[str]) -> CausalGraph:
        xs, g = set(xs), self.copy()
        g.weights = {e: w for e, w in g.weights.items() if e[0] not in xs}
        return g

    def separated(self, xs: Iterable[str], ys: Iterable[str], given: Iterable[str] = ()) -> bool:
        """d-separation: no way between xs and ys in the moral graph of their ancestors without the given nodes."""
        xs, ys, zs = set(xs), set(ys), set(given)
        keep = xs | ys | zs
        keep |= self.ancestors(*keep)
        near: dict[str, set[str]] = {x: set() for x in keep}
        for y in keep:
            ps = self.parents(y) & keep
            for p in ps:
                near[p].add(y), near[y].add(p)
            for p, q in combinations(ps, 2):
                near[p].add(q), near[q].add(p)
        start = xs - zs
        return not ((self._reach(start, lambda v: near[v] - zs) | start) & (ys - zs))

    def observed(self) -> list[str]:
        return sorted(self.nodes - self.latent)

    def edge_table(self, spark: SparkSession) -> DataFrame:
        return edge_rows(spark, [(a, b, w, a in self.latent or b in self.latent) for (a, b), w in self.weights.items()])


def backdoor_set(g: CausalGraph, t: str, y: str, covariates: Iterable[str] | None = None) -> list[str] | None:
    """The smallest (then alphabetically first) set of non-descendants of t that separates t and y without t's out-edges.

    None if there is none or the graph has a cycle; an empty list where nothing need be adjusted for."""
    if not g.is_dag() or not {t, y} <= g.nodes:
        return None
    cut = g.without_outgoing([t])
    pool = sorted(set(covariates if covariates is not None else g.observed()) & set(g.observed()) - {t, y} - g.descendants(t))
    return separator(cut, [t], [y], pool)


def frontdoor_set(g: CausalGraph, t: str, y: str, strict_reference: bool = False) -> list[str]:
    """Observed mediators that meet the front-door criterion, the smallest set; empty if there is none."""
    if strict_reference or not g.is_dag() or not {t, y} <= g.nodes:
        return []
    paths = g.paths(t, y)
    inner = sorted({x for p in paths for x in p[1:-1]} - g.latent)
    for k in range(1, len(inner) + 1):
        for m in combinations(inner, k):
            through = all(set(p[1:-1]) & set(m) for p in paths)
            if paths and through and g.without_outgoing([t]).separated([t], m) and g.without_outgoing(m).separated(m, [y], [t]):
                return list(m)
    return []


def instruments(g: CausalGraph, t: str, y: str, mode: str = "graphical") -> list[str]:
    """Observed nodes that move t and reach y through t alone. mode 'reference': Z independent of y given t, not of t."""
    g = g if g.is_dag() else g.without_cycles(last=False)
    if not {t, y} <= g.nodes:
        return []
    out = []
    for z in g.observed():
        if z in (t, y) or g.separated([z], [t]):
            continue
        if mode == "reference":
            fine = g.separated([z], [y], [t])
        else:
            fine = z not in g.descendants(t) and g.without_outgoing([t]).separated([z], [y])
        out += [z] * fine
    return out


def separator(g: CausalGraph, xs: Iterable[str], ys: Iterable[str], pool: Iterable[str]) -> list[str] | None:
    """The smallest (then alphabetically first) subset of pool that separates xs from ys; None if no subset does.

    A smallest separator holds only ancestors of xs and ys, and if any subset separates, then all such ancestors of the
    pool do. So the search is over those alone, and ends before it begins where they do not."""
    xs, ys = set(xs), set(ys)
    near = sorted((set(pool) - xs - ys) & (g.ancestors(*xs, *ys)))
    if not g.separated(xs, ys, near):
        return None
    return next(list(w) for k in range(len(near) + 1) for w in combinations(near, k) if g.separated(xs, ys, w))


def conditional_instruments(g: CausalGraph, t: str, y: str, named: Iterable[str] = ()) -> tuple[list[str], list[str]] | None:
    """(instruments, W): nodes that move t given W and reach y through t alone once W is held, for the smallest W that there is.

    W holds observed nodes that t does not change. Among equally small sets the alphabetically first instrument decides,
    and all others that are valid given the same W join it. With named instruments W must suit all of them together, and
    one must move t. None if there are none or the graph has a cycle."""
    named = sorted(set(named))
    if not g.is_dag() or not {t, y, *named} <= g.nodes:
        return None
    changed = g.descendants(t)
    pool = [x for x in g.observed() if x not in (t, y) and x not in changed and x not in g.descendants(y)]
    cut = g.without_outgoing([t])

    def moves(z: str, w: Iterable[str]) -> bool:
        return not g.separated([z], [t], w)

    if named:
        free = [x for x in pool if x not in named]
        if changed & set(named):
            return None
        near = sorted(set(free) & cut.ancestors(*named, y))
        fits = (w for k in range(len(near) + 1) for w in combinations(near, k) if cut.separated(named, [y], w) and any(moves(z, w) for z in named))
        w = next(fits, None) if cut.separated(named, [y], near) else None
        return None if w is None else (named, list(w))
    best: tuple[int, str, tuple[str, ...]] | None = None
    for z in pool:
        near = sorted((set(pool) - {z}) & cut.ancestors(z, y))
        if not cut.separated([z], [y], near):
            continue
        most = len(near) if best is None else min(len(near), best[0] - 1)
        for k in range(most + 1):
            w = next((w for w in combinations(near, k) if moves(z, w) and cut.separated([z], [y], w)), None)
            if w is not None:
                best = (k, z, w)
                break
    if best is None:
        return None
    w = best[2]
    return [z for z in pool if z not in w and moves(z, w) and cut.separated([z], [y], w)], list(w)


def do_rule(g: CausalGraph, rule: int, y, z, x=(), w=(), mode: str = "textbook") -> bool:
    """Whether a rule of the do-calculus applies: 1 drops observation z, 2 turns action z into observation, 3 drops action z."""
    x, y, z, w = ([v] if isinstance(v, str) else list(v) for v in (x, y, z, w))
    h = g.without_incoming(x)
    if rule == 2:
        h = h.without_outgoing(z) if mode == "textbook" else h.without_incoming(z)
    elif rule == 3 and mode == "textbook":
        h = h.without_incoming(set(z) - h.ancestors(*w) - set(w))
    elif rule == 3:
        for a in z:
            for b in y:
                h.drop(a, b)
    elif rule != 1:
        raise ValueError("there are rules 1, 2 and 3")
    return h.separated(y, z, [*x, *w])


def separation_table(spark: SparkSession, g: CausalGraph, most: int = 2) -> DataFrame:
    """x, y, given, separated for all pairs and conditioning sets of at most so many observed nodes."""
    names = g.observed()
    rows = [(a, b, ",".join(z), g.separated([a], [b], z)) for a, b in combinations(names, 2) for k in range(most + 1) for z in combinations([n for n in names if n not in (a, b)], k)]
    return spark.createDataFrame(rows, "x string, y string, given string, separated boolean")


def closure(edges: DataFrame) -> DataFrame:
    """src, dst of all directed paths of any length, also round cycles.

    Known paths are joined end to end until there is no new one, so rounds are the logarithm of the longest path. Each
    round's distinct pairs are written to the shared checkpoint folder, where the lineage ends."""
    paths, known = checkpointed(edges.select("src", "dst").dropna().distinct()), -1
    while (n := paths.count()) != known:
        known = n
        onward = paths.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        paths = checkpointed(paths.union(paths.join(onward, "dst").select("src", F.col("to").alias("dst"))).distinct())
    return paths
