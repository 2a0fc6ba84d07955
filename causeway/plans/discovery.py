"""Causal discovery. Spark gives moment matrices (or a bounded sample); searches run on matrices as wide as the columns."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.dist import two_sided_normal
from causeway.operators.independence import kernel_test
from causeway.operators.moments import Moments, complete, moments, partial_correlation, scaled_inverse
from causeway.plans.graph import CausalGraph

TAIL, ARROW, CIRCLE = "-", ">", "o"


class MixedGraph:
    """Edges with a mark at each end: marks[a, b] is the mark at b of the edge between a and b."""

    def __init__(self, nodes: list[str]):
        self.nodes, self.marks = list(nodes), {}

    def join(self, a: str, b: str, at_a: str = CIRCLE, at_b: str = CIRCLE) -> None:
        self.marks[b, a], self.marks[a, b] = at_a, at_b

    def cut(self, a: str, b: str) -> None:
        self.marks.pop((a, b), None), self.marks.pop((b, a), None)

    def near(self, a: str) -> list[str]:
        return [b for b in self.nodes if (a, b) in self.marks]

    def is_edge(self, a: str, b: str) -> bool:
        return (a, b) in self.marks

    def directed(self, a: str, b: str) -> bool:
        return self.marks.get((a, b)) == ARROW and self.marks.get((b, a)) == TAIL

    def undirected(self, a: str, b: str) -> bool:
        return self.is_edge(a, b) and self.marks[a, b] != ARROW and self.marks[b, a] != ARROW


def fisher_z(m: Moments, a: str, b: str, given) -> tuple[float, float]:
    """(z, p) of the test that a and b are uncorrelated given the others."""
    left = m.n - len(given) - 3
    if left <= 0:
        return 0.0, 1.0
    r = min(max(partial_correlation(m, a, b, list(given)), -1 + 1e-12), 1 - 1e-12)
    z = math.sqrt(left) * math.atanh(r)
    return z, two_sided_normal(z)


def chi_square(df: DataFrame, a: str, b: str, given=()) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p) of Pearson's test on contingency tables within the values of the given columns.

    One count of the cells that occur is all that reads the rows. The sum over all cells of (n - e)^2 / e is the sum of
    n^2 / e over those that occur, less the rows, as the e of a table add up to its rows; so empty cells need not be made.
    Rows with a null in any of the columns are left out."""
    from causeway.functions.dist import chi2_cdf

    names = [f"z{i}" for i in range(len(given))] or ["z"]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip([a, b, *given], ["a", "b", *names], strict=False)]
    whole = df.select(*columns).dropna() if given else df.select(*columns, F.lit(0).alias("z")).dropna()
    cells = whole.groupBy("a", "b", *names).agg(F.count("*").cast("double").alias("n"))
    rows, cols = (cells.groupBy(k, *names).agg(F.sum("n").alias(f"n{k}")) for k in ("a", "b"))
    shares = cells.join(rows, ["a", *names]).join(cols, ["b", *names]).groupBy(*names).agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("q"), F.sum("n").alias("n"))
    ka, kb = (t.groupBy(*names).agg(F.count("*").alias(f"k{k}")) for t, k in ((rows, "a"), (cols, "b")))
    tables = shares.join(ka, names).join(kb, names)
    row = tables.agg(F.sum(F.col("n") * (F.col("q") - 1)).alias("s"), F.sum((F.col("ka") - 1) * (F.col("kb") - 1)).alias("d")).first()
    statistic, free = max(0.0, row["s"] or 0.0), int(row["d"] or 0)
    return statistic, free, 1 - chi2_cdf(statistic, free) if free else 1.0


def chi_square_independent(df: DataFrame, a: str, b: str, given, alpha: float) -> bool:
    return chi_square(df, a, b, given)[2] > alpha


def skeleton(nodes: list[str], independent) -> tuple[MixedGraph, dict[frozenset, tuple[str, ...]]]:
    """Adjacencies that no conditioning set of neighbours removes (order-independent), and the sets that removed others."""
    g, sets = MixedGraph(nodes), {}
    for a, b in combinations(nodes, 2):
        g.join(a, b)
    size = 0
    while any(len(g.near(a)) - 1 >= size for a in nodes):
        frozen = {a: g.near(a) for a in nodes}
        for a, b in combinations(nodes, 2):
            if not g.is_edge(a, b):
                continue
            pools = [[c for c in frozen[x] if c not in (a, b)] for x in (a, b)]
            found = next((s for pool in pools for s in combinations(pool, size) if independent(a, b, s)), None)
            if found is not None:
                g.cut(a, b)
                sets[frozenset((a, b))] = found
        size += 1
    return g, sets


def colliders(g: MixedGraph, sets: dict) -> None:
    for c in g.nodes:
        for a, b in combinations(g.near(c), 2):
            if not g.is_edge(a, b) and c not in sets.get(frozenset((a, b)), (c,)):
                g.marks[a, c] = g.marks[b, c] = ARROW


def meek(directed: set, undirected: set) -> tuple[set, set]:
    """Orientations that follow from those there are (Meek's first three rules)."""
    directed, undirected = set(directed), set(undirected)
    adjacent = lambda a, b: (a, b) in directed or (b, a) in directed or frozenset((a, b)) in undirected

    def forced(a: str, b: str) -> bool:
        nodes = {x for e in directed for x in e} | {x for e in undirected for x in e}
        if any((c, a) in directed and not adjacent(c, b) for c in nodes - {a, b}):
            return True
        if any((a, c) in directed and (c, b) in directed for c in nodes):
            return True
        into = [c for c in nodes if (c, b) in directed and frozenset((a, c)) in undirected]
        return any(not adjacent(c, d) for c, d in combinations(into, 2))

    change = True
    while change:
        change = False
        for e in sorted(undirected, key=sorted):
            for a, b in (sorted(e), sorted(e, reverse=True)):
                if e in undirected and forced(a, b):
                    undirected.discard(e)
                    directed.add((a, b))
                    change = True
    return directed, undirected


def parts(g: MixedGraph) -> tuple[set, set]:
    directed, undirected = set(), set()
    for a, b in combinations(g.nodes, 2):
        if g.is_edge(a, b):
            to, fro = g.marks[a, b] == ARROW, g.marks[b, a] == ARROW
            if to == fro:
                undirected.add(frozenset((a, b)))
            else:
                directed.add((a, b) if to else (b, a))
    return directed, undirected


def to_dag(nodes: list[str], directed: set, undirected: set) -> CausalGraph:
    """Directed edges first; others in alphabetical direction, turned if that closes a cycle, left out if both do."""
    g = CausalGraph(set(nodes))
    for a, b in [*sorted(directed), *sorted(tuple(sorted(e)) for e in undirected)]:
        for x, y in ((a, b), (b, a)):
            if x not in g.descendants(y):
                g.add(x, y)
                break
            if (a, b) in directed:
                break
    return g


def independence(df: DataFrame, columns: list[str], alpha: float, test: str):
    """A function that tells whether two columns are independent given others, by a test: fisherz (one moment matrix for all),
    chisq (a count of cells each) or kernel (two passes each)."""
    if test == "fisherz":
        m = moments(df, columns)
        return lambda a, b, s: fisher_z(m, a, b, s)[1] > alpha
    if test == "chisq":
        return lambda a, b, s: chi_square_independent(df, a, b, s, alpha)
    if test == "kernel":
        return lambda a, b, s: kernel_test(df, a, b, s)[1] > alpha
    raise ValueError(f"no test is called {test!r}")


def pc(df: DataFrame, columns: list[str], alpha: float = 0.05, test: str = "fisherz") -> CausalGraph:
    """Skeleton, colliders, Meek's rules."""
    g, sets = skeleton(sorted(columns), independence(df, columns, alpha, test))
    colliders(g, sets)
    return to_dag(g.nodes, *meek(*parts(g)))


def possible_d_sep(g: MixedGraph, a: str) -> set[str]:
    """Nodes on ways from a whose inner nodes are colliders or in triangles."""
    out, todo, seen = set(), [(a, b) for b in g.near(a)], set()
    while todo:
        x, y = todo.pop()
        if (x, y) in seen:
            continue
        seen.add((x, y))
        out.add(y)
        for z in g.near(y):
            if z not in (x, a) and ((g.marks[x, y] == ARROW and g.marks[z, y] == ARROW) or g.is_edge(x, z)):
                todo.append((y, z))
    return out - {a}


def separating_set(g: MixedGraph, a: str, b: str, independent) -> tuple[str, ...] | None:
    """A set of possible d-separators of a (or of b) that makes them independent, the smallest first, of any size; None if there is none."""
    for x, y in ((a, b), (b, a)):
        pool = sorted(possible_d_sep(g, x) - {y})
        found = next((s for k in range(1, len(pool) + 1) for s in combinations(pool, k) if independent(a, b, s)), None)
        if found is not None:
            return found
    return None


def fci_from(nodes: list[str], independent) -> MixedGraph:
    """Partial ancestral graph from a test of independence: skeleton, possible d-separators, colliders, all ten rules.

    independent(a, b, s) tells whether a and b are independent given s. Hidden common causes give arrows at both ends,
    selection tails at both ends."""
    g, sets = skeleton(sorted(nodes), independent)
    colliders(g, sets)
    for a, b in combinations(g.nodes, 2):
        if g.is_edge(a, b) and (found := separating_set(g, a, b, independent)) is not None:
            g.cut(a, b)
            sets[frozenset((a, b))] = found
    for e in g.marks:
        g.marks[e] = CIRCLE
    colliders(g, sets)
    return oriented(g, sets)


class _Marks:
    """Puts marks in place of circles, and notes whether any was put."""

    def __init__(self, g: MixedGraph):
        self.g, self.changed = g, False

    def put(self, a: str, b: str, what: str) -> None:
        """what at b's end of the edge between a and b."""
        if self.g.marks[a, b] == CIRCLE:
            self.g.marks[a, b] = what
            self.changed = True


def oriented(g: MixedGraph, sets: dict) -> MixedGraph:
    """g with all marks that follow: arrowheads and tails of single pairs (rules 1 to 3), discriminating paths (4), selection (5 to 7), tails of longer ways (8 to 10)."""
    rules = (lambda m: _local_rules(m), lambda m: _discriminating_paths(m, sets), _circle_cycles, _tails_from_selection, _tails_of_ways)
    while True:
        for rule in rules:
            marks = _Marks(g)
            rule(marks)
            if marks.changed:
                break  # earlier rules come first again
        else:
            return g


def _local_rules(m: _Marks) -> None:
    g, mark = m.g, m.g.marks
    for b in g.nodes:
        for a in g.near(b):
            for c in g.near(b):
                if a == c:
                    continue
                apart = not g.is_edge(a, c)
                if apart and mark[a, b] == ARROW and mark[c, b] == CIRCLE:  # 1
                    m.put(c, b, TAIL), m.put(b, c, ARROW)
                if not apart and mark[a, c] == CIRCLE and ((g.directed(a, b) and mark[b, c] == ARROW) or (mark[a, b] == ARROW and g.directed(b, c))):  # 2
                    m.put(a, c, ARROW)
                if apart and mark[a, b] == ARROW and mark[c, b] == ARROW:  # 3
                    for d in g.near(b):
                        if d not in (a, c) and mark[d, b] == CIRCLE and g.is_edge(a, d) and g.is_edge(c, d) and mark[a, d] == mark[c, d] == CIRCLE:
                            m.put(d, b, ARROW)


def _discriminating_paths(m: _Marks, sets: dict) -> None:
    g = m.g
    for b in g.nodes:
        for c in g.near(b):
            if g.marks[c, b] == CIRCLE and (path := _discriminating(g, b, c)):  # 4
                if b in sets.get(frozenset((path[0], c)), ()):
                    m.put(c, b, TAIL), m.put(b, c, ARROW)
                else:
                    a = path[-2]
                    for x, y in ((a, b), (b, a), (b, c), (c, b)):
                        m.changed |= g.marks[x, y] != ARROW
                        g.marks[x, y] = ARROW
                return


def _discriminating(g: MixedGraph, b: str, c: str) -> list[str] | None:
    """A path from a node that is not adjacent to c, over colliders that are parents of c, to b."""
    todo = [[a, b] for a in g.near(b) if a != c and g.directed(a, c) and g.marks[b, a] == ARROW]
    while todo:
        p = todo.pop(0)
        for d in g.near(p[0]):
            if d in p or d == c or g.marks[d, p[0]] != ARROW:
                continue
            if not g.is_edge(d, c):
                return [d, *p]
            if g.directed(d, c) and g.marks[p[0], d] == ARROW:
                todo.append([d, *p])
    return None


def uncovered_paths(g: MixedGraph, a: str, b: str, step, first: list[str] | None = None):
    """Paths of three nodes or more from a to b on which no node's two neighbours are adjacent, whose edges all pass step(x, y); lazily, short ones first."""
    todo = [[a, x] for x in (first if first is not None else g.near(a)) if x != b and step(a, x)]
    while todo:
        p = todo.pop(0)
        for x in g.near(p[-1]):
            if x in p or not step(p[-1], x) or g.is_edge(p[-2], x):
                continue
            if x == b:
                yield [*p, x]
            else:
                todo.append([*p, x])


def _circle_cycles(m: _Marks) -> None:
    """Rule 5: an edge and an uncovered path, all circles, whose ends see each other only through the edge, are of selection."""
    g, mark = m.g, m.g.marks
    circles = lambda x, y: mark[x, y] == mark[y, x] == CIRCLE
    for a, b in combinations(g.nodes, 2):
        if not g.is_edge(a, b) or not circles(a, b):
            continue
        for p in uncovered_paths(g, a, b, circles):
            if len(p) > 3 and not g.is_edge(p[1], b) and not g.is_edge(a, p[-2]):
                for x, y in zip([*p, b], [*p[1:], a], strict=False):
                    m.put(x, y, TAIL), m.put(y, x, TAIL)
                m.put(a, b, TAIL), m.put(b, a, TAIL)
                return


def _tails_from_selection(m: _Marks) -> None:
    g, mark = m.g, m.g.marks
    for b in g.nodes:
        for c in g.near(b):
            if mark[c, b] != CIRCLE:
                continue
            for a in g.near(b):
                if a == c:
                    continue
                selected = mark[a, b] == mark[b, a] == TAIL  # 6
                half = mark[b, a] == TAIL and mark[a, b] == CIRCLE and not g.is_edge(a, c)  # 7
                if selected or half:
                    m.put(c, b, TAIL)


def _tails_of_ways(m: _Marks) -> None:
    """Rules 8 to 10: a tail at a for a o-> c where a is an ancestor of c in every graph of the class."""
    g, mark = m.g, m.g.marks
    onward = lambda x, y: mark[y, x] != ARROW and mark[x, y] != TAIL  # noqa: E731  x may come before y
    for a in g.nodes:
        for c in g.near(a):
            if not (mark[a, c] == ARROW and mark[c, a] == CIRCLE):
                continue
            between = [b for b in g.near(a) if b != c and g.directed(b, c)]
            if any(mark[b, a] == TAIL and mark[a, b] in (ARROW, CIRCLE) for b in between):  # 8
                m.put(c, a, TAIL)
                continue
            if any(not g.is_edge(p[1], c) for p in uncovered_paths(g, a, c, onward)):  # 9
                m.put(c, a, TAIL)
                continue
            parents = [b for b in g.near(c) if b != a and g.directed(b, c)]
            starts = {b: {b} if g.is_edge(a, b) and onward(a, b) else set() for b in parents}  # the first nodes of uncovered ways to each parent
            for b in parents:
                starts[b] |= {p[1] for p in uncovered_paths(g, a, b, onward)}
            if any(x != y and not g.is_edge(x, y) for b, d in combinations(parents, 2) for x in starts[b] for y in starts[d]):  # 10
                m.put(c, a, TAIL)


def pag_to_dag(g: MixedGraph) -> CausalGraph:
    """Directed edges stay, bidirected ones become a latent common cause U_a_b, others go; cycles lose their closing edge."""
    out = CausalGraph(set(g.nodes))
    for a, b in combinations(sorted(g.nodes), 2):
        if g.directed(a, b):
            out.add(a, b)
        elif g.directed(b, a):
            out.add(b, a)
        elif g.is_edge(a, b) and g.marks[a, b] == g.marks[b, a] == ARROW:
            u = f"U_{a}_{b}"
            out.latent.add(u)
            out.add(u, a), out.add(u, b)
    return out.without_cycles()


def fci(df: DataFrame, columns: list[str], alpha: float = 0.05, test: str = "fisherz") -> CausalGraph:
    return pag_to_dag(fci_from(columns, independence(df, columns, alpha, test)))


def local_bic(m: Moments, y: str, parents) -> float:
    """-(n/2) ln(RSS/n) - (number of parents / 2) ln n."""
    ps = sorted(parents)
    inv, _ = scaled_inverse(m.part(ps, ps))
    xy = m.part(ps, [y])[:, 0] if ps else np.zeros(0)
    rss = max(float(m.part([y], [y])[0, 0]) - float(xy @ inv @ xy if ps else 0.0), 1e-300)
    return -(m.n / 2) * math.log(rss / m.n) - len(ps) / 2 * math.log(m.n)


def cpdag(g: CausalGraph) -> tuple[set, set]:
    """The equivalence class of a DAG: its colliders' edges directed, then Meek's rules."""
    fixed = set()
    for c in g.nodes:
        for a, b in combinations(sorted(g.parents(c)), 2):
            if not g.has(a, b) and not g.has(b, a):
                fixed |= {(a, c), (b, c)}
    return meek(fixed, {frozenset(e) for e in g.weights if e not in fixed})


def extension(nodes, directed: set, undirected: set) -> CausalGraph | None:
    """A DAG of the class (Dor and Tarsi), or None."""
    out, d, u, left = CausalGraph(set(nodes)), set(directed), set(undirected), set(nodes)
    for e in directed:
        out.add(*e)
    while left:
        adjacent = lambda v: {y for e in d for y in e if v in e} | {y for e in u for y in e if v in e}
        for v in sorted(left):
            mates = {y for e in u for y in e if v in e} - {v}
            if not any(a == v for a, _ in d) and all((adjacent(v) - {v, y}) <= adjacent(y) for y in mates):
                for y in mates:
                    out.add(y, v)
                d = {e for e in d if v not in e}
                u = {e for e in u if v not in e}
                left.discard(v)
                break
        else:
            return None
    return out


def cliques_with(base: set[str], pool: list[str], adjacent):
    """Subsets of pool (as sets) that are a clique together with base, each once; a set is only enlarged while it is one."""
    if not all(adjacent(a, b) for a, b in combinations(sorted(base), 2)):
        return
    todo = [(frozenset(), [p for p in pool if all(adjacent(p, b) for b in base)])]
    while todo:
        chosen, left = todo.pop()
        yield set(chosen)
        for i, p in enumerate(left):
            todo.append((chosen | {p}, [q for q in left[i + 1 :] if adjacent(p, q)]))


def ges_from(m: Moments, columns: list[str]) -> tuple[set, set]:
    """Greedy equivalence search: best valid insertion until none raises the score, then best valid deletion.

    An operator's subsets of neighbours are those that leave a clique, of any size; they are found by growing cliques."""
    nodes, directed, undirected = sorted(columns), set(), set()
    memo: dict[tuple, float] = {}

    def score(y: str, ps) -> float:
        key = (y, frozenset(ps))
        if key not in memo:
            memo[key] = local_bic(m, y, ps)
        return memo[key]

    def adjacent(a, b):
        return (a, b) in directed or (b, a) in directed or frozenset((a, b)) in undirected

    for inserting in (True, False):
        while True:
            best = (1e-9, None)
            for x in nodes:
                for y in nodes:
                    if x == y or adjacent(x, y) == inserting or (not inserting and (y, x) in directed):
                        continue
                    mates = {next(iter(e - {y})) for e in undirected if y in e} - {x}
                    na = {z for z in mates if adjacent(z, x)}
                    parents = {a for a, b in directed if b == y} - {x}
                    for part in cliques_with(na, sorted(mates - na), adjacent) if inserting else cliques_with(set(), sorted(na), adjacent):
                        clique, s = (na | part, part) if inserting else (part, na - part)
                        gain = score(y, clique | parents | {x}) - score(y, clique | parents)
                        gain = gain if inserting else -gain
                        if gain <= best[0]:
                            continue
                        d, u = set(directed), set(undirected)
                        if inserting:
                            d |= {(x, y)} | {(t, y) for t in s}
                            u -= {frozenset((t, y)) for t in s}
                        else:
                            d -= {(x, y)}
                            u -= {frozenset((x, y))} | {frozenset((h, z)) for h in s for z in (x, y)}
                            d |= {(z, h) for h in s for z in (x, y) if frozenset((h, z)) in undirected}
                        dag = extension(nodes, d, u)
                        if dag is not None:
                            best = (gain, dag)
            if best[1] is None:
                break
            directed, undirected = cpdag(best[1])
    return directed, undirected


def ges(df: DataFrame, columns: list[str]) -> CausalGraph:
    return to_dag(sorted(columns), *ges_from(moments(df, columns), columns))


def expm(a: np.ndarray) -> np.ndarray:
    s = max(0, math.ceil(math.log2(max(1e-16, np.abs(a).sum(axis=1).max()))) + 1)
    x, term, out = a / 2**s, np.eye(len(a)), np.eye(len(a))
    for k in range(1, 20):
        term = term @ x / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


def notears_from(cov: np.ndarray, lam: float = 0.01, most: int = 100, threshold: float = 0.3) -> np.ndarray:
    """Linear NOTEARS on a covariance matrix: augmented Lagrangian around proximal gradient steps. w[i, j]: i causes j."""
    d = len(cov)
    w, rho, alpha, h = np.zeros((d, d)), 1.0, 0.0, math.inf
    eye = np.eye(d)
    acyclic = lambda v: float(np.trace(expm(v * v)) - d) if (v * v).sum(axis=1).max() < 200 else math.inf  # noqa: E731  beyond, a step is too long anyway
    for _ in range(most):
        while rho < 1e16:
            v, step = w.copy(), 1.0

            def smooth(x, rho=rho):
                hx = acyclic(x)
                if not math.isfinite(hx):
                    return math.inf
                return 0.5 * float(np.trace((eye - x).T @ cov @ (eye - x))) + alpha * hx + 0.5 * rho * hx * hx

            for _ in range(500):
                hx = acyclic(v)
                grad = -cov @ (eye - v) + (alpha + rho * hx) * expm(v * v).T * 2 * v
                np.fill_diagonal(grad, 0)
                now = smooth(v)
                while True:
                    x = v - step * grad
                    x = np.sign(x) * np.maximum(np.abs(x) - step * lam, 0)
                    delta = x - v
                    if step < 1e-14 or smooth(x) <= now + float((grad * delta).sum()) + float((delta * delta).sum()) / (2 * step):
                        break
                    step /= 2
                v, moved, step = x, float(np.abs(delta).max()), step * 1.5
                if moved < 1e-7:
                    break
            new = acyclic(v)
            if new <= 0.25 * h:
                break
            rho *= 10
        w, h = v, new
        alpha += rho * h
        if h <= 1e-8 or rho >= 1e16:
            break
    return np.where(np.abs(w) > threshold, w, 0.0)


def notears(df: DataFrame, columns: list[str], lam: float = 0.01, most: int = 100, threshold: float = 0.3) -> CausalGraph:
    names = sorted(columns)
    w = notears_from(moments(df, names).covariance(), lam, most, threshold)
    g = CausalGraph(set(names))
    for i, j in np.argwhere(w != 0):
        g.add(names[i], names[j], float(w[i, j]))
    return g.without_cycles()


def entropy(log_cosh: float, gauss: float) -> float:
    """Approximate entropy of a standardised variable from two expectations."""
    return (1 + math.log(2 * math.pi)) / 2 - 79.047 * (log_cosh - 0.37457) ** 2 - 7.4129 * gauss**2


def lingam_order(df: DataFrame, columns: list[str]) -> tuple[list[str], Moments]:
    """A causal order (DirectLiNGAM): each round one aggregate over all residual pairs of what is left."""
    names = sorted(columns)
    m = moments(df, names)
    rows = complete(df, names).select([(F.col(f"`{c}`") - float(m.mean([c])[0])).alias(c) for c in names]).persist()
    left = {c: np.eye(len(names))[i] for i, c in enumerate(names)}  # residuals as combinations of the columns
    cov, order = m.cross / max(1, m.n), []
    try:
        while len(left) > 1:
            var = lambda a, b: float(a @ cov @ b)
            wanted: dict[tuple, np.ndarray] = {}
            for c, v in left.items():
                wanted[c, None] = v
                for e, u in left.items():
                    if c != e:
                        wanted[c, e] = v - var(v, u) / max(var(u, u), 1e-300) * u
            cols, keys = [], list(wanted)
            for k, key in enumerate(keys):
                v = wanted[key] / math.sqrt(max(var(wanted[key], wanted[key]), 1e-300))
                x = sum((F.col(f"`{c}`") * float(b) for c, b in zip(names, v, strict=True) if b), F.lit(0.0))
                cols += [F.avg(F.abs(x) + F.log1p(F.exp(-2 * F.abs(x))) - math.log(2)).alias(f"l{k}"), F.avg(x * F.exp(-x * x / 2)).alias(f"g{k}")]
            row = {}
            for at in range(0, len(cols), 200):
                row |= rows.agg(*cols[at : at + 200]).first().asDict()
            h = {key: entropy(row[f"l{k}"], row[f"g{k}"]) for k, key in enumerate(keys)}
            fit = lambda c: -sum(min(0.0, (h[e, None] + h[c, e]) - (h[c, None] + h[e, c])) ** 2 for e in left if e != c)
            first = max(sorted(left), key=fit)
            order.append(first)
            u = left.pop(first)
            left = {c: v - var(v, u) / max(var(u, u), 1e-300) * u for c, v in left.items()}
        order += list(left)
    finally:
        rows.unpersist()
    return order, m


def lingam(df: DataFrame, columns: list[str], least: float = 0.05) -> CausalGraph:
    """Edges from earlier to later columns of the order whose standardised regression weight is not small."""
    order, m = lingam_order(df, columns)
    g = CausalGraph(set(order))
    for k in range(1, len(order)):
        ps = order[:k]
        inv, _ = scaled_inverse(m.part(ps, ps))
        b = inv @ m.part(ps, [order[k]])[:, 0]
        sd = math.sqrt(float(m.part([order[k]], [order[k]])[0, 0])) or 1.0
        for p, w in zip(ps, b, strict=True):
            if abs(w) * math.sqrt(float(m.part([p], [p])[0, 0])) / sd > least:
                g.add(p, order[k], float(w))
    return g


#: G of the kernels exp(-g * squared distance) that are added up.
BANDWIDTHS = (0.01, 0.1, 1.0, 10.0, 100.0)
FEATURES = 64  # random frequencies of each kernel


def mmd(a: np.ndarray, b: np.ndarray) -> float:
    """Squared maximum mean discrepancy with a sum of Gaussian kernels (biased), from all pairs: for small tables."""
    def k(x, y):
        d = ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1)
        return sum(np.exp(-g * d) for g in BANDWIDTHS).mean()

    return float(k(a, a) + k(b, b) - 2 * k(a, b))


def frequencies(width: int, features: int = FEATURES, seed: int = 0) -> np.ndarray:
    """Frequencies of each kernel's random Fourier features, (kernels, features, width): normal with variance 2 g."""
    rng = np.random.default_rng(seed)
    return np.sqrt(2 * np.array(BANDWIDTHS))[:, None, None] * rng.standard_normal((len(BANDWIDTHS), features, width))


def mmd_features(a: DataFrame, b: DataFrame, features: int = FEATURES, seed: int = 0) -> tuple[float, float]:
    """(mmd, its standard error) of two whole tables of as many numeric columns, linear in rows.

    A Gaussian kernel is the mean of cos(w * difference) over normal frequencies w, so each frequency gives the squared
    distance of two mean points on the unit circle. Averages of sines and cosines are one aggregate; the error, from the spread over frequencies, falls with the root of their number, whatever the tables' sizes."""
    width = len(a.columns)
    w = frequencies(width, features, seed).reshape(len(BANDWIDTHS) * features, -1)
    names = [f"x{i}" for i in range(width)]
    both = complete(a.toDF(*names), names).withColumn("side", F.lit(0)).unionByName(complete(b.toDF(*names), names).withColumn("side", F.lit(1)))
    waves = F.array(*[F.struct(F.lit(j).alias("j"), *[F.lit(float(c)).alias(f"w{i}") for i, c in enumerate(row)]) for j, row in enumerate(w)])
    each = both.select("side", *names, F.explode(waves).alias("w"))
    angle = reduce(lambda t, i: t + F.col(f"x{i}") * F.col(f"w.w{i}"), range(1, width), F.col("x0") * F.col("w.w0"))
    means = each.select("side", F.col("w.j").alias("j"), angle.alias("angle")).groupBy("side", "j").agg(F.avg(F.cos("angle")).alias("c"), F.avg(F.sin("angle")).alias("s"))
    centre = np.full((2, len(w), 2), np.nan)
    for r in means.collect():  # one row for each frequency and table
        centre[r["side"], r["j"]] = r["c"], r["s"]
    each = ((centre[0] - centre[1]) ** 2).sum(axis=1).reshape(len(BANDWIDTHS), features)
    return float(each.mean(axis=1).sum()), float(np.sqrt((each.var(axis=1, ddof=1) / features).sum()))


def joint_loss(data: np.ndarray, parents: list[list[int]], hidden: int, seed: int, steps: int = 150) -> float:
    """Discrepancy between data and what generators of a whole graph make, after fitting them together to it.

    Each node is a net with one hidden layer of its parents' generated values and noise of its own; parents come first in
    order. The gradient of the discrepancy runs back through all nets."""
    n, p = data.shape
    rng = np.random.default_rng(seed)
    nets = [{"w": rng.normal(size=(len(ps) + 1, hidden)), "b": rng.normal(size=hidden), "v": rng.normal(size=hidden) / hidden, "c": np.zeros(1)} for ps in parents]
    first = [{k: np.zeros_like(x) for k, x in net.items()} for net in nets]
    second = [{k: np.zeros_like(x) for k, x in net.items()} for net in nets]

    def made() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        out, inner, noise = np.zeros((n, p)), [], rng.normal(size=(n, p))
        for i, ps in enumerate(parents):
            u = np.column_stack([out[:, ps], noise[:, i]])
            a = np.maximum(u @ nets[i]["w"] + nets[i]["b"], 0)
            out[:, i] = a @ nets[i]["v"] + nets[i]["c"]
            inner.append((u, a))
        return out, inner

    def pull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each row of x: the sum over y of kernels, weighted by their steepness, times the difference."""
        d = np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T)
        k = sum(g * np.exp(-g * d) for g in BANDWIDTHS)
        return k.sum(1)[:, None] * x - k @ y

    for t in range(1, steps + 1):
        x, inner = made()
        grad = 4 / n**2 * (pull(x, data) - pull(x, x))
        for i in reversed(range(p)):
            (u, a), net = inner[i], nets[i]
            back = np.outer(grad[:, i], net["v"]) * (a > 0)
            slopes = {"w": u.T @ back, "b": back.sum(0), "v": a.T @ grad[:, i], "c": grad[:, i].sum(keepdims=True)}
            if parents[i]:
                grad[:, parents[i]] += (back @ net["w"].T)[:, :-1]
            for k, s in slopes.items():
                first[i][k], second[i][k] = 0.9 * first[i][k] + 0.1 * s, 0.999 * second[i][k] + 0.001 * s * s
                net[k] -= 0.02 * first[i][k] / (1 - 0.9**t) / (np.sqrt(second[i][k] / (1 - 0.999**t)) + 1e-12)
    return float(np.mean([mmd(made()[0], data) for _ in range(5)]))


HIDDEN = (5, 10, 20, 30, 40, 60)
LEAST_RUNS, MOST_RUNS, REPEATS = 8, 128, 3
MOST_VARIATION, LEAST_GAIN = 0.05, 1e-3


class _Trials:
    """Fits of graphs' generators, each a row that some executor works on."""

    def __init__(self, spark, data: np.ndarray):
        self.spark, self.data, self.known = spark, data, {}

    def losses(self, asked: list[tuple[tuple[tuple[int, int], ...], int, int]]) -> list[float]:
        """Of (edges, hidden units, seed), each fitted once. Edges name columns; columns without edges take no part."""
        new = [a for a in dict.fromkeys(asked) if a not in self.known]
        data = self.data

        def fit(batches):
            for pdf in batches:
                out = []
                for edges, hidden, seed in zip(pdf["edges"], pdf["hidden"], pdf["seed"], strict=True):
                    pairs = [tuple(map(int, e)) for e in edges]
                    g = CausalGraph.from_edges(pairs)
                    order = g.order()
                    at = {c: i for i, c in enumerate(order)}
                    out.append(joint_loss(data[:, order], [sorted(at[q] for q in g.parents(c)) for c in order], int(hidden), int(seed)))
                yield pdf[["trial"]].assign(loss=out)

        if new:
            rows = [(i, [list(e) for e in edges], hidden, seed) for i, (edges, hidden, seed) in enumerate(new)]
            trials = self.spark.createDataFrame(rows, "trial int, edges array<array<int>>, hidden int, seed int").repartition(min(len(rows), 256))
            for r in trials.mapInPandas(fit, "trial int, loss double").collect():  # one number for each trial
                self.known[new[r["trial"]]] = r["loss"]
        return [self.known[a] for a in asked]

    def scores(self, graphs: list[tuple], hidden: int, runs: int, start: int = 0) -> list[float]:
        """Mean loss of each graph over runs of the same seeds."""
        found = iter(self.losses([(g, hidden, start + k) for g in graphs for k in range(runs)]))
        return [float(np.mean([next(found) for _ in range(runs)])) for _ in graphs]


def _tuned_hidden(trials: _Trials, edges: tuple, choices, runs: int) -> int:
    """More units while they lower the loss by more than LEAST_GAIN."""
    best, chosen = math.inf, choices[0]
    for h in choices:
        (loss,) = trials.scores([edges], h, runs)
        if loss >= best - LEAST_GAIN:
            break
        best, chosen = loss, h
    return chosen


def _tuned_runs(trials: _Trials, edges: tuple, hidden: int, most: int) -> int:
    """More runs until the mean varies by at most MOST_VARIATION over REPEATS repetitions."""
    runs = LEAST_RUNS
    while runs < most:
        means = [trials.scores([edges], hidden, runs, start=1000 * (k + 1))[0] for k in range(REPEATS)]
        if np.std(means, ddof=1) <= MOST_VARIATION * np.mean(means):
            break
        runs *= 2
    return min(runs, most)


def cgnn(df: DataFrame, columns: list[str], hidden=HIDDEN, most_runs: int = MOST_RUNS, most_rows: int = 100, key: list[str] | None = None) -> CausalGraph:
    """Orientation of a complete skeleton by generators of the whole graph, for tables of few rows (a bounded, hash-ordered sample).

    Pairs are oriented by generators of two columns, the clearest first, then hidden units and runs are tuned on that graph, and
    single edges are turned while the graph's discrepancy falls. All fits of a step are rows of one job."""
    names = sorted(columns)
    rows = complete(df, names).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in (key or names)])).limit(most_rows).toPandas().to_numpy(dtype=float)
    g = CausalGraph(set(names))
    if len(rows) < 2 or len(names) < 2:
        return g
    sd = rows.std(axis=0)
    trials = _Trials(df.sparkSession, (rows - rows.mean(axis=0)) / np.where(sd > 0, sd, 1))
    pairs = list(combinations(range(len(names)), 2))
    found = trials.scores([(e,) for i, j in pairs for e in ((i, j), (j, i))], hidden[0], LEAST_RUNS)
    gap = {p: found[2 * k] - found[2 * k + 1] for k, p in enumerate(pairs)}  # below 0: the first causes the second
    draft = CausalGraph(set(range(len(names))))
    for i, j in sorted(pairs, key=lambda p: -abs(gap[p])):
        a, b = (i, j) if gap[i, j] <= 0 else (j, i)
        draft.add(*((a, b) if a not in draft.descendants(b) else (b, a)))
    units = _tuned_hidden(trials, tuple(sorted(draft.weights)), hidden, LEAST_RUNS)
    runs = _tuned_runs(trials, tuple(sorted(draft.weights)), units, most_runs)
    (best,) = trials.scores([tuple(sorted(draft.weights))], units, runs)
    while True:
        turned = []
        for a, b in sorted(draft.weights):
            h = draft.copy()
            h.drop(a, b), h.add(b, a)
            if h.is_dag():
                turned.append(h)
        losses = trials.scores([tuple(sorted(h.weights)) for h in turned], units, runs)
        if not losses or min(losses) >= best:
            break
        best, draft = min(losses), turned[int(np.argmin(losses))]
    for a, b in draft.weights:
        g.add(names[a], names[b], abs(gap[min(a, b), max(a, b)]))
    return g


ALGORITHMS = {"PC": pc, "FCI": fci, "GES": ges, "LiNGAM": lingam, "NOTEARS": notears, "CGNN": cgnn}


def discover(df: DataFrame, columns: list[str], latent: bool = False, algorithm: str | None = None, key: list[str] | None = None) -> tuple[str, CausalGraph]:
    """(algorithm, graph): the algorithm of the decision table, or the one that is named."""
    from causeway.operators.likelihood import detect_family
    from causeway.plans.planner import discovery_algorithm

    if algorithm is None:
        algorithm = discovery_algorithm(latent, detect_family(df, key).family, df.count(), len(columns))
    return algorithm, ALGORITHMS[algorithm](df, columns)
