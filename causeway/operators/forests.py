"""Random forests over binned covariates, for all folds of a cross-fit from one pass over the rows.

A tree splits between bins and needs the weights and weighted sums of its bootstrap by cell of bins, no rows. A row has one
bootstrap weight in each tree, whatever the fold: outside a fold, a tree's sums are those of all folds less the fold's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32  # of a covariate, as in MLlib
DEPTH = 5  # as in MLlib
CELLS = 1 << 16  # folds times cells, of which each task keeps the sums in all trees
#: Distribution function of the bootstrap's weights, Poisson with mean 1, up to where a double ends.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])[:-1]


def thresholds(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Where each column can be split (values up to a threshold go left): between all values if they are few, else at quantiles."""
    kinds = [rows.select(F.col(f"`{c}`").alias("v")).distinct().limit(BINS + 1).collect() for c in columns]  # BINS + 1 rows
    few = [sorted(r["v"] for r in got) for got in kinds]
    wide = [c for c, v in zip(columns, few, strict=True) if len(v) > BINS]
    at = dict(zip(wide, rows.approxQuantile(wide, [i / BINS for i in range(1, BINS)], 1 / (8 * BINS)) if wide else [], strict=True))
    return [sorted(set(at[c])) if c in at else [a / 2 + b / 2 for a, b in zip(v, v[1:], strict=False)] for c, v in zip(columns, few, strict=True)]


def cell_count(cuts: list[list[float]]) -> int:
    return math.prod(len(c) + 1 for c in cuts)


def cell(columns: list[str], cuts: list[list[float]]) -> Column:
    """The number of the row's cell: its bins as digits."""

    @F.pandas_udf("int")
    def number(values: pd.DataFrame) -> pd.Series:
        out = np.zeros(len(values), dtype=np.int32)
        for i, c in enumerate(cuts):
            out = out * (len(c) + 1) + np.searchsorted(c, values.iloc[:, i].to_numpy(), side="left").astype(np.int32)
        return pd.Series(out)

    return number(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])) if columns else F.lit(0)


def weights(hashes: np.ndarray, tree: int) -> np.ndarray:
    """Poisson weights of rows in a tree, from the rows' hashes: the same whatever task a row is in."""
    z = hashes + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    uniform = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(POISSON, uniform, side="right").astype(float)


def bootstrap_sums(rows: DataFrame, outcome: str, shift: float, cells: int, k: int, trees: int) -> DataFrame:
    """tree, at (fold times cells plus cell), n, s: of each tree's bootstrap, its weight and its sum of outcomes less shift."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros((trees, k * cells)), np.zeros((trees, k * cells))
        for b in batches:
            at, y, h = b["at"].to_numpy(), b["y"].to_numpy(), b["h"].to_numpy().astype(np.uint64)
            seen, place = np.unique(at, return_inverse=True)
            for t in range(trees):
                w = weights(h, t)
                n[t, seen] += np.bincount(place, w, len(seen))
                s[t, seen] += np.bincount(place, w * y, len(seen))
        for t in range(trees):
            at = np.flatnonzero(n[t])
            if len(at):
                yield pd.DataFrame({"tree": t, "at": at, "n": n[t, at], "s": s[t, at]})

    asked = rows.select((F.col("__fold") * cells + F.col("__cell")).alias("at"), (F.col(f"`{outcome}`") - shift).alias("y"), F.col("__hash").alias("h"))
    return asked.mapInPandas(summed, "tree int, at long, n double, s double").groupBy("tree", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def grown(n: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A regression tree's value of every cell, from its weights and sums (an axis for each covariate).

    Nodes are boxes of cells. Each looks at a random third of the covariates and takes the split with the largest gain."""
    out, p = np.empty(n.shape), n.ndim
    todo = [(tuple(slice(0, m) for m in n.shape), 0)]
    while todo:
        box, depth = todo.pop()
        weight, total = n[box].sum(), s[box].sum()
        best = (1e-12 * max(1.0, abs(total)), None, 0)
        for a in rng.permutation(p)[: math.ceil(p / 3)] if depth < DEPTH else ():
            others = tuple(i for i in range(p) if i != a)
            left, sl = n[box].sum(axis=others).cumsum()[:-1], s[box].sum(axis=others).cumsum()[:-1]
            right = weight - left
            ok = (left > 0.5) & (right > 0.5)  # weights are whole numbers
            if ok.any():
                gain = np.where(ok, sl**2 / np.where(ok, left, 1) + (total - sl) ** 2 / np.where(ok, right, 1), -np.inf) - total**2 / weight
                c = int(gain.argmax())
                if gain[c] > best[0]:
                    best = (float(gain[c]), int(a), box[a].start + c + 1)
        if best[1] is None:
            out[box] = total / weight if weight else 0.0
            continue
        a, cut = best[1:]
        for half in (slice(box[a].start, cut), slice(cut, box[a].stop)):
            todo.append(((*box[:a], half, *box[a + 1 :]), depth + 1))
    return out


def fitted(rows: DataFrame, outcome: str, cuts: list[list[float]], k: int, trees: int, seed: int) -> DataFrame:
    """__fold, __cell, __l: what the forest that is grown without the fold says in the cell.

    rows have __fold, __cell and __hash. A task grows one tree's k versions from at most CELLS sums."""
    cells, shape = cell_count(cuts), tuple(len(c) + 1 for c in cuts) or (1,)
    shift = float(rows.agg(F.avg(f"`{outcome}`").alias("m")).first()["m"] or 0.0)

    def grow(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        n, s = np.zeros(k * cells), np.zeros(k * cells)
        at = sums["at"].to_numpy()
        n[at], s[at] = sums["n"].to_numpy(), sums["s"].to_numpy()
        n, s = n.reshape(k, cells), s.reshape(k, cells)
        said = [grown((n.sum(axis=0) - n[f]).reshape(shape), (s.sum(axis=0) - s[f]).reshape(shape), np.random.default_rng([seed, int(key[0]), f])).ravel() for f in range(k)]
        return pd.DataFrame({"__fold": np.repeat(np.arange(k), cells), "__cell": np.tile(np.arange(cells), k), "said": np.concatenate(said) + shift})

    each = bootstrap_sums(rows, outcome, shift, cells, k, trees).groupBy("tree").applyInPandas(grow, "__fold int, __cell int, said double")
    return each.groupBy("__fold", "__cell").agg(F.avg("said").alias("__l"))
