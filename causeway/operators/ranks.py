"""Order over whole tables: running totals, order statistics and leads, in tasks of bounded size.

A table is dealt by ranges of its order and written; what a range needs from those before it (their totals) or behind it
(their first rows) is a few rows for each range. No window runs without a partition, and none over a whole group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.moments import as_double
from causeway.sources.tables import checkpointed

BINS = 1024  # of one step of a search for order statistics


def blocks(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """df in ranges of the order, written: with block (the range's number) and place (in its range), which together are the order.

    Rows that are equal in the order lie in one range, so an order of few values needs something that tells rows apart."""
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.monotonically_increasing_id()  # the partition's number, 33 bits lower the row's
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return checkpointed(ranged.select("*", F.shiftright(number, 33).alias("block"), number.bitwiseAND((1 << 33) - 1).alias("place")))


def running(df: DataFrame, order: list[Column], amounts: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with, under each name, the sum of the amount over all rows before."""
    ranged = blocks(df.select("*", *[a.alias(n) for n, a in amounts.items()]), order, parts)
    sums = ranged.groupBy("block").agg(*[F.sum(n).alias(n) for n in amounts]).collect()  # one row for each range
    before, rows = dict.fromkeys(amounts, 0), []
    for r in sorted(sums, key=lambda r: r["block"]):
        rows.append((r["block"], *before.values()))
        before = {n: before[n] + (r[n] or 0) for n in amounts}
    kinds = dict(ranged.dtypes)
    start = df.sparkSession.createDataFrame(rows, "__block long, " + ", ".join(f"__{n} {kinds[n]}" for n in amounts))
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(start), F.col("block") == F.col("__block"))  # one row for each range
    total = [(F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"__{n}")).alias(n) for n in amounts]
    return placed.select(*[c for c in df.columns if c not in amounts], *total)


def value_totals(df: DataFrame, column: str) -> DataFrame:
    """value, n (rows with it), below (rows with a smaller one) of each distinct number of a column."""
    found = df.select(as_double(column).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return running(found, [F.col("value")], {"below": F.col("n")})


@dataclass
class _Range:
    """A range of values that holds the wanted ranks, and how many values lie below it."""

    low: float
    high: float
    below: int
    ranks: list[int]


def order_statistics(df: DataFrame, column: str, ranks: list[int] | None = None, shares: list[float] | None = None) -> list[float]:
    """The values of given ranks (from 0), or at given shares as numpy's linear quantiles have it, exactly.

    Each step counts BINS bins of every range in which a rank still is open, with the least and largest value of each, in
    one aggregate; a range with one value is done. No row leaves its partition."""
    x = as_double(column)
    rows = df.select(x.alias("x")).where("x is not null")
    about = rows.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n = about["n"]
    if not n:
        return [math.nan] * len(ranks or shares or [])
    places = [s * (n - 1) for s in shares or []]
    wanted = sorted({*(min(max(0, r), n - 1) for r in ranks or []), *(math.floor(p) for p in places), *(math.ceil(p) for p in places)})
    found: dict[int, float] = {}
    todo = [_Range(about["lo"], about["hi"], 0, wanted)]
    while todo:
        for r in [r for r in todo if r.low == r.high]:
            found |= dict.fromkeys(r.ranks, r.low)
        todo = [r for r in todo if r.low < r.high]
        if not todo:
            break
        bin_of, number = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, r in enumerate(todo):
            inside = F.col("x").between(F.lit(r.low), F.lit(r.high))
            # halves keep the width finite; the last bin takes what rounding would put behind it
            at = F.least(F.lit(BINS - 1), F.floor((F.col("x") / 2 - r.low / 2) / (r.high / 2 - r.low / 2) * BINS)).cast("int")
            bin_of, number = F.when(inside, at).otherwise(bin_of), F.when(inside, F.lit(i)).otherwise(number)
        counted = rows.select("x", number.alias("range"), bin_of.alias("bin")).where("range is not null").groupBy("range", "bin")
        bins = sorted(counted.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda b: (b["range"], b["bin"]))  # BINS rows a range
        following = []
        for i, r in enumerate(todo):
            below = r.below
            for b in (b for b in bins if b["range"] == i):
                if here := [k for k in r.ranks if below <= k < below + b["n"]]:
                    following.append(_Range(b["lo"], b["hi"], below, here))
                below += b["n"]
        todo = following
    if ranks is not None:
        return [found[min(max(0, r), n - 1)] for r in ranks]
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def leads(df: DataFrame, group: str, order: list[str], value: Column, names: list[str], parts: int | None = None) -> DataFrame:
    """df with names[k]: the value k + 1 rows later in the order of the group, null behind its last row.

    Rows are dealt by ranges of (group, order), so a group of any size is spread; each range is handed the first rows that
    come behind it. Rows that are equal in group and order are told apart by a hash of the whole row."""
    most = len(names)
    keys = [F.col(f"`{c}`") for c in (group, *order)]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    ranged = blocks(df.select("*", value.alias("__value"), F.col(f"`{group}`").alias("__group"), tie.alias("__tie")), [*keys, F.col("__tie")], parts)
    heads = ranged.where(F.col("place") < most).select("block", "place", "__group", "__value").collect()  # at most `most` rows a range
    heads.sort(key=lambda r: (r["block"], r["place"]))
    handed = []
    for at, r in enumerate(heads):
        if at + 1 == len(heads) or heads[at + 1]["block"] != r["block"]:  # what follows is the first rows of the ranges behind
            handed += [(r["block"], (1 << 40) + i, h["__group"], h["__value"], True) for i, h in enumerate(heads[at + 1 : at + 1 + most])]
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema}
    border = df.sparkSession.createDataFrame(handed, f"block long, place long, __group {kinds['__group']}, __value {kinds['__value']}, __border boolean")
    both = ranged.withColumn("__border", F.lit(False)).unionByName(border, allowMissingColumns=True)
    inside = Window.partitionBy("block").orderBy("place")
    ahead = [F.when(F.lead("__group", k + 1).over(inside).eqNullSafe(F.col("__group")), F.lead("__value", k + 1).over(inside)).alias(n) for k, n in enumerate(names)]
    return both.select(*[F.col(f"`{c}`") for c in df.columns], "__border", *ahead).where("not __border").drop("__border")
