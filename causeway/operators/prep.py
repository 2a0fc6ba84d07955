"""Preparation: missing values, encoding of texts, pruning of redundant columns.

Each step computes its statistics in one or two aggregates and returns a lazy projection or filter of its input. What
is asked of texts (modes, cardinality, yes and no, dictionaries) comes from one table of value counts.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators.moments import moments
from causeway.operators.ranks import running
from causeway.sources.tables import checkpointed, is_missing, numeric_columns

POSITIVE, NEGATIVE = ("true", "yes", "y"), ("false", "no", "n")
BROADCAST_CODES = 200_000  # entries of a dictionary that are sent to every task; beyond, the join shuffles
DROP_SHARE, ENCODE_SHARE, DEFAULT_ENCODE_SHARE, CORRELATED = 0.5, 0.05, 0.1, 0.9


def any_missing(df: DataFrame):
    return reduce(lambda a, b: a | b, [is_missing(df, c) for c in df.columns], F.lit(False))


def missing_profile(df: DataFrame) -> DataFrame:
    """n, n_missing (rows with any missing value), share (null without rows)."""
    out = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(any_missing(df).cast("long")), F.lit(0)).alias("n_missing"))
    return out.withColumn("share", F.try_divide("n_missing", "n"))


def drop_missing(df: DataFrame) -> DataFrame:
    return df.where(~any_missing(df))


def impute_mean(df: DataFrame) -> DataFrame:
    """Missing values of numeric columns become the column's mean; imputed columns are doubles."""
    columns = numeric_columns(df)
    present = lambda c: F.when(~is_missing(df, c), F.col(f"`{c}`").cast("double"))
    means = df.agg(*[F.avg(present(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first() if columns else {}
    at = {c: means[f"m{i}"] for i, c in enumerate(columns)}
    return df.select([F.coalesce(present(c), F.lit(at[c])).alias(c) if c in at else F.col(f"`{c}`") for c in df.columns])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text; null for missing), n: how often each value of each column occurs, written.

    One aggregate for all columns. It counts in each task before it shuffles, so a value that most rows share is
    one row a task."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return checkpointed(df.select(F.explode(each).alias("v")).groupBy("v.column", "v.value").agg(F.count("*").alias("n")))


class About(NamedTuple):
    """What a column's value counts tell of it."""

    values: int  # a missing one counts as one
    mode: str | None
    yes: bool  # whether all values are texts for yes or no; one missing value makes a column none of these


def about_values(counts: DataFrame) -> dict[str, About]:
    """Of each column of value counts, in one job. The mode is the smallest of the most frequent values."""
    inside = F.coalesce(F.lower(F.trim("value")).isin(*POSITIVE, *NEGATIVE), F.lit(False))
    first = F.min(F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("first")
    rows = counts.groupBy("column").agg(F.count("*").alias("values"), first, F.bool_and(inside).alias("yes")).collect()  # one row for each column
    return {r["column"]: About(r["values"], r["first"]["value"] if r["first"] else None, r["yes"]) for r in rows}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value of each column as text, the smallest where several are; None without values."""
    return dict.fromkeys(columns) | {c: a.mode for c, a in about_values(value_counts(df, columns)).items()}


def impute_mode(df: DataFrame) -> DataFrame:
    """Missing values of columns of text, booleans and times become the most frequent value; columns of other types stay."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    at = modes(df, columns)
    kind = dict(df.dtypes)
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit(at[c]).cast(kind[c])).alias(c) if at.get(c) is not None and c in columns else F.col(f"`{c}`") for c in df.columns])


def handle_missing(df: DataFrame, threshold: float = DROP_SHARE) -> DataFrame:
    """Complete rows only, if at most the threshold's share of rows is incomplete; else imputed."""
    share = missing_profile(df).first()["share"]
    if share is None or share <= threshold:
        return drop_missing(df)
    return impute_mode(impute_mean(df))


def text_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [f.name for f in df.schema if f.name not in numeric and isinstance(f.dataType, (T.StringType, T.BooleanType))]


def cardinality(df: DataFrame, threshold: float = ENCODE_SHARE) -> DataFrame:
    """column, distinct_values (missing is one), share of rows, encode: whether a column has few enough values."""
    columns = text_columns(df)
    each = [(F.count_distinct(F.col(f"`{c}`")) + F.max(F.col(f"`{c}`").isNull().cast("int"))).alias(f"d{i}") for i, c in enumerate(columns)]
    packed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").cast("long").alias("distinct_values")) for i, c in enumerate(columns)])
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, distinct_values long, share double, encode boolean")
    out = df.agg(F.count("*").alias("n"), *each).select("n", F.explode(packed).alias("p")).select("p.column", "p.distinct_values", F.try_divide("p.distinct_values", "n").alias("share"))
    return out.withColumn("encode", F.coalesce(F.col("share") <= threshold, F.lit(False)))


def _code(value: Column) -> Column:
    return F.when(F.lower(F.trim(value)).isin(*POSITIVE), 1).otherwise(0)


def is_boolean_like(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Columns whose values are all texts for yes or no; one missing value makes a column none of these."""
    return dict.fromkeys(columns, False) | {c: a.yes for c, a in about_values(value_counts(df, columns)).items()}


def bool_encode(df: DataFrame, columns: list[str], yes: set[str] | None = None) -> DataFrame:
    """Texts for yes and no as 1 and 0, where a column has no others."""
    yes = {c for c, ok in is_boolean_like(df, columns).items() if ok} if yes is None else yes
    return df.select([_code(F.col(f"`{c}`").cast("string")).alias(c) if c in yes and c in columns else F.col(f"`{c}`") for c in df.columns])


def numbered(counts: DataFrame, about: dict[str, About]) -> DataFrame:
    """column, value, code of value counts: the values of each column from 0 in binary order.

    A column of few values is numbered by a window; with more, all columns' values are one table in ranges of (column,
    value), and a code is the number of values before, less those of the columns before."""
    values = counts.where("value is not null").select("column", "value")
    if max((a.values for a in about.values()), default=0) <= BROADCAST_CODES:
        return values.select("column", "value", (F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1).cast("int").alias("code"))
    placed = running(values, [F.col("column"), F.col("value")], {"before": F.lit(1).cast("long")})
    firsts = placed.groupBy("column").agg(F.min("before").alias("first"))  # one row for each column
    return checkpointed(placed.join(F.broadcast(firsts), "column").select("column", "value", (F.col("before") - F.col("first")).cast("int").alias("code")))


def codebook(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, code: dense codes of each column's values in binary order, from 0. Missing values take the mode."""
    counts = value_counts(df, columns)
    return numbered(counts, about_values(counts)) if columns else df.sparkSession.createDataFrame([], "column string, value string, code int")


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as their codes, missing values as that of the mode."""
    counts = value_counts(df, columns)
    about = about_values(counts)
    return _encoded(df, columns, about, numbered(counts, about)) if columns else df


def _encoded(df: DataFrame, columns: list[str], about: dict[str, About], book: DataFrame) -> DataFrame:
    """Codes are joined on, one column's dictionary at a time, and sent to all tasks only while their number is known to be small."""
    for c in columns:
        codes = book.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        codes = F.broadcast(codes) if about[c].values <= BROADCAST_CODES else codes
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(about[c].mode))
        joined = df.withColumn("__key", value).join(codes, F.col("__key") == F.col("__value"), "left")
        df = joined.select([F.col("__code").alias(x) if x == c else F.col(f"`{x}`") for x in df.columns])
    return df


def likely_columns(df: DataFrame, threshold: float) -> tuple[list[str], int]:
    """(text columns that may have few enough values, rows): by sketches with an error of a few percent, taken with a factor of 2."""
    columns = text_columns(df)
    row = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"d{i}"] <= 2 * threshold * row["n"] + 2], row["n"]


def encode_categoricals(df: DataFrame, threshold: float = DEFAULT_ENCODE_SHARE) -> tuple[DataFrame, DataFrame]:
    """(df with columns of few values as integers, codebook). Exact counts are made once, of the columns that sketches do not rule out."""
    likely, n = likely_columns(df, threshold)
    counts = value_counts(df, likely)
    about = {c: a for c, a in about_values(counts).items() if n and a.values / n <= threshold}
    booleans, labels = [c for c in df.columns if c in about and about[c].yes], [c for c in df.columns if c in about and not about[c].yes]
    codes = numbered(counts.where(F.col("column").isin(labels)), {c: about[c] for c in labels})
    values = counts.where(F.col("column").isin(booleans)).select("column", "value", _code(F.col("value")).alias("code"))
    return _encoded(bool_encode(df, booleans, set(booleans)), labels, about, codes), codes.unionByName(values)


def correlations(df: DataFrame) -> list[tuple[str, str, float]]:
    """(a, b, r) of numeric columns, a before b; NaN with a constant column."""
    columns = numeric_columns(df)
    r = moments(df, columns).correlation() if columns else []
    return [(columns[i], columns[j], float(r[i, j])) for j in range(len(columns)) for i in range(j)]


def correlated_columns(df: DataFrame, threshold: float = CORRELATED) -> list[str]:
    """Numeric columns whose correlation with any earlier one, itself dropped or not, exceeds the threshold."""
    bad = {b for _, b, r in correlations(df) if not math.isnan(r) and abs(r) > threshold}
    return [c for c in df.columns if c in bad]


def drop_correlated(df: DataFrame, threshold: float = CORRELATED) -> DataFrame:
    return df.drop(*correlated_columns(df, threshold))


def drop_dummies(df: DataFrame, prefix: str = "reg") -> DataFrame:
    """Without the numeric columns of a prefix, if they add up to the same number in all complete rows."""
    columns = [c for c in numeric_columns(df) if c.startswith(prefix)]
    if not columns:
        return df
    total = reduce(lambda a, b: a + b, [F.col(f"`{c}`").cast("double") for c in columns])
    row = df.agg(F.min(total).alias("a"), F.max(total).alias("b")).first()
    return df.drop(*columns) if row["a"] is not None and row["a"] == row["b"] else df


def full_preprocess(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(prepared table, codebook); columns of keep are not pruned. Writing either is left to the caller."""
    encoded, book = encode_categoricals(handle_missing(df), ENCODE_SHARE)
    pruned = drop_dummies(drop_correlated(encoded)).columns
    return encoded.select([F.col(f"`{c}`") for c in encoded.columns if c in pruned or c in (keep or ())]), book
