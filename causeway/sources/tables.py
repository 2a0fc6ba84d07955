"""Reading tables, and writing results where a caller asks for it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of a CSV file that mean a missing value.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header. Texts for missing values become null before types are inferred."""
    text = spark.read.csv(path, header=True, inferSchema=False)
    clean = text.select([F.when(F.trim(F.col(f"`{c}`")).isin(*MISSING), None).otherwise(F.col(f"`{c}`")).alias(c) for c in text.columns])
    tests = {c: [F.try_to_number(F.trim(F.col(f"`{c}`")), F.lit("S9999999999999999999")).isNull(), F.expr(f"try_cast(trim(`{c}`) as double)").isNull()] for c in text.columns}
    bad = clean.agg(*[F.max(F.when(F.col(f"`{c}`").isNotNull() & t, 1).otherwise(0)).alias(f"{i}_{k}") for i, (c, ts) in enumerate(tests.items()) for k, t in enumerate(ts)]).first()
    kinds = ["bigint" if not bad[f"{i}_0"] else "double" if not bad[f"{i}_1"] else None for i in range(len(text.columns))] if text.columns else []
    return clean.select([F.expr(f"try_cast(trim(`{c}`) as {k})").alias(c) if k else F.col(f"`{c}`") for c, k in zip(text.columns, kinds, strict=True)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with NaN turned into null."""
    return nan_to_null(spark.read.parquet(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([F.when(F.isnan(F.col(f"`{c}`")), None).otherwise(F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns])


def is_missing(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def write_table(df: DataFrame, folder: str) -> None:
    """As CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(folder)


def write_codebook(codebook: DataFrame, folder: str) -> None:
    """Lines of code -> value, one folder for each encoded column; nothing if no column was encoded."""
    lines = codebook.select("column", F.concat(F.lit("  "), F.col("code").cast("string"), F.lit(" -> "), F.col("value")).alias("line"))
    if lines.limit(1).count():
        lines.repartition("column").sortWithinPartitions("line").write.mode("overwrite").partitionBy("column").text(folder)


def preview(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def profile(df: DataFrame) -> DataFrame:
    """column, type, rows, missing of every column, in one aggregate."""
    sums = [F.sum(is_missing(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(df.columns)]
    packed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.coalesce(F.col(f"m{i}"), F.lit(0)).cast("long").alias("missing")) for i, (c, t) in enumerate(df.dtypes)])
    return df.agg(F.count("*").alias("rows"), *sums).select("rows", F.explode(packed).alias("p")).select("p.column", "p.type", "rows", "p.missing")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that the session names in spark.checkpoint.dir, where its lineage ends.

    A local session that names none gets a folder of its own; a cluster must name one that its executors share."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    return df.checkpoint()
