"""Scans of train, validation and test tables, their checks, and small profiles of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import CONTINUOUS, DataError, FeatureSchema


def read_table(spark: SparkSession, path: str, schema: FeatureSchema) -> DataFrame:
    """A headerless table of numbers split by white space, ``?`` for a missing one.  Spaces next to a tab don't count.  Errors are raised when
    rows are read: too few or too many cells, and text in an active column (in an ignored one it is missing)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    cells = F.split(F.trim(F.regexp_replace("value", r"[ \t]+", "\t"), F.lit("\t")), "\t")
    n = len(schema.columns)
    rows = lines.select(cells.alias("c"))
    rows = rows.select(F.when(F.size("c") == n, F.col("c")).otherwise(F.raise_error(F.concat(F.when(F.size("c") < n, F.lit("too few cells: ")).otherwise(F.lit("too many cells: ")), F.size("c").cast("string")))).alias("c"))
    out = []
    for k, a in enumerate(schema.columns):
        cell = F.col("c")[k]
        number = cell.try_cast("double")
        if a.role != "feature" or a.active:
            number = F.when(cell == "?", F.lit(None)).when(number.isNull(), F.raise_error(F.concat(F.lit(f"not a number in {a.name}: "), cell)).cast("double")).otherwise(number)
            out.append(number.alias(a.name))
        else:
            out.append((cell if a.kind == "nom" else number).alias(a.name))
    return rows.select(out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def single_precision(c: Column) -> Column:
    """A number as a 32-bit float holds it."""
    return c.cast("float").cast("double")


def _marks(schema: FeatureSchema, role: str) -> list[Column]:
    marks = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(schema.target).isNull()).alias("no_target")]
    if role == "train":
        marks += [F.count_if(F.col(b).isNotNull() & ~F.col(b).isin(0, 1)).alias(f"bool {b}") for b in schema.booleans]
    return marks


def _faults(found: dict, schema: FeatureSchema, role: str) -> None:
    if role != "test":
        if not found["n"]:
            raise DataError(f"empty {role}")
        if found["no_target"]:
            raise DataError(f"missing target in {role}")
    for b in schema.booleans if role == "train" else ():
        if found[f"bool {b}"]:
            raise DataError("not a boolean", b)


def checked(df: DataFrame, schema: FeatureSchema, role: str) -> DataFrame:
    """df of role train, valid or test, checked in one pass: not empty, a target in every row (test rows may lack it), and in
    train booleans of 0 and 1 only."""
    _faults(df.agg(*_marks(schema, role)).first().asDict(), schema, role)
    return df


def checked_as_read(df: DataFrame, schema: FeatureSchema, role: str, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(read(df), its rows), where ``read`` runs over df once and whole, as writing it does.  What checked looks at is observed on the way, so that a file is read in
    one pass; its errors are raised then."""
    seen = Observation()
    out = read(df.observe(seen, *_marks(schema, role)))
    _faults(seen.get, schema, role)
    return out, seen.get["n"]


def has_targets(df: DataFrame, target: str) -> bool:
    """Whether every row has a target, so that metrics can be computed."""
    return df.filter(F.col(target).isNull()).isEmpty()


def missing_profile(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(attr, n_missing) of features with missing values: one pass, one row, then turned."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features])
    return counts.unpivot([], list(features), "attr", "n_missing").filter("n_missing > 0")


def domain_violations(df: DataFrame, booleans: tuple[str, ...]) -> DataFrame:
    """(attr, n_bad) for each boolean."""
    counts = df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)).alias(c) for c in booleans])
    return counts.unpivot([], list(booleans), "attr", "n_bad")


def sorted_values(df: DataFrame, *attrs: str) -> DataFrame:
    """The columns in ascending order, missing last."""
    return df.select(*attrs).orderBy(*[F.col(a).asc_nulls_last() for a in attrs])


def probe_points(spark: SparkSession, features: tuple[str, ...], points: DataFrame) -> DataFrame:
    """points (some of the features) with all other features missing."""
    return points.select("*", *[F.lit(None).cast("double").alias(f) for f in features if f not in points.columns])


def long_form(df: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """(key…, attr, val): a row for each feature."""
    return df.unpivot([F.col(k) for k in key], [F.col(f).cast("double").alias(f) for f in features], "attr", "val")


def kinds(schema: FeatureSchema) -> dict[str, str]:
    return {a.name: a.kind if a.kind else CONTINUOUS for a in schema.features if a.active}
