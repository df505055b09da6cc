"""Reports as text and tables, and the state of a grid run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import missing_text
from ..operators.grid import GridRun


def write_report(df: DataFrame, path: str, order: list[str] = ()) -> None:
    """Tab-separated lines, missing numbers as ``?``; with ``order`` sorted over all files."""
    df = df.orderBy(*order) if order else df
    df.select(*[missing_text(F.col(c)).alias(c) for c in df.columns]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A few lines in their order, in one file."""
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_performance(curve: DataFrame, path: str, value: str = "rmse", order: str = "bag") -> None:
    """A number a bag, in their order."""
    lines = [repr(r[0]) for r in curve.orderBy(order).select(value).collect()]  # a number a bag
    write_lines(curve.sparkSession, lines, path)


def write_core_features(table: DataFrame, path: str) -> None:
    """Kept features and what the model does without each, the greatest number first."""
    rows = table.filter("kept").orderBy(F.col("perf").desc(), "attr").collect()  # a row a feature
    write_lines(table.sparkSession, [f"{r['attr']}\t{r['perf']!r}" for r in rows], path)


def write_distribution(spark: SparkSession, mean: float, std: float, path: str) -> None:
    write_lines(spark, [repr(float(mean)), repr(float(std))], path)


def read_distribution(spark: SparkSession, path: str) -> tuple[float, float]:
    mean, std = (float(x) for x in spark.read.text(path, wholetext=True).first()[0].split())
    return mean, std


def save_run(run: GridRun, path: str) -> None:
    run.cells.write.mode("overwrite").parquet(f"{path}/cells")
    run.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    about = json.dumps({k: getattr(run, k) for k in ("seed", "alpha", "trees", "bags", "mode")} | {"turns": [[*k, v] for k, v in (run.turns or {}).items()]})
    run.cells.sparkSession.createDataFrame([(about,)], "value string").write.mode("overwrite").text(f"{path}/run")


def load_run(spark: SparkSession, path: str) -> GridRun:
    about = json.loads(spark.read.text(f"{path}/run").first()[0])
    turns = {(t, a): below for t, a, below in about.pop("turns")} or None
    return GridRun(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/nodes"), **about, turns=turns)
