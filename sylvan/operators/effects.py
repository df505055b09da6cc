"""Effects of features on a model: quantile points, partial effects, joint effects, densities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .prefix import running


def ranked_values(df: DataFrame, attr: str) -> DataFrame:
    """(val, n, first): distinct values (missing last), their counts, and the index of their first row in order."""
    counts = df.groupBy(F.col(attr).cast("double").alias("val")).agg(F.count("*").alias("n"))
    known = running(counts.filter("val IS NOT NULL"), [], "val", ["n"]).select("val", "n", F.col("n_before").alias("first"))
    present = counts.filter("val IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)))
    return known.unionByName(counts.filter("val IS NULL").withColumn("first", present.scalar()))


def quantile_points(df: DataFrame, attr: str, q: int) -> DataFrame:
    """(val, n): the values at index floor((rows - 1) * (k / (q + 1))), k = 1 … q, and how many of the q each one is.  q doubles until the first and
    last differ, unless the feature has one value."""
    ranked = stored(ranked_values(df, attr))
    total, values = ranked.agg(F.sum("n"), F.count("*")).first()
    if not total:
        return ranked.select("val", "n")
    index = lambda k: int((total - 1) * (k / (q + 1)))
    while values > 1:
        ends = ranked.filter(reduce(lambda a, b: a | b, [(F.col("first") <= i) & (F.col("first") + F.col("n") > i) for i in (index(1), index(q))]))
        if ends.count() > 1:  # one row, or two
            break
        q *= 2
    points = df.sparkSession.range(1, q + 1).select(F.floor(F.lit(float(total - 1)) * (F.col("id") / F.lit(float(q + 1)))).alias("i"))
    met = points.join(ranked, (F.col("i") >= F.col("first")) & (F.col("i") < F.col("first") + F.col("n")))
    return met.groupBy("val").agg(F.count("*").alias("n"))


Model = Callable[[DataFrame], DataFrame]


def effect(points: DataFrame, attr: str, features: list[str], score) -> DataFrame:
    """(val, n, pred): the model's answer where only attr is known.  score: a column over the features (predict.ensemble_expression)."""
    known = points.withColumnRenamed("val", attr)
    probe = known.select("n", attr, *[F.lit(None).cast("double").alias(f) for f in features if f != attr])
    return probe.select(F.col(attr).alias("val"), "n", score.alias("pred"))


def joint_points(points1: DataFrame, points2: DataFrame, attr1: str, attr2: str, features: list[str], fixed: dict[str, float] | None = None) -> DataFrame:
    """All features on the grid of two features' points, other features missing or fixed.  Points are a few dozen a feature."""
    second = [r["val"] for r in points2.select("val").collect()]
    grid = points1.select(F.col("val").alias(attr1), F.explode(F.array(*[F.lit(v).cast("double") for v in second])).alias(attr2))
    fixed = fixed or {}
    return grid.select("*", *[F.lit(fixed.get(f)).cast("double").alias(f) for f in features if f not in (attr1, attr2)])


def joint_effect(points1: DataFrame, points2: DataFrame, attr1: str, attr2: str, features: list[str], score, fixed: dict[str, float] | None = None) -> DataFrame:
    """(val1, val2, pred) on the grid of joint_points."""
    probe = joint_points(points1, points2, attr1, attr2, features, fixed)
    return probe.select(F.col(attr1).alias("val1"), F.col(attr2).alias("val2"), score.alias("pred"))


def effect_matrix(joint: DataFrame) -> DataFrame:
    columns = sorted(r[0] for r in joint.select("val2").distinct().collect() if r[0] is not None)
    return joint.groupBy("val1").pivot("val2", columns).agg(F.first("pred"))


def _borders(points: DataFrame) -> list[float]:
    vals = sorted(r["val"] for r in points.select("val").collect() if r["val"] is not None)
    return [(a + b) / 2 for a, b in zip(vals, vals[1:], strict=False)]


def bucket(value, borders: list[float]):
    """Number of the bucket between midpoints, borders below; missing is the last."""
    k = F.lit(0)
    for b in borders:
        k = k + F.when(value > F.lit(b), 1).otherwise(0)
    return F.when(value.isNull(), F.lit(len(borders) + 1)).otherwise(k)


def density(df: DataFrame, attr1: str, attr2: str, points1: DataFrame, points2: DataFrame) -> DataFrame:
    """(b1, b2, share): share of rows around each pair of points; all rows count, so shares add up to 1.  Borders are literals: no join."""
    b = df.select(bucket(F.col(attr1), _borders(points1)).alias("b1"), bucket(F.col(attr2), _borders(points2)).alias("b2"))
    counts = b.groupBy("b1", "b2").agg(F.count("*").alias("n"))
    return counts.select("b1", "b2", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # a row a bucket


def density_markers(dens: DataFrame, cells: int) -> DataFrame:
    """dens with a mark: dense over 10 times an even share, sparse under a tenth."""
    even = F.lit(1.0 / cells)
    return dens.withColumn("mark", F.when(F.col("share") > 10 * even, "dense").when(F.col("share") < even / 10, "sparse").otherwise("even"))


def read_fixed(text: str) -> dict[str, float]:
    """``name value`` lines."""
    return {name: float(value) for name, value in (line.split() for line in text.splitlines() if line.strip())}
