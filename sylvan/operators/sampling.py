"""Bags: deterministic draws with and without replacement, and the rows left out."""

from __future__ import annotations

import hashlib
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DRAWS = 4294967296.0


def hash_number(*parts: Column) -> Column:
    """First 32 bits of the MD5 of the parts joined by ``-``: any engine can replay it."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("long")


#: From this many rows on, a bag that draws every row is beyond all chance (below 1e-26).
SMALL = 64


def _attempts(rows: int, bags: int, seed: int, step: int | None) -> dict[int, str]:
    """Names of the bags whose first draw would leave no row out, and which are drawn anew for that."""
    out = {}
    for bag in range(bags) if 1 < rows < SMALL else ():
        first = str(bag) if step is None else f"{bag}.{step}"
        for k in count():
            name = f"{first}.{k}" if k else first
            drawn = {int(rows * (int(hashlib.md5(f"{seed}-{name}-{d}".encode()).hexdigest()[:8], 16) / DRAWS)) for d in range(rows)}
            if len(drawn) < rows:
                break
        if k:
            out[bag] = name
    return out


def bootstrap_draws(spark: SparkSession, rows: int, bags: int, seed: int = 1, step: int | None = None) -> DataFrame:
    """(bag, draw, row_no): ``rows`` draws with replacement for each bag, others for each step.  All rows are equally likely, the last one too; a bag
    that would leave no row out is drawn anew."""
    d = spark.range(bags * rows).select((F.col("id") / rows).cast("long").alias("bag"), (F.col("id") % rows).alias("draw"))
    name = F.col("bag").cast("string") if step is None else F.concat(F.col("bag").cast("string"), F.lit(f".{step}"))
    for bag, again in _attempts(rows, bags, seed, step).items():
        name = F.when(F.col("bag") == bag, F.lit(again)).otherwise(name)
    u = hash_number(F.lit(seed).cast("string"), name, F.col("draw").cast("string")) / F.lit(DRAWS)
    return d.withColumn("row_no", F.floor(F.lit(float(rows)) * u).cast("long"))


def in_bag(draws: DataFrame) -> DataFrame:
    """(bag, row_no, times)."""
    return draws.groupBy("bag", "row_no").agg(F.count("*").alias("times"))


def out_of_bag(row_numbers: DataFrame, draws: DataFrame, bags: int) -> DataFrame:
    """(bag, row_no) of rows that a bag did not draw.  Bags are few: the rows are repeated, not joined crosswise."""
    every = row_numbers.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bags - 1).cast("long"))).alias("bag"), "row_no")
    return every.join(draws.select("bag", "row_no").distinct(), ["bag", "row_no"], "left_anti")


#: Hashes are counted in so many ranges.
RANGES = 1 << 16


def subsample(df: DataFrame, key: str, n: int, seed: int = 1, bags: int = 1) -> DataFrame:
    """``n`` rows a bag without replacement: those with the least hash.  Hashes are counted by range; rows of the ranges below the one in which the n-th row lies are
    taken as they are, and only those of that range are ranked."""
    every = df.withColumn("bag", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bags - 1).cast("long"))))
    h = every.withColumn("h", hash_number(F.lit(seed).cast("string"), F.col("bag").cast("string"), F.col(key).cast("string")))
    at = F.shiftright("h", 32 - RANGES.bit_length() + 1)
    counts = h.groupBy("bag", at.alias("_at")).agg(F.count("*").alias("_rows"))  # RANGES rows a bag at most
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("bag").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("_before", before).filter((F.col("_before") < n) & (F.col("_before") + F.col("_rows") >= n)).select("bag", F.col("_at").alias("_last"), (n - F.col("_before")).alias("_lacking"))
    told = h.withColumn("_at", at).join(F.broadcast(last), "bag", "left")  # a bag with fewer rows has none, and all are taken
    whole = told.filter(F.col("_last").isNull() | (F.col("_at") < F.col("_last"))) if n > 0 else told.limit(0)
    edge = told.filter(F.col("_at") == F.col("_last")).withColumn("_k", F.row_number().over(Window.partitionBy("bag").orderBy("h", key))).filter(F.col("_k") <= F.col("_lacking"))
    return whole.drop("_at", "_last", "_lacking").unionByName(edge.drop("_at", "_last", "_lacking", "_k"))
