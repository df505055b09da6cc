"""Exact best splits of regression tree nodes as aggregates and windows.

Rows are (node keys…, attr, val, coef, resp): a row for each item and attribute, coef its share in the node times its
weight.  Items with equal values form a block; prefix sums over blocks score every border between two blocks.  The
score to be minimised drops what is constant in a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import counted
from .prefix import running

TINY = 1e-10


def node_stats(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per node of (keys, coef, resp): n, v, s, pure (all responses equal)."""
    return items.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("coef").alias("v"), F.sum(F.col("coef") * F.col("resp")).alias("s"), (F.min("resp") == F.max("resp")).alias("pure"))


def blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per (node, attr, value): v, s, least and greatest response, gone (the value is missing).  Partial sums run before the exchange.  gone is an
    aggregate, so that filters on it stay above, and all that is made of the blocks shares one exchange."""
    return rows.groupBy(*keys, "attr", "val").agg(F.bool_and(F.col("val").isNull()).alias("gone"), F.sum("coef").alias("v"), F.sum(F.col("coef") * F.col("resp")).alias("s"), F.min("resp").alias("lo"), F.max("resp").alias("hi"))


def plain_score(v1: Column, s1: Column, v2: Column, s2: Column) -> Column:
    return -s1 * s1 / v1 - s2 * s2 / v2


def missing_score(v1: Column, s1: Column, v2: Column, s2: Column, vm: Column, sm: Column) -> Column:
    """Missing items go both ways in the proportion of the others."""
    p = v1 / (v1 + v2)
    q = F.lit(1.0) - p
    v = v1 + v2 + vm
    m1, m2 = (s1 / p + sm) / v, (s2 / q + sm) / v
    mm = p * m1 + q * m2
    return -2 * m1 * s1 + v1 * m1 * m1 - 2 * m2 * s2 + v2 * m2 * m2 - 2 * mm * sm + vm * mm * mm


def candidates(block: DataFrame, keys: list[str], booleans: list[str] | None = None, largest: int | None = None) -> DataFrame:
    """(keys, attr, border, missing_l, eval) of every border, and of "present left, missing right" (border null).  A border between two
    blocks that are pure and equal is skipped, except for booleans.  largest: a bound of an attribute's values in a node, where it is known; beyond what a
    task holds, sums run in two levels."""
    if largest is None:
        block, largest = counted(block)
    part = lambda c, gone: F.when(F.col("gone") == gone, F.col(c)).otherwise(0.0)
    both = block.select(*keys, "attr", "val", "gone", "lo", "hi", part("v", False).alias("v"), part("s", False).alias("s"), part("v", True).alias("vm"), part("s", True).alias("sm"))
    run = running(both, [*keys, "attr"], "val", ["v", "s", "vm", "sm"], ["val", "lo", "hi"], largest)  # what is missing comes first, and has no value
    run = run.filter("NOT gone").select(*keys, "attr", "val", "lo", "hi", "last_val", "last_lo", "last_hi", F.col("v_before").alias("v1"), F.col("s_before").alias("s1"), F.col("v_all").alias("vp"), F.col("s_all").alias("sp"), F.col("vm_all").alias("vm"), F.col("sm_all").alias("sm"))
    p = run.select("*", F.col("last_val").isNull().alias("first"), (F.col("vp") - F.col("v1")).alias("v2"), (F.col("sp") - F.col("s1")).alias("s2"))
    same = (F.col("lo") == F.col("hi")) & (F.col("last_lo") == F.col("last_hi")) & (F.col("lo") == F.col("last_lo"))
    if booleans:
        same = same & ~F.col("attr").isin(booleans)
    apart = F.expr(f"vm > {TINY} AND vp > {TINY}")  # the first value of an attribute speaks for it
    p = p.filter(F.when(F.col("first"), apart).otherwise(~same & F.expr(f"v1 > {TINY} AND v2 > {TINY}")))
    args = [F.col(c) for c in ("v1", "s1", "v2", "s2")]
    score = F.when(F.col("vm") > TINY, missing_score(*args, F.col("vm"), F.col("sm"))).otherwise(plain_score(*args))
    whole = plain_score(F.col("vp"), F.col("sp"), F.col("vm"), F.col("sm"))
    border = F.when(~F.col("first"), (F.col("last_val") + F.col("val")) / 2)
    return p.select(*keys, "attr", border.alias("border"), F.when(F.col("first"), 0.0).otherwise(F.col("v1") / F.col("vp")).alias("missing_l"), F.when(F.col("first"), whole).otherwise(score).alias("eval"))


def best_splits(found: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """One split a node: least score, then attribute by name, then border (null last)."""
    rank = F.struct(F.round("eval", digits).alias("e"), "attr", F.col("border").isNull().alias("apart"), "border")
    best = found.groupBy(*keys).agg(F.min_by(F.struct("attr", "border", "missing_l", "eval"), rank).alias("best"))  # with partial minima, no sort of all borders
    return best.select(*keys, "best.*")


def entropy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attr, entropy): bits of an attribute's values in a node by coef; missing is a value."""
    return block_entropy(rows.groupBy(*keys, "attr", "val").agg(F.sum("coef").alias("v")), keys)


def block_entropy(block: DataFrame, keys: list[str]) -> DataFrame:
    """entropy from blocks: log2 V - (sum of v log2 v) / V, two sums and no window."""
    v = F.col("v")
    return block.filter(v > 0).groupBy(*keys, "attr").agg(F.sum(v).alias("all"), F.sum(v * F.log2(v)).alias("logs")).select(*keys, "attr", F.greatest(F.lit(0.0), F.log2("all") - F.col("logs") / F.col("all")).alias("entropy"))


def route(items: DataFrame, value: Column, border: Column, missing_l: Column) -> DataFrame:
    """items (coef…) once for each child that gets a part of them: side 0 is left, coef its part."""
    left = F.when(border.isNull(), F.when(value.isNull(), F.lit(0.0)).otherwise(F.lit(1.0))).when(value.isNull(), missing_l).when(value <= border, F.lit(1.0)).otherwise(F.lit(0.0))
    ways = F.array(F.struct(F.lit(0).alias("side"), left.alias("part")), F.struct(F.lit(1).alias("side"), (F.lit(1.0) - left).alias("part")))
    out = items.withColumn("_way", F.explode(ways)).withColumn("coef", F.col("coef") * F.col("_way.part")).withColumn("side", F.col("_way.side"))
    return out.filter("coef > 1e-12").drop("_way")
