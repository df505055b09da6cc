"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words.  A document of a source is expected target / source size
times in the mix.  The expected copies are summed along the source's documents, one random offset is
added, and a document is emitted once for each integer that its step crosses.  The documents of a
source stand in order of size, so that the words taken differ from the target by at most about one
longest document.

The sums are exact: expected copies are integers in units of 2**-24, so that they don't depend on how
the rows are dealt out, and reruns agree.  The prefix sum runs in two levels: rows are
range-partitioned by (source, size, doc_id), each partition sums its part of a source, and the
parts' totals (as many as partitions and sources together) are summed in turn.  A hot source
is therefore spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, with_unique_ids

UNIT_BITS = 24
UNIT = 1 << UNIT_BITS


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_ratio: int = 3) -> DataFrame:
    """Per source of (source, size): source_size, target.  Sources by code point, null last, weigh
    ``weights`` in turn and share all words; a target stops at max_ratio * source_size, its excess is
    reshared by weight until no target is above.  One row per source: windows without a key run on
    that table alone."""
    every, order = Window.partitionBy(), F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(order)) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_ratio)
    ranked = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), order)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", F.row_number().over(ranked).alias("i"), (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("rest"), (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest_weight"))
    free = F.col("rest").cast("double") * F.col("weight") <= F.col("cap").cast("double") * F.col("rest_weight")
    s = s.withColumn("first_free", F.min(F.when(free, F.col("i"))).over(every))
    at = lambda c: F.max(F.when(F.col("i") == F.col("first_free"), F.col(c))).over(every)
    s = s.withColumn("r", at("rest")).withColumn("rw", at("rest_weight"))
    target = F.when(F.col("i") >= F.col("first_free"), (F.col("r") * F.col("weight")).cast("double") / F.col("rw").cast("double")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_ratio: int = 3, seed: str = "mix") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies.

    Null text: size 0, as often in the mix as its source's other documents.  Null source: one
    source, last.  Null ids: last among equals.  Repeated rows: sampled one by one.  Source without
    words: target 0, no copies.  Empty table: no rows.  Further columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = rows.repartitionByRange(F.col("source").asc_nulls_last(), "size", F.col("doc_id").asc_nulls_last())
    rows = materialise(rows.withColumn("part", F.spark_partition_id()), "sizes")
    key = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless")]
    targets = source_targets(rows, weights, max_ratio)
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "-"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    targets = materialise(targets.select(*key, "source_size", "target", step.alias("step"), offset.alias("shift")), "targets")
    rows = rows.select("*", *key).join(targets, ["name", "nameless"])

    parts = rows.groupBy("part", "name", "nameless").agg(F.sum("step").alias("sum"))
    earlier = Window.partitionBy("name", "nameless").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "name", "nameless", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part", "name", "nameless").orderBy("size", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("step").over(within)).join(parts, ["part", "name", "nameless"])
    upto = F.col("base") + F.col("upto") + F.col("shift")
    copies = F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("step"), UNIT_BITS)
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as many times as it has copies."""
    told, key = with_unique_ids(docs, id_col)
    copies = mix_sources(told, key, text_col, source_col, **options).filter("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").alias("_sylvan_copies"))
    both = told.join(copies, key).withColumn("_sylvan_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_sylvan_copies"))))
    return both.select(docs.columns)


def op7_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 3 * source_size AS cap, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s
), k AS (
  SELECT *, row_number() OVER o AS i,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_weight
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST)
), f AS (
  SELECT *, min(CASE WHEN CAST(rest AS DOUBLE) * weight <= CAST(cap AS DOUBLE) * rest_weight THEN i END) OVER () AS first_free FROM k
), g AS (
  SELECT *, max(CASE WHEN i = first_free THEN rest END) OVER () AS r, max(CASE WHEN i = first_free THEN rest_weight END) OVER () AS rw FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN i >= first_free THEN CAST(r * weight AS DOUBLE) / CAST(rw AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target,
         CAST('0x' || substr(md5('mix-' || coalesce(source, '')), 1, 6) AS BIGINT) AS shift
  FROM g
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216.0::DOUBLE) AS BIGINT) ELSE 0 END AS step FROM t
), r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.step,
         e.step * row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id ASC NULLS LAST) + e.shift AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, ((upto >> 24) - ((upto - step) >> 24)) * size AS taken FROM r
"""
