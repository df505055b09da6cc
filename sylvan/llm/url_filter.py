"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed entry is a host and a path prefix; it fits its host, all subdomains, and every path that
starts with its path.  A page therefore has one possible canonical key (host suffix + path prefix)
for each shape (labels of the host, length of the path) that entries of the list have, at most.  Most keys are in no list: the
blocked Bloom filter (one 256-bit block of eight 32-bit words a key, one bit in each word) drops them
with one look at one block.  Possible hits go to an equi join with the list itself, which removes
the false positives; of a page's true hits the longest wins.

All steps are DataFrame functions.  The filter is a table of blocks, so that it grows with the list
without a limit: Spark broadcasts blocks or list only below its own size threshold, and otherwise
deals both sides out by key (a hot key is then split by the adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Odd multipliers, one for each word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x2824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
KEYS_A_BLOCK = 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _bits(h: Column) -> list[Column]:
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(0x7FFFFFFF)), 26) for s in SALTS]


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 31), F.lit(blocks).cast("long"))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 … w7) of the listed keys; blocks without a key have no row."""
    h = listed.select(F.xxhash64("key").alias("h"))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")).alias(f"m{i}") for i, b in enumerate(_bits(F.col("h")))]
    return h.select(_block(F.col("h"), blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(8)])


def canonical_list(listed: DataFrame) -> DataFrame:
    """(key, verdict, labels, host_length, path_length): hosts in lower case, entries without a host or path dropped where
    either is null, one verdict an entry (block wins)."""
    host = ascii_lower(F.col("host"))
    return (
        listed.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(F.concat(host, "path").alias("key"), F.size(F.split(host, r"\.", -1)).alias("labels"), F.length(host).alias("host_length"), F.length("path").alias("path_length"))
        .agg(F.max("verdict").alias("verdict"))
    )


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: page_id, host, path, rule (null if none fits), verdict.

    ``listed``: host, path, verdict.  Null or malformed URL: empty host and path, verdict ``default``.
    Null ids and repeated rows: answered like any other.  Empty list: all ``default``.  Equally long
    rules: the one with the longer host.  Very long URLs: read whole; of a host's suffixes, those with as many labels as a listed host.  Further columns are ignored.
    """
    rules = materialise(canonical_list(listed), "url-list")
    n = rules.count()
    shapes = rules.select("labels", "path_length").distinct().collect()  # as many as hosts have labels times paths have lengths, at most
    blocks = max(1, -(-n // KEYS_A_BLOCK))
    bloom = materialise(bloom_blocks(rules, blocks), "url-bloom")

    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.", -1)
    known = F.array(*[F.struct(F.lit(x["labels"]).alias("labels"), F.lit(x["path_length"]).alias("k")) for x in shapes]).cast("array<struct<labels:int,k:int>>")
    fitting = F.filter(known, lambda x: (x["labels"] <= F.size(labels)) & (x["k"] <= F.length("path")))
    keys = F.transform(fitting, lambda x: F.concat(F.array_join(F.slice(labels, F.size(labels) - x["labels"] + 1, x["labels"]), "."), F.substring("path", F.lit(1), x["k"])))
    probes = rows.select("*", F.explode(F.concat(keys, F.array(F.lit(None).cast("string")))).alias("key"))  # the null key keeps the page itself
    probes = probes.withColumn("h", F.xxhash64("key")).withColumn("block", F.when(F.col("key").isNotNull(), _block(F.col("h"), blocks)))
    possible = F.lit(True)
    for i, b in enumerate(_bits(F.col("h"))):
        possible = possible & (F.call_function("shiftright", F.col(f"w{i}"), b.cast("int")).bitwiseAND(F.lit(1)) == 1)
    passed = probes.join(bloom, "block", "left").filter(F.col("key").isNull() | possible).select("page_id", "host", "path", "row", "key")
    hits = passed.join(rules, "key", "left")
    found = F.when(F.col("verdict").isNotNull(), F.struct(F.length("key").alias("n"), "host_length", "key", "verdict"))
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max(found).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The contract's rules: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def op2_url_filter(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


ORACLE = r"""
WITH rules(rule_host, rule_path, v) AS (VALUES %s),
p AS (
  SELECT row_number() OVER () AS rn, page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), hit AS (
  SELECT p.*, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY rn ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hit WHERE k = 1
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
