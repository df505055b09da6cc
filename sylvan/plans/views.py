"""Feature views over the driver's tables.  Targets are whole numbers, so that sums are exact in any order and both engines agree."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: SQL of the views; {json} differs by dialect.
SQL = {
    "ord": """
SELECT o.o_orderkey AS key, CAST(floor(o_totalprice / 100) AS DOUBLE) AS y, CAST(coalesce(l.n_items, 1) AS DOUBLE) AS w,
       CAST(coalesce(l.sum_qty, 0) AS DOUBLE) AS sum_qty, CAST(coalesce(l.avg_disc, 0) AS DOUBLE) AS avg_disc,
       CAST(floor(c.c_acctbal) AS DOUBLE) AS acctbal,
       CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS DOUBLE) AS is_urgent,
       CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS DOUBLE) AS is_open, o_orderpriority AS priority
FROM orders o
LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, sum(l_quantity) AS sum_qty,
                  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS avg_disc
           FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey""",
    "evt": """
SELECT event_id AS key, CAST(floor(value) AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w, CAST({json} AS DOUBLE) AS k,
       CAST(minute(ts) AS DOUBLE) AS minute, CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS DOUBLE) AS is_click,
       CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS DOUBLE) AS is_error,
       CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE) AS is_purchase,
       CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS DOUBLE) AS is_signup
FROM events""",
    "doc": """
SELECT d.doc_id AS key, CAST(l.quality AS DOUBLE) AS y, CAST(1 + d.doc_id % 3 AS DOUBLE) AS w,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST(d.n_chars AS DOUBLE) END AS n_chars,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE CAST(l.toxic AS DOUBLE) END AS toxic,
       CAST(CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS DOUBLE) AS lang_en
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "li": """
SELECT CAST(floor(l_extendedprice) AS DOUBLE) AS y, l_quantity AS w, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
       CAST(l_linenumber AS DOUBLE) AS linenumber
FROM lineitem""",
}
JSON = {"spark": "get_json_object(props, '$.k')", "duckdb": "json_extract_string(props, '$.k')"}
FEATURES = {
    "ord": ["acctbal", "avg_disc", "is_open", "is_urgent", "sum_qty"],
    "evt": ["is_click", "is_error", "is_purchase", "is_signup", "k", "minute"],
    "doc": ["lang_en", "n_chars", "toxic"],
    "li": ["discount", "linenumber", "quantity", "tax"],
}
BOOLEANS = {"ord": ["is_open", "is_urgent"], "evt": ["is_click", "is_error", "is_purchase", "is_signup"], "doc": ["lang_en", "toxic"], "li": []}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over sf_dir's tables, bound to this call: no names are left in the session."""
    text = SQL[name].replace("{json}", JSON["spark"])
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle_view(name: str) -> str:
    """The view as a CTE for DuckDB."""
    return f"{name} AS ({SQL[name].replace('{json}', JSON['duckdb'])})"


def embeddings(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """key, y (label), w, e0 … e63 (of the first ``width`` components), set (valid where key % 5 = 0)."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = [F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(width)]
    return df.select(F.col("vec_id").alias("key"), F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w"), *e, F.when(F.col("vec_id") % 5 == 0, "valid").otherwise("train").alias("set"))
