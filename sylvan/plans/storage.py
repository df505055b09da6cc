"""Written intermediate tables, and row numbers without a single task."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, an own temporary one in local mode; an error on a cluster, whose executors
    don't share a folder of the driver's."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sylvan-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by now
            return


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/sylvan-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage of iterative plans."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """(stored df, its rows), counted as they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, seen.get["rows"]


def discard(df: DataFrame) -> None:
    """Remove what stored wrote for df; nothing that is still to run may read it."""
    remove(df.sparkSession, _paths.pop(df))


def numbered(df: DataFrame, *order, name: str = "row_no") -> DataFrame:
    """df with a row number from 0 in the given order: numbers within range partitions plus the counts of those before."""
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(counts, "_part").withColumn(name, F.col("_base") + F.col("_own") - 1).drop("_part", "_own", "_base")
