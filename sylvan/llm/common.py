"""Helpers shared by the text operators: shared storage, ids, word patterns."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: ASCII white space of the contracts, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where that is unset, an own temporary one in local mode (tests); an error on a cluster,
    whose executors don't share a folder of the driver's."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sylvan-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/sylvan-{uuid.uuid4().hex}/{tag}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            remove(spark, path.rsplit("/", 1)[0])
        except Exception:  # the session may be gone by now
            return


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost
    executors, and gives later plans true sizes."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what materialise wrote for df; nothing that is still to run may read it."""
    remove(df.sparkSession, _paths.pop(df))


#: Bytes that a batch on its way to a Python worker has at most, but for a row that is longer alone.
BATCH_BYTES = 4 << 20


def _give_back() -> None:
    """Hand freed memory back to the system: workers are reused, and what one task needed isn't the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded in bytes as well as in rows (a setting of the session, lowered here where it is
    higher); workers give freed memory back at the end of a task."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(df.sparkSession.conf.get(setting)).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        df.sparkSession.conf.set(setting, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(bounded, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, so that further columns cannot clash; a null text is empty.  Ids are whole numbers."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; ids are whole numbers")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Bytes of a table that may be broadcast by hint.
HINTED_BYTES = 16 << 20


def hinted(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if so many rows of so many bytes are few enough; else Spark decides by what it measures."""
    return F.broadcast(df) if rows * row_bytes <= HINTED_BYTES else df


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(divisor)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def with_unique_ids(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """(docs, the column that tells its rows apart): the id where it is unique and never null, else a row number in a
    written copy."""
    if docs.groupBy(F.col(id_col).alias("id")).count().filter("id IS NULL OR count > 1").isEmpty():
        return docs, id_col
    return materialise(docs.withColumn("_sylvan_row", F.monotonically_increasing_id()), "numbered"), "_sylvan_row"


#: 64-bit words that a Bloom filter on the driver has at most (8 MB).
BLOOM_WORDS = 1 << 20


def bloom_words(df: DataFrame, hash_col: str, n: int) -> np.ndarray:
    """A Bloom filter of a column of n 64-bit hashes as 64-bit words, 16 bits a hash up to BLOOM_WORDS: a filter before an exact join, so
    its size is bounded, and a fuller one lets more rows through to the join."""
    words = min(BLOOM_WORDS, 1 << max(4, (n // 4).bit_length()))
    bits = [F.pmod(F.col(hash_col), F.lit(words * 64)), F.pmod(F.shiftright(F.col(hash_col), 27), F.lit(words * 64))]
    rows = df.select(F.explode(F.array(*bits)).alias("bit"))
    masks = rows.select(F.shiftright("bit", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")).alias("mask"))
    out = np.zeros(words, np.uint64)
    found = masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # BLOOM_WORDS rows at most
    out[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def bloom_passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    ok = np.ones(len(hashes), bool)
    for h in (hashes, hashes >> 27):
        bit = np.mod(h, len(words) * 64)
        ok &= (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok
