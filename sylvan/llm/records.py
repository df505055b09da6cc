"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A data folder holds shards in ascending id order.  A shard is a row of frames:

    uint64  length of the record
    uint32  masked CRC-32 of those eight bytes
    record  uint8 bytes an id, uint8 1 if there is a doc_id, int64 doc_id, then the ids
    uint32  masked CRC-32 of the record
    byte    0x0A

all little-endian; masked(c) = ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32, so that checksums of data that
itself holds checksums stay sound.  Ids take two bytes where all of a record's are below 65536.
CRC-32 is zlib's: Python has no Castagnoli CRC in C.  The index, a Parquet table beside the shards, has each
record's shard, byte offset, size and number of ids, so that a reader can visit records in any order.

Spark's own committers write the shards (a text sink whose lines are frames), so that retried tasks leave no
partial shard, on any file system that Spark knows; binaryFile reads them back.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, new_path

HEAD, RECORD = struct.Struct("<QI"), struct.Struct("<BBq")
#: Bytes of text that a shard is planned for; a reader holds one shard at a time.
SHARD_BYTES = 16 << 20
BATCH_BYTES = 4 << 20


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """ids: little-endian unsigned 32-bit integers.  The closing line feed is the sink's."""
    wide = np.frombuffer(ids, "<u4")
    body = wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else ids
    record = RECORD.pack(2 if body is not ids else 4, doc_id is not None, doc_id or 0) + body
    size = struct.pack("<Q", len(record))
    return HEAD.pack(len(record), masked(zlib.crc32(size))) + record + struct.pack("<I", masked(zlib.crc32(record)))


def frame_at(data: bytes, at: int) -> tuple[int, int | None, bytes]:
    """(size, doc_id, ids) of the frame that begins at a byte; ValueError where it is cut off or a checksum is broken."""
    first = at + HEAD.size
    if first > len(data):
        raise ValueError(f"cut off at byte {at}")
    n, check = HEAD.unpack_from(data, at)
    if check != masked(zlib.crc32(data[at : at + 8])):
        raise ValueError(f"length checksum at byte {at}")
    if n < RECORD.size or first + n + 5 > len(data):
        raise ValueError(f"cut off at byte {at}")
    record = data[first : first + n]
    if struct.unpack_from("<I", data, first + n)[0] != masked(zlib.crc32(record)):
        raise ValueError(f"record checksum at byte {at}")
    width, has_id, doc_id = RECORD.unpack_from(record)
    body = record[RECORD.size :]
    return HEAD.size + n + 5, doc_id if has_id else None, np.frombuffer(body, "<u2").astype("<u4").tobytes() if width == 2 else body


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, bytes]]:
    """(offset, size, doc_id, ids) of a shard's frames; ValueError at a broken one."""
    at = 0
    while at < len(data):
        size, doc_id, ids = frame_at(data, at)
        yield at, size, doc_id, ids
        at += size


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all documents' ids in ascending doc_id order (null last; ties by the text's hash, then text) under path/data and the index
    under path/index.

    Null or empty text: a record with the end id alone.  Very long texts: one record.  Repeated and null ids: spread over shards like any
    other, by their texts and then by row.  Empty table: no record.  Further columns are ignored.
    """
    spark, rows, end = docs.sparkSession, id_and_text(docs, id_col, text_col), struct.pack("<I", end_id)
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_last(), "h", "text"]
    rows = rows.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc, out, held = encoder(vocabulary), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                out.append(frame(doc_id.as_py(), enc.ids([text.as_py()])[0] + end))
                held += len(out[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    sorted_rows = rows.repartitionByRange(shards, order[0], "h", "row").sortWithinPartitions(*order).select("doc_id", "text")
    map_batches(sorted_rows, encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")
    read_records(spark, path).select("shard", "file", "doc_id", "offset", "size", "n_tokens").write.parquet(f"{path}/index")
    return path


RECORDS = "shard int, file string, doc_id long, offset long, size long, before long, n_tokens long, ids binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the shards, checksums verified: shard, file, doc_id, offset, size, before (ids in the shard before
    it), n_tokens, ids."""
    fields = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                name = file.as_py().rsplit("/", 1)[-1]
                shard, before, rows, held = int(re.match(r"part-(\d+)", name)[1]), 0, [], 0
                for at, size, doc_id, ids in frames(content.as_py()):
                    rows.append((shard, name, doc_id, at, size, before, len(ids) // 4, ids))
                    before += len(ids) // 4
                    held += len(ids)
                    if held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return map_batches(files.select("path", "content"), parse, RECORDS)


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(position, doc_id, n_tokens, ids) of records by their places in the index; wanted: file, offset, position.  A shard with wanted
    records is opened once, and only they are decoded and checked, in whatever order they are wanted."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1), strict=True):
                data, rows, held = content.as_py(), [], 0
                for place in places.as_py():
                    _, doc_id, ids = frame_at(data, place["offset"])
                    rows.append((place["position"], doc_id, len(ids) // 4, ids))
                    held += len(ids)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names, kinds = ["position", "doc_id", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    places = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "position")).alias("places"))  # as many as a shard has records, if each is wanted once
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select("content", F.element_at(F.split("path", "/"), -1).alias("file"))
    return map_batches(files.join(places, "file").select("content", "places"), pick, "position long, doc_id long, n_tokens long, ids binary")


def shuffled_records(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """(position, doc_id, n_tokens, ids): all records in a random order that the seed fixes, range-partitioned and sorted by position."""
    index = spark.read.parquet(f"{path}/index")
    order = F.xxhash64("file", "offset", F.lit(seed))  # a place's position; equal ones would stand side by side
    found = read_at(spark, path, index.select("file", "offset", order.alias("position")))
    return found.repartitionByRange(F.col("position"), F.crc32("ids")).sortWithinPartitions("position")


def record_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all records before it), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = read_records(spark, path).select("shard", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op6_binary_records(spark, sf_dir):
    import public_tokenizers

    path = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "records"), public_tokenizers.path("word_bpe_49k.json"))
    return record_digests(spark, path)
