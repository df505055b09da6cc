"""Packing documents into windows: best-fit decreasing over the histogram of lengths.

A document longer than a window is first cut into full windows; the rest is an item.  Best-fit
decreasing looks at lengths only, and items of one length are alike, so the whole corpus is planned from
its histogram: at most ``window`` counts on the driver, however many documents there are.  A segment
tree over remaining capacity (which capacities have open windows) finds the tightest one for a
length; runs of windows with the same contents are handled as one.  The plan is a list of runs
(length, ranks, first window, items a window, offset), of which there are O(window log window), because
a run splits in at most three when a length runs out in it and at least halves its capacity otherwise.
It is joined back to the items by (length, rank).

Ranks are counted where the items are made: a task numbers its items of each length, and the
counts of (task, length) are summed over the tasks before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, id_and_text, map_batches, materialise

WINDOW = 2048
#: Bytes of ids in a batch that a task hands on.
BATCH_BYTES = 4 << 20

PIECES = "part int, doc_id long, start long, length int, doc_tokens long, rank long, ids binary"


def tokenised_pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids of every document, its end id with it, written to the shared folder:
    full windows first, then the rest.  ids: little-endian unsigned 32-bit integers."""
    end = np.array([end_id], "<u4").tobytes()
    fields = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("rank", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc, part, met = encoder(vocabulary), TaskContext.get().partitionId(), [0] * (window + 1)
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = enc.ids([text.as_py()])[0] + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rows.append((part, doc_id.as_py(), start, length, n, met[length], ids[4 * start : 4 * (start + length)]))
                    met[length] += 1
                    held += 4 * length
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return materialise(map_batches(id_and_text(docs, id_col, text_col), cut, PIECES), "pieces")


class CapacityTree:
    """Runs of open windows by remaining capacity; a segment tree tells which capacities have any."""

    def __init__(self, window: int):
        self.leaves = 1 << (window).bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int) -> None:
        i, now = self.leaves + capacity, bool(self.runs[capacity])
        while i and self.any[i] != now:
            self.any[i] = now
            i //= 2
            now = self.any[2 * i] or self.any[2 * i + 1]

    def push(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.runs[capacity].append((first, n))
            self._mark(capacity)

    def pop_tightest(self, length: int) -> tuple[int, int, int] | None:
        """(capacity, first window, windows) of a run with the least capacity of at least ``length``."""
        i = self.leaves + length
        while not self.any[i]:
            while i % 2:  # a right child: go up until there is a right neighbour
                i //= 2
            if i <= 1:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return capacity, *run


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``counts`` items of each length.  Runs (length, low, high, first, each, offset): the item of
    rank k, low <= k < high, is in window first + (k - low) // each at offset + (k - low) % each * length."""
    tree, opened, plan = CapacityTree(window), 0, []
    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            found = tree.pop_tightest(length)
            if found is None:
                n = -(-(total - rank) // (window // length))
                found, opened = (window, opened, n), opened + n
            capacity, first, n = found
            each = capacity // length  # having taken an item, a window is tighter than its like and takes the next
            full = min(n, (total - rank) // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, window - capacity))
                tree.push(capacity - each * length, first, full)
                rank, first, n = rank + full * each, first + full, n - full
            if n and rank < total:
                plan.append((length, rank, total, first, each, window - capacity))
                tree.push(capacity - (total - rank) * length, first, 1)
                rank, first, n = total, first + 1, n - 1
            tree.push(capacity, first, n)
    return plan


def assign_windows(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (part, length, rank and any other columns) with sequence_id and offset in place of part and rank."""
    spark = pieces.sparkSession
    counts = materialise(pieces.groupBy("part", "length").count(), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most ``window`` rows
    runs = plan_windows(histogram, window)
    plan = spark.createDataFrame(runs, "length int, low long, high long, first long, each long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    items = pieces.join(bases, ["part", "length"]).withColumn("nth", F.col("base") + F.col("rank"))
    k = F.col("nth") - F.col("low")
    placed = items.join(hinted(plan.withColumnRenamed("length", "len"), len(runs), 64), (F.col("length") == F.col("len")) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(k / F.col("each"))).withColumn("offset", F.col("at") + F.pmod(k, F.col("each")) * F.col("length"))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "rank")], "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    Null or empty text: one piece with the end id alone.  Very long texts: full windows and one rest.
    Null ids and repeated rows: packed like any other.  Empty table: no rows.  Further columns are ignored.
    """
    return assign_windows(tokenised_pieces(docs, vocabulary, end_id, window, id_col, text_col), window)


def packed_digests(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """pack_documents with the ids' CRC-32 in place of the ids, which then needn't move."""
    pieces = tokenised_pieces(docs, vocabulary, end_id, window).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = assign_windows(pieces, window)
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_packing(spark, sf_dir):
    import public_tokenizers

    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
