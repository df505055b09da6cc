"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is a leaf.  Its rows become a run: records sorted by digest, in which each digest appears once, with
the best row so far and the number of rows.  In binomial rounds of ``fan_in`` partners, neighbouring runs are exchanged and merged: round r
makes one run of fan_in**r leaves by a multiway merge, in which equal digests leave one record again.  After the last
round there is a single run.  No task ever gathers a run: a run is cut into slices by ranges of the digest, as many more in each round
as the run is longer, and partners exchange equal slices.  A digest shared by a third of all rows reaches a merge at
most once for each run.

A digest is (SHA-256, byte length, xxHash64) of the normalised text.  The two further parts verify
the first at every level: texts that agree in SHA-256 only are never merged.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, id_and_text, map_batches, materialise, with_unique_ids

DIGEST = ["sha", "n_norm", "check"]
#: Records of a slice of a merged run, about, and of a leaf's run that is handed on at once.
SLICE, LEAF = 200_000, 200_000
#: A record: SHA-256, length and hash as one string of bytes in their order, then the best row (code points, id, whether it has one, number) and the rows.
RECORD = np.dtype([("key", "S48"), ("n_chars", "<i8"), ("doc_id", "<i8"), ("no_id", "?"), ("row", "<i8"), ("size", "<i8")])
RUN = "run long, slice long, records binary"


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, row number, leaf, code points of the text, digest of the normalised text."""
    norm = F.regexp_replace("text", SPACE, "")
    return (
        id_and_text(docs, id_col, text_col)
        .select("doc_id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("leaf"), F.length("text").cast("long").alias("n_chars"), norm.alias("norm"))
        .select("doc_id", "row", "leaf", "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").cast("long").alias("n_norm"), F.xxhash64("norm").alias("check"))
    )


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """The merge of sorted runs: of equal digests, the record with the most code points, then the smallest id (none comes last), then the
    first row; sizes add up."""
    every = np.concatenate(runs)
    every = every[np.argsort(every["key"], kind="stable")]  # runs one after the other: a merge of them
    first = np.flatnonzero(np.concatenate(([True], every["key"][1:] != every["key"][:-1])))
    sizes = np.add.reduceat(every["size"], first)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(every))))
    best = np.lexsort((every["row"], every["doc_id"], every["no_id"], -every["n_chars"], group))[first]
    out = every[best]
    out["size"] = sizes
    return out


def _slices(run: int, records: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes]]:
    """A sorted run's slices by ranges of the digest's first 32 bits."""
    at = (np.ascontiguousarray(records["key"]).view(">u4").reshape(len(records), 12)[:, 0].astype(np.uint64) * np.uint64(n)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True]))) if len(at) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield run, int(at[lo]), records[lo:hi].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["run", "slice", "records"])


def leaf_runs(runs: DataFrame, slices: int) -> DataFrame:
    """The leaves' runs, in slices; a leaf of very many rows hands on several."""

    def records(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, RECORD)
        sha, numbers = b"".join(batch.column(3).to_pylist()), np.zeros((batch.num_rows, 2), ">u8")
        numbers[:, 0], numbers[:, 1] = batch.column(4).to_numpy(), batch.column(5).to_numpy().view(np.uint64)
        whole = np.hstack([np.frombuffer(sha, np.uint8).reshape(-1, 32), numbers.view(np.uint8).reshape(-1, 16)])
        out["key"] = np.ascontiguousarray(whole).view("S48").ravel()
        out["no_id"] = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        out["doc_id"], out["row"], out["n_chars"], out["size"] = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}  # a task may read several leaves' rows back
        n = 0
        for batch in batches:
            leaf, rows = batch.column(6).to_numpy(), records(batch)
            for k in np.unique(leaf).tolist():
                own = rows[leaf == k]
                held.setdefault(k, []).append(own[np.argsort(own["key"], kind="stable")])
            n += len(rows)
            if n > LEAF:
                yield _batch([x for k, parts in held.items() for x in _slices(k, merged(parts), slices)])
                held, n = {}, 0
        if held:
            yield _batch([x for k, parts in held.items() for x in _slices(k, merged(parts), slices)])

    return map_batches(runs.select("doc_id", "row", "n_chars", *DIGEST, "leaf"), run, RUN)


def merge_round(level: DataFrame, fan_in: int, slices: int, tasks: int) -> DataFrame:
    """Merge each fan_in neighbouring runs, slice by slice; the new run's slices are cut to ``slices``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns, strict=True))
        for (of, _), own in itertools.groupby(rows, lambda r: r[:2]):
            held, n = [], 0
            for _, _, data in own:
                held.append(np.frombuffer(data, RECORD))
                n += len(held[-1])
                if n > 4 * SLICE:  # copies leave one record each, so that this shrinks
                    held = [merged(held)]
                    n = len(held[0]) // 2
            yield _batch(list(_slices(of, merged(held), slices)))

    run_no = F.floor(F.col("run") / F.lit(fan_in)).alias("run")
    return map_batches(level.select(run_no, "slice", "records").repartition(tasks, "run", "slice").sortWithinPartitions("run", "slice"), run, RUN)


def merge_runs(runs: DataFrame, leaves: int, fan_in: int = 16) -> DataFrame:
    """(sha, n_norm, check, group_size, keep_id, keep_row): the single run that ceil(log(leaves, fan_in)) rounds leave."""
    rows, rounds = runs.count(), max(1, math.ceil(math.log(max(leaves, 2), fan_in) - 1e-9))
    cut = lambda r: max(1, math.ceil(rows * min(1.0, fan_in**r / leaves) / SLICE))  # noqa: E731  slices of a run of round r
    level = leaf_runs(runs, cut(1))
    for r in range(1, rounds + 1):
        # runs come with the slices of their own round and leave with those of the next, so that partners' slices match
        level = merge_round(level, fan_in, cut(r + 1), max(1, math.ceil(leaves / fan_in**r)) * cut(r))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                x = np.frombuffer(data.as_py(), RECORD)
                key = np.ascontiguousarray(x["key"]).view(np.uint8).reshape(-1, 48)
                numbers = np.ascontiguousarray(key[:, 32:]).view(">u8").reshape(-1, 2)
                sha = pa.array([k.tobytes() for k in key[:, :32]], pa.binary())
                keep = pa.array(x["doc_id"].copy(), mask=x["no_id"].copy())
                yield pa.RecordBatch.from_arrays([sha, pa.array(numbers[:, 0].astype(np.int64)), pa.array(numbers[:, 1].astype(np.uint64).view(np.int64)), pa.array(x["size"].copy()), keep, pa.array(x["row"].copy())], [*DIGEST, "group_size", "keep_id", "keep_row"])

    return map_batches(level.select("records"), unpack, "sha binary, n_norm long, check long, group_size long, keep_id long, keep_row long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without ASCII white space.  Null text: as empty; empty texts form one
    group.  Very long texts: read whole.  Repeated rows: members like any other, of which one is kept.  Null doc_id: kept only if its
    group has no other id.  Empty table: no rows.  Further columns are ignored.
    """
    runs = materialise(digest_runs(docs, id_col, text_col), "digests")
    leaves = (runs.agg(F.max("leaf")).first()[0] or 0) + 1
    found = materialise(merge_runs(runs, leaves, fan_in), "merged")  # so that the join may split a large group's rows
    return runs.join(found, DIGEST).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay.  The text moves once, for the semi join with the ids that stay.  Nulls, repeated rows and
    empty tables: as in exact_groups; where ids are null or repeated, rows are numbered in place of them."""
    told, key = with_unique_ids(docs, id_col)
    if key == id_col:
        stays = exact_groups(told, id_col, text_col).filter("kept").select(F.col("doc_id").alias(key))
        return told.join(stays, key, "left_semi").select(docs.columns)
    groups = exact_groups(told.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")))  # rows in place of ids
    return told.join(groups.filter("kept").select(F.col("doc_id").alias(key)), key, "left_semi").select(docs.columns)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS pos
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, pos = 1 AS kept, text_sha256 FROM r
"""


def op9_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).drop("row")
