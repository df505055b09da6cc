"""Exact top-k inner products: norm-sorted vectors, rotated partial sums, residual bounds.

Candidates are range-partitioned by descending length and packed into blocks of a bounded number of rows and bytes.  Each query
starts from a floor, its k-th score among the HEAD longest vectors.  A vector shorter than floor / |q| cannot enter, so of the groups
of blocks, in order of length, a block of queries (those of like floors together) meets only the first ones; the others
are dropped before any matrix moves.  What is left is an equi join on the group (a stated query set against all rows, in blocks).
In such a cell candidates are taken in order of length: once |q| |c| is below a query's k-th score so far, neither that vector nor a later one can
enter.  Otherwise the first ``lead`` coordinates after a rotation onto the principal axes give a partial sum,
and Cauchy-Schwarz bounds the rest by the product of the residual lengths; only vectors whose bound
reaches the k-th score get an exact integer product.

The rotation comes from a bounded sample (SAMPLE vectors); it speeds up pruning and cannot change results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise

SCALE, TOP = 256, 5
HEAD, SAMPLE = 2048, 20_000
LEAST_BLOCK, MOST_BLOCK, STEP = 1024, 32_768, 1024
#: Bytes of a block's matrix as doubles, about; queries in a block; groups of candidate blocks that the driver knows the longest vector of.
BLOCK_BYTES, QUERIES, GROUPS = 16 << 20, 1024, 4096
EXACT = 2.0**53
#: Stands for a null id, so that it comes last among equals.
NO_ID = 2**63 - 1


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v array<double>, norm): scaled and floored; vectors that are null, or hold null or non-finite
    components, left out.  A null id is NO_ID."""
    v = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.filter(F.col("e").isNotNull()).filter(finite)
    scaled = F.transform("e", lambda x: _floored(x * F.lit(float(SCALE))))
    v = v.select(F.monotonically_increasing_id().alias("row"), "vec_id", scaled.alias("v"))
    return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _floored(x: Column) -> Column:
    """floor as a double; from 2**52 on, every double is whole."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)


def _matrix(lists: list[list[float]]) -> np.ndarray:
    """Rows of components; shorter vectors are filled up with 0."""
    out = np.zeros((len(lists), max((len(x) for x in lists), default=0)))
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _narrow(m: np.ndarray) -> tuple[str, bytes]:
    kind = "<i4" if not m.size or np.abs(m).max() < 2**31 else "<f8"
    return kind, m.astype(kind).tobytes()


BLOCK_FIELDS = "part int, norm double, n int, width int, kind string, rows binary, ids binary, m binary"


def _packed(df: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` of a task's rows, in their order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []

        def block(rows):
            m = _matrix([r[2] for r in rows])
            kind, raw = _narrow(m)
            values = [part, float(np.sqrt(np.square(m).sum(1).max())), len(rows), m.shape[1], kind, np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[1] for r in rows], "<i8").tobytes(), raw]
            kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in BLOCK_FIELDS.split(", ")])

        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                piece = batch.slice(lo, STEP)
                held += zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True)
                while len(held) >= size:
                    yield block(held[:size])
                    held = held[size:]
        if held:
            yield block(held)

    return map_batches(df.select("row", "vec_id", "v"), pack, BLOCK_FIELDS)


QUERY_FIELDS = "n int, width int, kind string, rows binary, ids binary, m binary, floors binary, shortest double"


def _query_blocks(df: DataFrame, search, size: int) -> DataFrame:
    """Blocks of queries with their floors and the least length of a vector that may enter for one of them; within a few blocks' rows,
    queries of like lengths come together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(held):
            m = _matrix([r[2] for r in held])
            rows, ids = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
            floors = np.concatenate([search.value.floor(rows[lo : lo + STEP], m[lo : lo + STEP]) for lo in range(0, len(m), STEP)])
            norm = np.sqrt(np.square(m).sum(1))
            shortest = np.where(norm > 0, (floors - 1e-6) / (np.maximum(norm, 1e-300) * (1 + 1e-9)), -np.inf)
            order = np.argsort(shortest, kind="stable")
            for lo in range(0, len(order), size):
                at = order[lo : lo + size]
                kind, raw = _narrow(m[at])
                values = [len(at), m.shape[1], kind, rows[at].astype("<i8").tobytes(), ids[at].astype("<i8").tobytes(), raw, floors[at].astype("<f8").tobytes(), float(shortest[at[0]])]
                kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in QUERY_FIELDS.split(", ")])

        held: list[tuple] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                piece = batch.slice(lo, STEP)
                held += zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True)
                if len(held) >= 4 * size:
                    yield from blocks(held)
                    held = []
        if held:
            yield from blocks(held)

    return map_batches(df.select("row", "vec_id", "v"), pack, QUERY_FIELDS)


def _unpack(n: int, width: int, kind: str, rows: bytes, ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(m, kind).reshape(n, width).astype(float)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of q's rows with c's: in doubles where all sums fit, else in Python's integers, held within a long."""
    if not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(q) @ whole(c).T, -(2**63), 2**63 - 1).astype(np.int64)


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Search:
    """Cells of query and candidate blocks; ``axes``: principal axes in columns, ``head``: the longest vectors."""

    def __init__(self, axes: np.ndarray, lead: int, head: tuple[np.ndarray, np.ndarray, np.ndarray], top: int):
        self.axes, self.lead, self.head, self.top = axes, lead, head, top

    def _rotated(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the length of the rest with room for rounding."""
        r = _widened(m, len(self.axes)) @ self.axes
        return r[:, : self.lead], np.sqrt(np.square(r[:, self.lead :]).sum(1))

    def floor(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A score that each query's k-th best reaches: its k-th best of the head, itself left out."""
        hrows, _, h = self.head
        width = max(q.shape[1], h.shape[1])
        s = _products(_widened(q, width), _widened(h, width)).astype(float)
        s[rows[:, None] == hrows[None, :]] = -np.inf
        if s.shape[1] < self.top:
            return np.full(len(q), -np.inf)
        return np.partition(s, s.shape[1] - self.top, axis=1)[:, s.shape[1] - self.top]

    def cell(self, query: tuple, floors: np.ndarray, candidate: tuple) -> Iterator[tuple[int, int, int, int]]:
        """(query row, query id, vec_id, score) of each query's best in the block.  floors: scores that each query's k-th best reaches."""
        (qrows, qids, q), (crows, cids, c) = query, candidate
        floors = floors.copy()
        width = max(q.shape[1], c.shape[1], len(self.axes))
        q, c = _widened(q, width), _widened(c, width)
        if width > len(self.axes):  # wider than any vector of the sample
            self = Search(np.pad(self.axes, ((0, width - len(self.axes)), (0, width - len(self.axes)))) + np.diag([0.0] * len(self.axes) + [1.0] * (width - len(self.axes))), self.lead, self.head, self.top)
        qn, cn = np.sqrt(np.square(q).sum(1)), np.sqrt(np.square(c).sum(1))
        (ql, qrest), (cl, crest) = self._rotated(q), self._rotated(c)
        room = 1e-9 * (qn * (cn.max() if len(cn) else 0)) + 1e-6
        best: list[list[tuple[int, int]]] = [[] for _ in qrows]
        for lo in range(0, len(c), STEP):
            part = slice(lo, lo + STEP)
            live = np.flatnonzero(qn * cn[lo] + room >= floors)
            if not len(live):
                break
            bound = ql[live] @ cl[part].T + np.outer(qrest[live], crest[part]) + room[live, None]
            near = bound >= floors[live, None]
            near &= qrows[live, None] != crows[None, part]
            some = np.flatnonzero(near.any(1))
            if not len(some):
                continue
            cols = np.flatnonzero(near[some].any(0))
            exact = _products(q[live[some]], c[part][cols])
            ids = cids[part][cols]
            for k, i in enumerate(some):
                row = live[i]
                hit = np.flatnonzero(near[i, cols] & (exact[k] >= floors[row]))
                if len(hit):
                    order = hit[np.lexsort((ids[hit], -exact[k, hit]))][: self.top]
                    best[row] = sorted(best[row] + [(-int(exact[k, j]), int(ids[j])) for j in order])[: self.top]
                    if len(best[row]) == self.top:
                        floors[row] = max(floors[row], -best[row][-1][0])
        for row, found in enumerate(best):
            for s, i in found:
                yield int(qrows[row]), int(qids[row]), i, -s


def top_products(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """Each query's ``top`` highest inner products: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    is_query: a condition on vec_id.  Queries are rows; candidates are all rows but the query's own, so of repeated
    rows each finds the others.  Null vectors and vectors with null or non-finite components take no part.  Rows with null ids are candidates, last among
    equals (an id of 2**63 - 1 reads as null), and no queries.  Vectors of several lengths: the shorter are filled up with 0.  Scores beyond a long: held at its ends.  Further
    columns are ignored.  Empty table: no rows.
    """
    spark = vectors.sparkSession
    usable = materialise(usable_vectors(vectors, id_col, vector_col), "vectors")
    n, width = usable.agg(F.count("*"), F.max(F.size("v"))).first()
    columns = ["row", "vec_id", "v"]
    sample = usable.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)))).select("v").toPandas()
    m = _matrix([list(x) for x in sample["v"]])
    spread, axes = np.linalg.eigh(m.T @ m) if m.size else (np.zeros(m.shape[1]), np.eye(m.shape[1]))
    axes, spread = axes[:, ::-1], spread[::-1]
    lead = min(len(spread), 1 + int(np.searchsorted(np.cumsum(spread), 0.8 * spread.sum()))) if len(spread) else 0
    longest = usable.orderBy(F.col("norm").desc(), "row").limit(HEAD).select(columns).toPandas()
    head = (longest["row"].to_numpy(np.int64), longest["vec_id"].to_numpy(np.int64), _matrix([list(x) for x in longest["v"]]))
    search = spark.sparkContext.broadcast(Search(np.ascontiguousarray(axes), lead, head, top))  # HEAD vectors and a square matrix

    largest = max(1, min(MOST_BLOCK, BLOCK_BYTES // (8 * max(1, width or 0))))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_BLOCK)))
    size = min(largest, max(LEAST_BLOCK, -(-n // parts)))
    parts = max(parts, -(-n // largest))
    sorted_rows = usable.repartitionByRange(parts, F.col("norm").desc(), "row").sortWithinPartitions(F.col("norm").desc(), "row")
    blocks = _packed(sorted_rows, size).withColumn("group", F.floor(F.col("part") / F.lit(-(-parts // GROUPS))).cast("int"))
    blocks = materialise(blocks, "blocks")
    known = blocks.groupBy("group").agg(F.max("norm").alias("norm")).orderBy("group").collect()  # GROUPS numbers at most
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups, tops = [r["group"] for r in known], np.maximum.accumulate([r["norm"] for r in known][::-1])[::-1]  # of that group or a later one
    enough = F.size(F.filter(F.array(*[F.lit(float(t)) for t in tops]), lambda t: t >= F.col("shortest")))
    queries = _query_blocks(usable.filter(is_query & (F.col("vec_id") != NO_ID)), search, max(1, min(QUERIES, largest)))
    queries = queries.withColumn("nth", enough).filter("nth > 0")
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "width", "kind", "rows", "ids", "m")], "floors", F.explode(F.slice(F.array(*[F.lit(g) for g in groups]), F.lit(1), F.col("nth"))).alias("group"))
    pairs = queries.join(blocks, "group").select("q_n", "q_width", "q_kind", "q_rows", "q_ids", "q_m", "n", "width", "kind", "rows", "ids", "m", "floors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = [batch.column(i)[k].as_py() for i in range(13)]
                found = list(search.value.cell(_unpack(*x[:6]), np.frombuffer(x[12], "<f8"), _unpack(*x[6:12])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(4)], ["q", "query_id", "vec_id", "score"])

    best = map_batches(pairs, run, "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def op3_topk(spark, sf_dir):
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rn <> c.rn
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
