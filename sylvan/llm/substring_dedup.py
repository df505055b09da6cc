"""Removal of word passages that an earlier document holds, by difference-cover anchors.

A window is ``window`` words.  Strings of ``window - period + 1`` words are hashed at the places of a document that lie in a difference cover modulo
``period``: any two places i and j have a k below period such that i + k and j + k both lie in it.  Two equal windows, wherever they begin, thus hold
an equal anchor string at the same distance from their beginnings, and only around anchors that recur need anything be compared.

1.  Documents are written in chunks.  A chunk asks which of its distinct anchor strings other chunks have too: 40 further bits of each hash go to a
    bucket of the hash's range, a mask comes back.  That is a filter only.
2.  Extension: an anchor's context is all words of the windows around it.  Equal contexts (two 64-bit hashes) hold equal windows, so that of
    each context the least document stays and the others' windows all go.
3.  Where contexts of a string differ, their windows are compared one by one (two 64-bit hashes), again by the least document.

No pair of documents is ever formed: each step keeps the least document of a key, within a chunk before anything moves, so that a passage of a third
of all documents is a row a chunk.  A document's own repetitions have the same least document and stay.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, buckets, chunked, packed, unpacked
from .common import discard, id_and_text, map_batches, materialise
from .hashing import hashes, mixed, prefix_sums

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
#: Bytes whose words are hashed at once; a longer word is hashed by BLAKE2.
STRIDE = 1 << 20
#: Bytes of text whose anchors a bucket is planned for, and buckets at most.
BUCKET_TEXT, BUCKETS = 32 << 20, 1 << 16
#: The least id stands for null.
NO_ID = -(2**63)
SECOND = np.uint64(0xD6E8FEB86659FD93)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
ROWS = 100_000


def check_cover(window: int, period: int, cover: tuple[int, ...]) -> None:
    if not 1 <= period <= window or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period} for windows of {window}")


class Words:
    """A text's words, and 64-bit hashes (two independent ones) of any run of them."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], BLANK[data], [True])).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        n, lo = len(self.starts), 0
        self.hashes = np.empty(n, np.uint64)
        while lo < n:
            base = self.starts[lo]
            hi = int(np.searchsorted(self.ends, base + STRIDE, "right"))
            if hi <= lo:
                self.hashes[lo] = int.from_bytes(hashlib.blake2b(text[base : self.ends[lo]], digest_size=8).digest(), "little")
                hi = lo + 1
            else:
                self.hashes[lo:hi] = hashes(prefix_sums(data[base : self.ends[hi - 1]]), self.starts[lo:hi] - base, self.ends[lo:hi] - base)
            lo = hi
        self.sums: dict[int, np.ndarray] = {}

    def run(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if which not in self.sums:
            self.sums[which] = prefix_sums(mixed(self.hashes ^ SECOND) if which else self.hashes)
        return hashes(self.sums[which], start, end)


class Documents:
    """Documents one after the other: words, and each one's first word and number of words."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.window, self.gram = window, gram
        self.words = Words(b"\n".join(texts))
        offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.base = np.searchsorted(self.words.starts, offset)
        self.n = np.diff(self.base)

    def anchors(self, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(document, place of the string in it) in order."""
        doc = np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(len(doc)) - self.base[doc]
        own = np.isin(np.arange(period), cover)[at % period] & (at + self.gram <= self.n[doc]) & (self.n[doc] >= self.window)
        return doc[own], at[own]

    def strings(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        first = self.base[doc] + at
        return self.words.run(0, first, first + self.gram)

    def around(self, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of all windows that hold the string, as a range in the document."""
        return np.maximum(at - (self.window - self.gram), 0), np.minimum(at + self.window, self.n[doc])

    def contexts(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = self.around(doc, at)
        return mixed(self.words.run(1, self.base[doc] + low, self.base[doc] + high) + (at - low).astype(np.uint64))

    def windows(self, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct windows that hold these strings: document, beginning, two hashes."""
        low, high = self.around(doc, at)
        n = high - low - self.window + 1
        begin = np.repeat(self.base[doc] + low - np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64), n) + np.arange(n.sum())
        begin = np.unique(begin)
        of = np.searchsorted(self.base, begin, "right") - 1
        return of, begin - self.base[of], *(self.words.run(which, begin, begin + self.window) for which in (0, 1))


def _distinct(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of each distinct (a, b) in order the row with the least rank, each row's number in that order)."""
    by = np.lexsort((rank, b, a))
    new = np.concatenate(([True], (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])))[: len(by)]
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(new) - 1
    return by[new], group


def _least(ids: np.ndarray, doc: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Whether a row's document is the least of those with its ref."""
    low = np.full(int(ref.max(initial=-1)) + 1, 2**63 - 1, np.int64)
    np.minimum.at(low, ref, ids[doc])
    return ids[doc] == low[ref]


def _marked(refs: list[int], ref: np.ndarray) -> np.ndarray:
    """Which of ref are among refs."""
    mark = np.zeros(int(ref.max(initial=-1)) + 1, bool)
    mark[refs] = True
    return mark[ref]


def _keys(ids: list[int | None]) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in ids], np.int64)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64).view(np.int64))


CHUNKS = "chunk long, docs binary"
SCANNED = "chunk long, string long, context long, doc long, ref int, live binary, doc_id long, n_words long, text string"
NAMES = [f.split()[0] for f in SCANNED.split(", ")]
KINDS = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string()]


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(NAMES, KINDS, strict=True)], NAMES)


class Passages:
    """The steps over documents (doc_id, text)."""

    def __init__(self, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, chunk_bytes: int = CHUNK_BYTES, bucket_text: int = BUCKET_TEXT):
        check_cover(window, period, cover)
        self.shape, self.chunk_bytes, self.bucket_text = (window, window - period + 1, period, tuple(cover)), chunk_bytes, bucket_text

    def write_chunks(self, docs: DataFrame) -> DataFrame:
        size = self.chunk_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, ids, texts in chunked(batches, size):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})], pa.binary())], ["chunk", "docs"])

        return materialise(map_batches(docs, run, CHUNKS), "chunks")

    def _read(self, data: bytes) -> tuple[list[int | None], list[bytes]]:
        batch = unpacked(data)
        return batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]

    def shared_anchors(self, chunks: DataFrame, n: int) -> DataFrame:
        """(chunk, masks): which of a chunk's sorted distinct strings other chunks may have too, by bucket."""
        (window, gram, period, cover), read = self.shape, self._read

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, data in zip(batch.column(0), batch.column(1), strict=True):
                    docs = Documents(read(data.as_py())[1], window, gram)
                    strings = np.unique(docs.strings(*docs.anchors(period, cover)))
                    low = strings.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    rows = [(b, low[x:y].tobytes()) for b, x, y in buckets(strings, n)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], ["chunk", "bucket", "strings"])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns, strict=True))
            for bucket, own in itertools.groupby(rows, lambda r: r[1]):
                asked, parts = [], []
                for chunk, _, data in own:
                    wide = np.zeros((len(data) // 5, 8), np.uint8)
                    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
                    asked.append((chunk, len(wide)))
                    parts.append(wide.view("<u8").ravel())
                every = np.concatenate(parts)
                by = np.argsort(every, kind="stable")
                same = every[by][1:] == every[by][:-1]
                again = np.zeros(len(every), bool)
                again[by] = np.append(same, False) | np.append(False, same)
                edge = np.cumsum([0, *(k for _, k in asked)])
                masks = [np.packbits(again[x:y]).tobytes() for x, y in itertools.pairwise(edge)]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in asked], pa.int64()), pa.array([bucket] * len(asked), pa.int32()), pa.array(masks, pa.binary())], ["chunk", "bucket", "mask"])

        asked = map_batches(chunks, ask, "chunk long, bucket int, strings binary").repartition(min(n, 4096), "bucket").sortWithinPartitions("bucket")
        told = map_batches(asked, answer, "chunk long, bucket int, mask binary")
        return told.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "mask"))).alias("masks"))

    def contexts(self, chunks: DataFrame, masks: DataFrame, n: int) -> DataFrame:
        """SCANNED rows of three kinds: a context's least document in a chunk (ref not null), a chunk's documents with recurring anchors (live), and
        the other documents, which are done."""
        (window, gram, period, cover), read = self.shape, self._read

        def rows_of(chunk: int, data: bytes, told: list[dict]) -> Iterator[pa.RecordBatch]:
            ids, texts = read(data)
            docs = Documents(texts, window, gram)
            doc, at = docs.anchors(period, cover)
            string = docs.strings(doc, at)
            strings, which, times = np.unique(string, return_inverse=True, return_counts=True)
            again = times > 1
            by = {t["bucket"]: t["mask"] for t in told or []}
            for b, x, y in buckets(strings, n):
                again[x:y] |= np.unpackbits(np.frombuffer(by[b], np.uint8), count=y - x).astype(bool)
            own = again[which] if len(which) else np.zeros(0, bool)
            doc, at, string = doc[own], at[own], string[own]
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            done = np.flatnonzero(edge[1:] == edge[:-1]).tolist()
            for lo in range(0, len(done), 1000):
                part = done[lo : lo + 1000]
                yield _batch(len(part), doc_id=[ids[k] for k in part], n_words=docs.n[part], text=[b" ".join(texts[k].split()).decode() for k in part])
            if not len(doc):
                return
            context, rank = docs.contexts(doc, at), _keys(ids)[doc]
            first, ref = _distinct(string, context, rank)
            live = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
            places = lambda c: pa.array([c[edge[k] : edge[k + 1]].astype("<i4").tobytes() for k in live], pa.binary())
            yield _batch(1, chunk=[chunk], live=[packed({"doc_id": pa.array([ids[k] for k in live], pa.int64()), "text": pa.array([texts[k] for k in live], pa.large_binary()), "at": places(at), "ref": places(ref)})])
            for lo in range(0, len(first), ROWS):
                f = first[lo : lo + ROWS]
                yield _batch(len(f), chunk=np.full(len(f), chunk), string=_signed(string[f]), context=_signed(context[f]), doc=rank[f], ref=np.arange(lo, lo + len(f), dtype=np.int32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, data, told in zip(*batch.columns, strict=True):
                    yield from rows_of(chunk.as_py(), data.as_py(), told.as_py())

        return materialise(map_batches(chunks.join(masks, "chunk", "left").select("chunk", "docs", "masks"), run, SCANNED), "scanned")

    @staticmethod
    def _live(data: bytes) -> tuple[list[int | None], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(ids, texts, each recurring anchor's document, place and ref)."""
        ids, texts, at, ref = (c.to_pylist() for c in unpacked(data).columns)
        doc = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in at])
        return ids, texts, doc, *(np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (at, ref))

    def _open_windows(self, ids: list[int | None], texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the windows around these anchors: document, beginning, two hashes, first and number of distinct ones.  Other documents aren't looked at."""
        some, place = np.unique(doc, return_inverse=True)
        window, gram, *_ = self.shape
        of, begin, x, y = Documents([texts[k] for k in some.tolist()], window, gram).windows(place, at)
        of = some[of] if len(some) else of
        return of, begin, x, y, *_distinct(x, y, _keys(ids)[of])

    def compare_contexts(self, scanned: DataFrame) -> DataFrame:
        """(chunk, covered, open): refs of contexts that a lesser document has, and of those whose windows are still to be compared."""
        rows = scanned.filter("ref IS NOT NULL").select("string", "context", "doc", "chunk", "ref")
        key = ["string", "context"]
        least = materialise(rows.groupBy(*key).agg(F.min("doc").alias("least")), "contexts")  # so that the joins may split a hot key's rows
        several = materialise(least.groupBy("string").count().filter("count > 1").select("string"), "strings")
        told = rows.join(least, key).withColumn("covered", F.col("doc") > F.col("least"))
        covered = told.filter("covered").select("chunk", "ref", "covered")
        windows = told.filter("NOT covered").join(several, "string").select("chunk", "ref", "covered")
        lists = covered.unionByName(windows).groupBy("chunk").agg(F.collect_list(F.when(F.col("covered"), F.col("ref"))).alias("covered"), F.collect_list(F.when(~F.col("covered"), F.col("ref"))).alias("open"))
        return materialise(lists, "told")

    def compare_windows(self, live: DataFrame, told: DataFrame) -> DataFrame:
        """(chunk, gone): numbers of the open windows that a lesser document has."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, data, refs in zip(*(batch.column(k) for k in range(3)), strict=True):
                    ids, texts, doc, at, ref = self._live(data.as_py())
                    own = _marked(refs.as_py(), ref) & _least(_keys(ids), doc, ref)
                    of, _, x, y, first, _ = self._open_windows(ids, texts, doc[own], at[own])
                    rank = _keys(ids)[of]
                    for lo in range(0, len(first), ROWS):
                        f = first[lo : lo + ROWS]
                        yield pa.RecordBatch.from_arrays([_signed(x[f]), _signed(y[f]), pa.array(rank[f]), pa.array(np.full(len(f), chunk.as_py())), pa.array(np.arange(lo, lo + len(f), dtype=np.int32))], ["x", "y", "doc", "chunk", "ref"])

        asked = live.join(told.filter(F.size("open") > 0).select("chunk", "open"), "chunk").select("chunk", "live", "open")
        rows = materialise(map_batches(asked, run, "x long, y long, doc long, chunk long, ref int"), "windows")
        least = materialise(rows.groupBy("x", "y").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most"), "least")
        return rows.join(least, ["x", "y"]).filter("doc > least").groupBy("chunk").agg(F.collect_list("ref").alias("gone"))

    def cut(self, live: DataFrame, told: DataFrame, gone: DataFrame) -> DataFrame:
        """(doc_id, n_words, spans, text) of the live documents."""
        window, gram, *_ = self.shape

        def cuts(data: bytes, covered: list[int], opened: list[int], gone: list[int]) -> Iterator[tuple]:
            ids, texts, doc, at, ref = self._live(data)
            rank, words = _keys(ids), [t.split() for t in texts]
            n, least = np.array([len(w) for w in words]), _least(rank, doc, ref)
            settled = _marked(covered, ref) | ~least
            low, high = np.maximum(at - (window - gram), 0)[settled], np.minimum(at + window, n[doc])[settled]
            own = _marked(opened, ref) & least
            of, begin, _, _, first, group = self._open_windows(ids, texts, doc[own], at[own])
            again = _marked(gone, group) | (rank[of] > rank[of[first]][group])
            of, low, high = np.concatenate((doc[settled], of[again])), np.concatenate((low, begin[again])), np.concatenate((high, begin[again] + window))
            by = np.argsort(of, kind="stable")
            edge = np.searchsorted(of[by], np.arange(len(ids) + 1))
            for k, own_words in enumerate(words):
                mine = by[edge[k] : edge[k + 1]]
                depth = np.bincount(low[mine], minlength=n[k] + 1) - np.bincount(high[mine], minlength=n[k] + 1)
                out = np.cumsum(depth[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
                yield ids[k], len(own_words), [{"start": int(x), "until": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)], b" ".join(itertools.compress(own_words, (~out).tolist())).decode()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    rows = cuts(row[0].as_py(), *(c.as_py() or [] for c in row[1:]))
                    while part := list(itertools.islice(rows, 1000)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64())])), pa.string()), strict=True)], ["doc_id", "n_words", "spans", "text"])

        every = live.join(told, "chunk", "left").join(gone, "chunk", "left").select("live", "covered", "open", "gone")
        return map_batches(every, run, "doc_id long, n_words long, spans array<struct<start:long,until:long>>, text string")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (runs of words removed, ascending), text (the other words, joined by a space).

    A word goes if a window of ``window`` words around it also begins in a document with a smaller id.  Null text: empty.  Fewer words than a window: nothing goes.  Very
    long texts: read whole, a chunk alone.  Null ids: smaller than all others.  Repeated rows and equal ids: neither is smaller, so both keep what only
    they hold.  Empty table: no rows.  Further columns are ignored.
    """
    p = Passages(**options)
    rows = id_and_text(docs, id_col, text_col)
    chunks = p.write_chunks(rows)
    n = max(1, min(BUCKETS, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // p.bucket_text)))
    scanned = p.contexts(chunks, p.shared_anchors(chunks, n), n)
    discard(chunks)
    told = p.compare_contexts(scanned)
    live = scanned.filter("live IS NOT NULL").select("chunk", "live")
    cut = p.cut(live, told, p.compare_windows(live, told))
    done = scanned.filter("n_words IS NOT NULL").select("doc_id", "n_words", F.array().cast("array<struct<start:long,until:long>>").alias("spans"), "text")
    return cut.unionByName(done)


def op11_substring_dedup(spark, sf_dir):
    cut = remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"), "text")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS said FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM d)
), m AS (
  SELECT said, min(doc_id) AS least FROM w GROUP BY said HAVING min(doc_id) < max(doc_id)
), g AS (
  SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM w JOIN m USING (said) WHERE doc_id > least) GROUP BY doc_id
), k AS (
  SELECT d.doc_id, words, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS kept
  FROM (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d) d LEFT JOIN g ON g.doc_id = d.doc_id
  WHERE gone IS NULL OR NOT list_contains(gone, j) GROUP BY d.doc_id, words
)
SELECT d.doc_id, len(d.words) AS n_words, len(d.words) - coalesce(kept, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(k.text, '') AS text
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
