"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Which bytes lie in a string of ``length`` bytes that also starts elsewhere?  Suffixes are sampled so that nothing is
lost: every window of ``length`` bytes has an anchor, the leftmost of its ``gram``-byte strings with the least
hash, which depends on the window's bytes alone.  Equal windows therefore have equal anchor strings at equal places,
and only windows of the same anchor string need be compared.  Anchors are about 2 / (length - gram + 2) of all bytes.

1.  Each document's anchors: hash of the anchor string, digest of its context (all bytes of its windows), and the
    windows it stands for.  Anchors whose context recurs within the document are settled at once.
2.  Anchor strings met once are dropped; the hash is a filter only.  Contexts met twice (equal 128-bit BLAKE2 digests of their bytes)
    settle all their windows.
3.  The other contexts are dealt out by anchor string.  A task takes them in batches.  A batch gets its suffix array: the suffixes from the
    anchors on, cut to ``length``, in the order of their bytes.  The array is merge-scanned against each level of the task's family: of a
    level, binary search by bytes finds the suffixes that begin with one of the batch's anchors, and in the merged order the common
    prefixes, together with those of the reversed bytes before the anchors, tell which windows are equal, byte for byte.  Then it becomes a
    level, and levels of equal size merge, so that a suffix is merged O(log) times.  Of an anchor's windows only the
    first and last repeated one matter: there are fewer than ``length``, so what is between them is covered.
4.  A string with more than ``hot`` distinct contexts isn't gathered: its windows become rows that are counted by
    128-bit digest, with partial sums before the exchange.

Documents are told apart by (doc_id, hash of the text), so repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, map_batches, materialise
from .hashing import hashes, prefix_sums

LENGTH = 400
#: Distinct contexts of an anchor string that one task takes at most, and contexts of all its strings that it is planned for.
HOT, FAMILY = 50_000, 20_000
#: Window starts handled at once, and contexts in a batch.
CHUNK, BATCH = 1 << 20, 4096
ROWS = 100_000


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys) - width + 1
    padded = np.concatenate([keys, np.full(-len(keys) % width, ~np.uint64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Anchors:
    """A document's anchors: position, first and last window as distances before it, hash of the string."""

    def __init__(self, text: bytes, length: int, gram: int):
        data, width = np.frombuffer(text, np.uint8), length - gram + 1
        found = []
        low = np.uint64((1 << 22) - 1)
        for lo in range(0, max(0, len(data) - length + 1), CHUNK):
            part = data[lo : lo + CHUNK + length - 1]
            starts = np.arange(len(part) - gram + 1)
            h = hashes(prefix_sums(part), starts, starts + gram)
            at = (_sliding_min((h & ~low) | starts.astype(np.uint64), width) & low).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            last = np.concatenate((first[1:], [len(at)])) - 1
            p = at[first]
            found.append((p + lo, p - last, p - first, h[p]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        if len(found) > 1:  # an anchor may have windows in two chunks
            first = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
            cols = [cols[0][first], np.minimum.reduceat(cols[1], first), np.maximum.reduceat(cols[2], first), cols[3][first]]
        self.at, self.low, self.high, self.string = cols
        self.left, self.until = np.maximum(self.at - (width - 1), 0), np.minimum(self.at + length, len(data))

    def contexts(self, text: bytes) -> list[bytes]:
        """Digests of the contexts and the anchors' places in them."""
        view, digest = memoryview(text), hashlib.blake2b
        places = (self.at - self.left).astype("<u4").tobytes()
        return [digest(view[a:b], digest_size=16, salt=places[4 * k : 4 * k + 4]).digest() for k, (a, b) in enumerate(zip(self.left.tolist(), self.until.tolist(), strict=True))]


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows: disjoint, apart, ascending."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], np.concatenate((reach[:-1][first[1:]], reach[-1:]))], 1)


ANCHORS = "doc_id long, body long, string long, c0 long, c1 long, at long, low int, high int, n long, until long"


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each distinct (string, context) of a document, and rows without a string: spans settled within it."""
    kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.int64()] * 2
    names = [f.split()[0] for f in ANCHORS.split(", ")]

    def rows_of(doc_id: int, body: int, text: bytes) -> list[np.ndarray] | None:
        a = Anchors(text, length, gram)
        if not len(a.at):
            return None
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(d, len(number)) for d in a.contexts(text)])
        n = np.bincount(which)
        first = np.zeros(len(n), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]  # the first of equals is written last
        again = n[which] > 1
        spans = merged(np.stack([a.at - a.high, a.at - a.low + length], 1)[again])
        k, s = len(first), len(spans)
        context = np.frombuffer(b"".join(number), "<i8").reshape(-1, 2)
        join = lambda x, y: np.concatenate((x, y))
        zeros = np.zeros(s, np.int64)
        return [np.full(k + s, doc_id), np.full(k + s, body), join(a.string[first].view(np.int64), zeros), join(context[:, 0], zeros), join(context[:, 1], zeros), join(a.at[first], spans[:, 0]), join(a.low[first], zeros), join(a.high[first], zeros), join(n, zeros), join(np.full(k, -1), spans[:, 1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        held, n = [], 0
        for batch in batches:
            for doc_id, body, text in zip(*batch.columns, strict=True):
                if (rows := rows_of(doc_id.as_py(), body.as_py(), text.as_py().encode())) is not None:
                    held.append(rows)
                    n += len(rows[0])
                    if n > ROWS:
                        yield batch_of(held)
                        held, n = [], 0
        if held:
            yield batch_of(held)

    return map_batches(docs.select("doc_id", "body", "text"), run, ANCHORS)


def _shared(keys: np.ndarray, width: int) -> np.ndarray:
    """How many bytes each of the sorted keys begins with like the one before it; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    rows = keys.view(np.uint8).reshape(len(keys), width)
    for lo in range(1, len(keys), 1 << 14):
        differ = rows[lo : lo + (1 << 14)] != rows[lo - 1 : lo - 1 + len(rows[lo : lo + (1 << 14)])]
        out[lo : lo + (1 << 14)] = np.where(differ.any(1), differ.argmax(1), width)
    return out


class Suffixes:
    """A sorted sparse suffix array: ``right`` (suffixes from the anchors on, in the order of their bytes), ``left`` (reversed bytes before
    them), the windows' least and greatest distance before the anchor, and each one's number."""

    def __init__(self, right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, number: np.ndarray):
        by = np.argsort(right, kind="stable")  # of sorted runs one after the other: a merge
        self.right, self.left, self.low, self.high, self.number = right[by], left[by], low[by], high[by], number[by]

    def __len__(self) -> int:
        return len(self.right)

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("right", "left", "low", "high", "number")))

    def take(self, rows: np.ndarray) -> Suffixes:
        out = object.__new__(Suffixes)
        for c in ("right", "left", "low", "high", "number"):
            setattr(out, c, getattr(self, c)[rows])
        return out


class Family:
    """The levels of a task, the larger the older, and what is known of each suffix: its repeated windows nearest to and farthest from the
    anchor (as distances; none: -1)."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.levels: list[Suffixes] = []
        self.nearest, self.farthest = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, contexts: list[bytes], left: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        before = max(1, self.length - self.gram)
        right = np.array([c[p : p + self.length] for c, p in zip(contexts, left.tolist(), strict=True)], f"S{self.length}")
        back = np.array([c[:p][::-1] for c, p in zip(contexts, left.tolist(), strict=True)], f"S{before}")
        batch = Suffixes(right, back, low.astype(np.int64), high.astype(np.int64), len(self.nearest) + np.arange(len(contexts)))
        none = np.full(len(contexts), -1)
        self.nearest, self.farthest = np.concatenate((self.nearest, none)), np.concatenate((self.farthest, none))
        self._scan(Suffixes.joined([batch, *(met for level in self.levels if len(met := self._met(batch, level)))]))
        while self.levels and len(self.levels[-1]) <= 2 * len(batch):
            batch = Suffixes.joined([self.levels.pop(), batch])
        self.levels.append(batch)

    def _met(self, batch: Suffixes, level: Suffixes) -> Suffixes:
        """The level's suffixes that begin with an anchor of the batch."""
        anchors = np.unique(batch.right.astype(f"S{self.gram}"))
        wide = np.zeros((len(anchors), self.length), np.uint8)
        wide[:, : self.gram] = anchors.view(np.uint8).reshape(len(anchors), self.gram)
        first = np.searchsorted(level.right, wide.view(f"S{self.length}").ravel(), "left")
        wide[:, self.gram :] = 255  # no byte of a text is greater
        last = np.searchsorted(level.right, wide.view(f"S{self.length}").ravel(), "right")
        n = last - first
        return level.take(np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64), n) + np.arange(n.sum()))

    def _scan(self, every: Suffixes) -> None:
        """Mark the windows that two of the sorted suffixes share: as many bytes before the anchor and as many from it on."""
        common = _shared(every.right, self.length)
        near = common >= self.gram
        some = near | np.append(near[1:], False)  # another one begins with the same anchor
        every, common = every.take(some), common[some]
        n = len(every)
        if not n:
            return
        by = np.argsort(every.left, kind="stable")
        behind = _shared(every.left[by], max(1, self.length - self.gram))
        place = np.empty(n, np.int64)
        place[by] = np.arange(n)
        for d in range(int(every.low.min()), int(every.high.max()) + 1):
            own = np.flatnonzero((every.low <= d) & (d <= every.high))
            if len(own) < 2:
                continue
            after = np.cumsum(common < self.length - d)[own]  # equal numbers: equal bytes
            ahead = np.cumsum(behind < d)[place[own]]
            key = after * (n + 1) + ahead
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            hit = every.number[own[order[np.append(same, False) | np.append(False, same)]]]
            self.nearest[hit] = np.where(self.nearest[hit] < 0, d, np.minimum(self.nearest[hit], d))
            self.farthest[hit] = np.maximum(self.farthest[hit], d)


CONTEXTS = "string long, doc_id long, body long, at long, low int, high int, left int, bytes binary"


def _contexts(docs: DataFrame, reps: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of the representatives' contexts; the text moves once, to meet its own document's list."""
    lists = reps.groupBy("doc_id", "body").agg(F.collect_list(F.struct("string", "at", "low", "high")).alias("anchors"))
    names = [f.split()[0] for f in CONTEXTS.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, body, text, anchors in zip(*batch.columns, strict=True):
                data = text.as_py().encode()
                for a in anchors.as_py():
                    p = a["at"]
                    left = min(p, length - gram)
                    rows.append((a["string"], doc_id.as_py(), body.as_py(), p, a["low"], a["high"], left, data[p - left : p + length]))
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_batches(docs.join(lists, ["doc_id", "body"]).select("doc_id", "body", "text", "anchors"), run, CONTEXTS)


SPANS = "doc_id long, body long, start long, until long"


def _match_contexts(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of the contexts' repeated windows.  Rows come dealt out by string, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, members = Family(length, gram), []

        def add(held):
            c = {k: np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("doc_id", "body", "at", "low", "high", "left")}
            family.add([x for b in held for x in b.column("bytes").to_pylist()], c["left"], c["low"], c["high"])
            members.append((c["doc_id"], c["body"], c["at"]))

        held, n = [], 0
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                held.append(whole.slice(lo, BATCH))
                n += held[-1].num_rows
                if n >= BATCH:
                    add(held)
                    held, n = [], 0
        if held:
            add(held)
        if members:
            hit = family.nearest >= 0
            doc_id, body, at = (np.concatenate(c)[hit] for c in zip(*members, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc_id, body, at - family.farthest[hit], at - family.nearest[hit] + length)], ["doc_id", "body", "start", "until"])

    return map_batches(contexts.select(*[f.split()[0] for f in CONTEXTS.split(", ")]), run, SPANS)


def _match_hot(contexts: DataFrame, length: int) -> DataFrame:
    """The same for strings with very many contexts: a row for each window, counted by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH // 16):
                batch = whole.slice(lo, BATCH // 16)
                rows: list[tuple] = []
                for string, doc_id, body, at, low, high, left, data in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                    view = memoryview(data)
                    rows += [(string, hashlib.blake2b(view[left - d : left - d + length], digest_size=16).digest(), doc_id, body, at, d) for d in range(low, high + 1)]
                cols = list(zip(*rows, strict=True))
                key = np.frombuffer(b"".join(cols[1]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), *(pa.array(c, pa.int64()) for c in cols[2:])], ["string", "k0", "k1", "doc_id", "body", "at", "before"])

    windows = map_batches(contexts.select(*[f.split()[0] for f in CONTEXTS.split(", ")]), run, "string long, k0 long, k1 long, doc_id long, body long, at long, before long")
    again = windows.groupBy("string", "before", "k0", "k1").count().filter("count > 1").drop("count")
    met = windows.join(again, ["string", "before", "k0", "k1"], "left_semi").groupBy("doc_id", "body", "at").agg(F.min("before").alias("low"), F.max("before").alias("high"))
    return met.select("doc_id", "body", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("until"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (null: the least long), hash of the text, text."""
    return id_and_text(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("body"), "text", F.col("doc_id").isNull().alias("no_id"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, body, start, until) of keyed docs: spans of bytes, which may overlap, that cover what is repeated."""
    gram = max(1, length * 8 // 25)
    rows = materialise(_anchor_rows(docs, length, gram), "anchors")
    settled = materialise(rows.filter("until >= 0").select("doc_id", "body", F.col("at").alias("start"), "until"), "settled")
    anchors = rows.filter("until < 0").drop("until")
    strings = anchors.groupBy("string").agg(F.sum("n").alias("all"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("c0", "c1") for f in (F.min, F.max)]).filter("all > 1")
    differ = (F.col("min_c0") != F.col("max_c0")) | (F.col("min_c1") != F.col("max_c1"))
    strings = materialise(strings.select("string", differ.alias("differ")), "strings")  # so that the join may split a common string's rows
    several = materialise(anchors.join(strings, "string"), "repeated")
    discard(rows)
    discard(strings)
    context = ["string", "c0", "c1"]
    contexts = several.groupBy(*context).agg(F.sum("n").alias("times"), F.min(F.struct("doc_id", "body", "at", "low", "high")).alias("rep"), F.first("differ").alias("differ"))
    contexts = materialise(contexts, "contexts")
    whole = several.filter("n < 2").join(contexts.filter("times > 1").select(*context), context)
    whole = whole.select("doc_id", "body", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("until"))
    spans = settled.unionByName(materialise(whole, "whole"))
    discard(several)
    reps = contexts.filter("differ").select("string", "rep.*")
    sizes = materialise(reps.groupBy("string").count(), "sizes")
    most, n = sizes.agg(F.max("count"), F.sum("count")).first()
    tasks = max(1, -(-(n or 0) // FAMILY))
    found = _contexts(docs, reps, length, gram)
    if (most or 0) <= hot:
        return spans.unionByName(_match_contexts(found.repartition(tasks, "string"), length, gram))
    many, found = sizes.filter(F.col("count") > hot).select("string"), materialise(found, "bytes")
    few = found.join(many, "string", "left_anti").repartition(tasks, "string")
    return spans.unionByName(_match_contexts(few, length, gram)).unionByName(_match_hot(found.join(many, "string", "left_semi").repartition("doc_id", "at"), length))


CUT = "doc_id long, no_id boolean, n_bytes long, spans array<struct<start:long,until:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (disjoint byte ranges removed, ascending), kept (the other bytes; a
    span may cut a character).

    Null, empty and short texts: nothing removed.  Very long texts: read whole, in chunks.  Repeated rows and
    copies: each is elsewhere for the other, so all go.  Null ids: like any other.  Empty table: no rows.  Further columns
    are ignored.
    """
    keyed = _keyed(docs, id_col, text_col)
    lists = repeated_spans(keyed, length, hot).groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "until")).alias("spans"))
    names = [f.split()[0] for f in ("doc_id long", "no_id boolean", "n_bytes long", "spans", "kept")]
    span = pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64())]))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), span, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH // 4):
                rows = []
                for doc_id, no_id, text, spans in zip(*whole.slice(lo, BATCH // 4).columns, strict=True):
                    data, spans = text.as_py().encode(), spans.as_py() or []
                    gone = merged(np.array([(s["start"], s["until"]) for s in spans], np.int64).reshape(-1, 2)).tolist()
                    edges = [0, *(x for s in gone for x in s), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((doc_id.as_py(), no_id.as_py(), len(data), [{"start": a, "until": b} for a, b in gone], kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    cut = map_batches(keyed.join(lists, ["doc_id", "body"], "left").select("doc_id", "no_id", "text", "spans"), run, CUT)
    return cut.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "spans", "kept")


def op10_suffix_dedup(spark, sf_dir):
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["start"])
    left = F.make_valid_utf8(F.col("kept").cast("string"))  # a span may cut a character
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), left.alias("text"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, window by window; for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = merged(np.array([(i, i + length) for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1], np.int64).reshape(-1, 2)).tolist()
        edges = [0, *(x for s in gone for x in s), len(d)]
        kept = b"".join(d[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append((len(d), len(d) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
