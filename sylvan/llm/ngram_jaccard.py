"""Groups of documents with similar sets of word n-grams: an exact set similarity join with set-relation skipping.

Two documents link when 100 * |A & B| >= threshold * |A | B|.  The result is each document's component, so links inside
a known component needn't be looked at, and no pair ever becomes a row.

1.  Each text becomes a set of 64-bit hashes; equal sets are one class, with its smallest document.
2.  Most classes are shown to have no partner: a set of size n misses at most k - 1 of its elements in a partner, k = n -
    ceil(threshold * n) + 1.  If k of its ``near`` least elements are in no other set's region, it has no partner: that would
    have one of the k, and there at a rank of at most that set's near plus its own k - 1 further elements, which its
    region covers for every partner's size up to n / threshold.  Elements meet in buckets of the hash space as packed
    arrays; an element that a batch of documents shares is sent once.  There are COARSE buckets at most, so that packed rows stay
    long; beyond that, a task splits its buckets again and sorts the parts on its own disk.
3.  For the others the prefix filter with elements in order of rarity (counted over all of them): partners share one of
    their k rarest elements.  Classes that share a prefix element are put into candidate groups.
4.  A group of at most ``block`` elements is a cell, that is, a task's work at a time.  A larger group is split by whichever is less work:
    by prefix element, where elements with the same list of sets are one unit, or as a whole.  A unit that is still too large
    is cut into blocks within bands of sizes, each 1 / threshold times the one before; only blocks of the
    same band or neighbouring ones can hold partners, and each such pair of blocks is a cell.
5.  In a cell, index lists are made of blocks of equal set size, in which entries stand in order of the element's position.  Blocks
    outside the size bounds are skipped, and so is the rest of a block once too few elements can follow the position.  Candidates
    already in the set's component are skipped.  A set takes its most promising candidate first; if that links, the
    answers computed for it bound the set's other overlaps, |x & z| <= |y & z| + |x - y|, and candidates
    below the bound are skipped unseen.  Tasks give one row a set: the least set it was linked with.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_passes, bloom_words, id_and_text, map_batches, materialise, with_unique_ids
from .components import components
from .hashing import hashes, mixed, prefix_sums

WORDS, THRESHOLD = 3, 90
#: Elements of a cell's blocks, and elements that a task holds at once elsewhere.
BLOCK, BUCKET = 400_000, 500_000
#: Buckets that elements are dealt to at once, and the partitions that hold them.
COARSE, PARTITIONS = 1 << 16, 1 << 13
BATCH = 2048

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; with fewer words, of the whole sequence."""
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    h = hashes(prefix_sums(data), start, end)
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(s)


def _prefix(n, threshold: int):
    """k of the docstring, for numbers and columns alike."""
    return n - (n * threshold + 99) // 100 + 1


SETS = "doc_id long, body long, n long, d1 long, d2 long"


def _digest(s: np.ndarray) -> tuple[int, int]:
    m = mixed(s)
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5555)), initial=np.uint64(0)).view(np.int64))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    names = [f.split()[0] for f in SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = [(len(s), *_digest(s)) for s in (shingles(t.as_py(), words) for t in part.column(2))]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in cols)], names)

    return map_batches(docs.select("doc_id", "body", "text"), run, SETS)


def _near(n: int, threshold: int) -> int:
    """How many least elements may show a set to be alone: over k, by more where k is a small part of the set."""
    k = _prefix(n, threshold)
    return k + k // 4 + max(0, n // 8 - k // 2) + 1


def _region_sizes(n: int, threshold: int) -> tuple[int, int]:
    return _near(n, threshold), _prefix(n, threshold) + _near(n * 100 // threshold, threshold) + 3


REGIONS = "bucket long, classes binary, elements binary, owners binary, near binary"


def _merged(element: np.ndarray, owner: np.ndarray, several: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each element once: an owner of it, whether it has several, whether it is near to one."""
    by = np.argsort(element, kind="stable")
    element, owner, several, near = element[by], owner[by], several[by], near[by]
    first = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
    low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    return element[first], low, (low != high) | np.logical_or.reduceat(several, first), np.logical_or.reduceat(near, first)


def _parts(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The keys that occur and their places."""
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1])))
    for at in np.split(by, first[1:]):
        yield int(key[at[0]]), at


def _packed(key: np.ndarray, element: np.ndarray, owner: np.ndarray, several: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """A row for each key: elements, and each one's class as its place in ``classes``, or beyond the last for several."""
    rows = []
    for k, at in _parts(key):
        own = ~several[at]
        classes, place = np.unique(owner[at][own], return_inverse=True)
        places = np.full(len(at), len(classes))
        places[own] = place
        rows.append((k, classes.tobytes(), element[at].tobytes(), places.astype("<u2" if len(classes) < 1 << 16 else "<u4").tobytes(), np.packbits(near[at]).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] + [pa.binary()] * 4, strict=True)], [f.split()[0] for f in REGIONS.split(", ")])


def _unpacked(classes: bytes, elements: bytes, owners: bytes, near: bytes) -> tuple[np.ndarray, ...]:
    c, e = np.frombuffer(classes, np.int64), np.frombuffer(elements, np.uint64)
    o = np.frombuffer(owners, "<u2" if len(owners) == 2 * len(e) else "<u4")
    return e, np.concatenate((c, [0]))[o], o == len(c), np.unpackbits(np.frombuffer(near, np.uint8), count=len(e)).astype(bool)


def _regions(docs: DataFrame, words: int, threshold: int, buckets: int) -> DataFrame:
    """Regions of batches of documents, packed by bucket of their elements."""

    def packed(sets: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        length = np.array([len(s) for _, _, s in sets])
        element = np.concatenate([s for _, _, s in sets])
        owner = np.repeat(np.array([d for d, _, _ in sets], np.int64), length)
        near = (np.arange(len(element)) - np.repeat(np.cumsum(length) - length, length)) < np.repeat([m for _, m, _ in sets], length)
        element, owner, several, near = _merged(element, owner, np.zeros(len(element), bool), near)
        return _packed((mixed(element) % np.uint64(buckets)).astype(np.int64), element, owner, several, near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in batches:
            for text in part.column(0):
                s = shingles(text.as_py(), words)
                if len(s):
                    near, region = _region_sizes(len(s), threshold)
                    held.append((_digest(s)[0], near, s[:region].copy()))
                    n += len(held[-1][2])
                if n > max(BUCKET // 2, 64 * buckets):
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return map_batches(docs.select("text"), run, REGIONS)


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(first column, rows of the others) of rows that share their first column; they come sorted by it, and are handed on one by one."""
    rows = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns, strict=True))
    for key, own in itertools.groupby(rows, lambda r: r[0]):
        yield key, (r[1:] for r in own)


def _split(regions: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Each bucket's rows once more by ``parts`` further parts of the hash; sorted by spilling where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(bucket, held):
            element, owner, several, near = _merged(*(np.concatenate(c) for c in zip(*held, strict=True)))
            part = (mixed(element) // np.uint64(buckets) % np.uint64(parts)).astype(np.int64)
            return _packed(bucket * parts + part, element, owner, several, near)

        for bucket, rows in _by_first(batches):
            held, n = [], 0
            for row in rows:
                held.append(_unpacked(*row))
                n += len(held[-1][0])
                if n > 4 * BUCKET:
                    yield packed(bucket, held)
                    held, n = [], 0
            if held:
                yield packed(bucket, held)

    return map_batches(regions, run, REGIONS).sortWithinPartitions("bucket")


def _alone(regions: DataFrame, buckets: int) -> DataFrame:
    """(d1, alone): how many near elements of a class no other class has.  Buckets count, and classes' counts meet packed."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        d1, at = np.unique(np.concatenate([d for d, _ in held]), return_inverse=True)
        return d1, np.bincount(at, np.concatenate([n for _, n in held]), len(d1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held):
            d1, n = summed(held)
            to = (mixed(d1.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            rows = [(k, d1[at].tobytes(), n[at].astype("<u4").tobytes()) for k, at in _parts(to)]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "d1", "n"])

        held, n = [], 0
        for _, rows in _by_first(batches):
            _, owner, several, near = _merged(*(np.concatenate(c) for c in zip(*(_unpacked(*r) for r in rows), strict=True)))
            own, times = np.unique(owner[~several & near], return_counts=True)
            if len(own):
                held.append((own, times))
                n += len(own)
            if n > max(BUCKET, 16 * buckets):
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_first(batches):
            held, n = [], 0
            for d1, times in rows:
                held.append((np.frombuffer(d1, np.int64), np.frombuffer(times, "<u4")))
                n += len(held[-1][0])
                if n > 4 * BUCKET:  # the sums so far take a row's place
                    held = [summed(held)]
                    n = 0
            d1, times = summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(times)], ["d1", "alone"])

    counts = map_batches(regions, count, "part int, d1 binary, n binary")
    return map_batches(counts.repartition(min(buckets, PARTITIONS), "part").sortWithinPartitions("part"), total, "d1 long, alone long")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, n, elements) of the wanted classes' documents (node, id, of).  Texts don't move: a Bloom filter of the wanted texts' hashes
    picks nearly all of them where they are read, and their sets meet the wanted ones in an exact join."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom_words(wanted, "of", wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(bloom_passes(filter_.value, whole.column(1).to_numpy())))
            for lo in range(0, whole.num_rows, BATCH):
                part = whole.slice(lo, BATCH)
                sets = [shingles(t.as_py(), words) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "body", "n", "elements"])

    sets = map_batches(docs.select("doc_id", "body", "text"), run, "doc_id long, body long, n long, elements array<long>")
    return sets.join(wanted, sets["doc_id"].eqNullSafe(wanted["id"]) & (sets["body"] == wanted["of"])).select("node", "n", "elements").dropDuplicates(["node"])


class Cell:
    """The sets of a pair of blocks: which are connected by links between them.  before: how many elements of a set stand before its
    prefix in the order of rarity, those that no other set has."""

    def __init__(self, nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], prefixes: list[np.ndarray], before: np.ndarray, threshold: int):
        size = np.array([len(s) for s in sets], np.int64)
        order = np.lexsort((nodes, size))
        self.nodes, self.sides, self.size, self.threshold = nodes[order], sides[order], size[order], threshold
        elements = np.concatenate([sets[i] for i in order])
        distinct = np.unique(elements)
        self.ids = np.searchsorted(distinct, elements).astype(np.int32)
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.here = np.zeros(len(distinct), np.int8)
        self.root = np.arange(len(sets))

        length = np.array([len(prefixes[i]) for i in order])
        self.first = np.concatenate(([0], np.cumsum(length)))
        owner = np.repeat(np.arange(len(sets)), length)
        self.place = np.arange(len(owner)) - np.repeat(self.first[:-1], length) + before[order][owner]
        _, self.list = np.unique(np.concatenate([prefixes[i] for i in order]), return_inverse=True)
        by = np.lexsort((self.place, self.size[owner], self.list))  # a list is a row of blocks of one size, in order of position
        self.listed, lists, sizes = owner[by], self.list[by], self.size[owner[by]]
        new = np.flatnonzero(np.concatenate(([True], (lists[1:] != lists[:-1]) | (sizes[1:] != sizes[:-1]))))
        self.block_start, self.block_size = new, sizes[new]
        self.list_block = np.searchsorted(lists[new], np.arange(lists[-1] + 2))
        self.most = int(self.place.max()) + 1
        self.post = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(by)))) * self.most + self.place[by]

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def _roots(self, xs: np.ndarray) -> np.ndarray:
        r = self.root[xs]
        while not np.array_equal(r, up := self.root[r]):
            r = up
        self.root[xs] = r
        return r

    def _overlaps(self, x: int, others: np.ndarray) -> np.ndarray:
        own = self.ids[self.starts[x] : self.ends[x]]
        self.here[own] = 1
        n = self.size[others]
        at = np.repeat(self.starts[others] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        out = np.add.reduceat(self.here[self.ids[at]], np.concatenate(([0], np.cumsum(n)[:-1])), dtype=np.int64)
        self.here[own] = 0
        return out

    def _needed(self, x: int, others: np.ndarray) -> np.ndarray:
        """Least overlap of a link: 100 o >= t (a + b - o)."""
        t = self.threshold
        return -(-t * (self.size[x] + self.size[others]) // (100 + t))

    def _candidates(self, x: int) -> np.ndarray:
        """Earlier sets (once for each prefix element in common) that size and positions leave possible."""
        lists, place = self.list[self.first[x] : self.first[x + 1]], self.place[self.first[x] : self.first[x + 1]]
        n = self.list_block[lists + 1] - self.list_block[lists]
        block = _ranges(self.list_block[lists], n)
        place = np.repeat(place, n)
        m, own = self.block_size[block], self.size[x]
        needed = -(-self.threshold * (own + m) // (100 + self.threshold))
        some = (m <= own) & (100 * m >= self.threshold * own) & (own - place >= needed)  # whole blocks are skipped
        block, last = block[some], (m - needed)[some]
        start = self.block_start[block]
        stop = np.searchsorted(self.post, block * self.most + np.minimum(last, self.most - 1), "right")  # the rest of a block is skipped by position
        met = self.listed[_ranges(start, np.maximum(stop - start, 0))]
        return met[met < x]

    def link(self) -> np.ndarray:
        """The least node that each set is connected with."""
        answers: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.size)
        two = len(set(self.sides.tolist())) > 1
        for x in range(len(self.size)):
            met, times = np.unique(self._candidates(x), return_counts=True)
            if two:
                other = self.sides[met] != self.sides[x]
                met, times = met[other], times[other]
            if not len(met):
                continue
            y = int(met[np.argmax(times)])
            o = int(self._overlaps(x, np.array([y]))[0])
            seen, values = [np.array([y])], [np.array([o])]
            if o >= self._needed(x, np.array([y]))[0]:
                self.root[self._find(x)] = self._find(y)
            rest = met[self._roots(met) != self._find(x)]
            rest = rest[rest != y]
            if answers[y] is not None and len(rest):
                known, bound = answers[y]
                at = np.minimum(np.searchsorted(known, rest), len(known) - 1)
                most = np.where(known[at] == rest, bound[at] + self.size[x] - o, self.size[x])
                rest = rest[most >= self._needed(x, rest)]
            if len(rest):
                overlaps = self._overlaps(x, rest)
                seen.append(rest)
                values.append(overlaps)
                for z in rest[overlaps >= self._needed(x, rest)]:
                    self.root[self._find(int(z))] = self._find(x)
            seen, values = np.concatenate(seen), np.concatenate(values)
            by = np.argsort(seen)
            answers[x] = seen[by], values[by]
        roots = self._roots(np.arange(len(self.size)))
        least = np.full(len(self.size), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, self.nodes)
        return least[roots]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i] … start[i] + n[i] - 1, one after the other."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64), n) + np.arange(n.sum())


def _link_cells(cells: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of sets connected in a cell; rows (cell, node, side, before, elements, prefix) come dealt out and sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows):
            nodes, sides, before, sets, prefixes = zip(*rows, strict=True)
            if len(rows) < 2:
                return
            cell = Cell(np.array(nodes), np.array(sides), sets, prefixes, np.array(before), threshold)
            b, a = cell.link(), cell.nodes
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        rows: list[tuple] = []
        of = None
        for batch in batches:
            cell, node, side, before = (batch.column(k).to_pylist() for k in range(4))
            for k in range(batch.num_rows):
                if cell[k] != of and rows:
                    yield from done(rows)
                    rows = []
                of = cell[k]
                rows.append((node[k], side[k], before[k], *(batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (4, 5))))
        if rows:
            yield from done(rows)

    return map_batches(cells.select("cell", "node", "side", "before", "elements", "prefix"), run, "a long, b long")


def _cells(members: DataFrame, threshold: int, block: int) -> DataFrame:
    """(cell, node, side): what is compared where.  members: node, n, prefix, component, total (elements of the component)."""
    small = members.filter(F.col("total") <= block).select(F.col("component").cast("string").alias("cell"), "node", F.lit(0).cast("long").alias("side"))
    large = members.filter(F.col("total") > block)
    if large.isEmpty():  # saves the plan, changes nothing
        return small
    large = materialise(large, "large")
    work = lambda total: F.col(total) * F.ceil(F.col(total) / F.lit(block))
    own = large.select("component", "node", "n", F.explode("prefix").alias("element"))
    lists = own.groupBy("component", "element").agg(F.count("*").alias("sets"), F.sum("n").alias("of"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("sets > 1")
    lists = materialise(lists.groupBy("component", "sets", "x", "y").agg(F.min("element").alias("element"), F.first("of").alias("of")), "lists")
    apart = lists.groupBy("component").agg(F.sum(work("of")).alias("apart"))
    split = large.select("component", "total").distinct().join(apart, "component").filter(F.col("apart") < work("total")).select("component")
    units = large.join(split, "component", "left_anti").select(F.concat(F.lit("c"), "component").alias("unit"), "node", "n")
    units = units.unionByName(own.join(lists.join(split, "component", "left_semi").select("element"), "element").select(F.concat(F.lit("e"), "element").alias("unit"), "node", "n"))
    width = -math.log(threshold / 100 - 1e-6)
    units = materialise(units.withColumn("band", F.floor(F.log("n") / F.lit(width)).cast("int")), "units")
    sizes = units.groupBy("unit", "band").agg(F.sum("n").alias("total")).withColumn("blocks", F.ceil(F.col("total") / F.lit(block)).cast("int"))
    whole = units.groupBy("unit").agg(F.sum("n").alias("all")).filter(F.col("all") <= block).select("unit")
    few = units.join(whole, "unit").select(F.col("unit").alias("cell"), "node", F.lit(0).cast("long").alias("side"))
    many = units.join(whole, "unit", "left_anti").join(sizes.select("unit", "band", "blocks"), ["unit", "band"])
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    same = many.select("unit", "node", "band", F.col("band").alias("to"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    beside = many.select("unit", "node", "band", F.explode(F.array(F.col("band") - 1, F.col("band") + 1)).alias("to"), "own")
    beside = beside.join(sizes.select("unit", F.col("band").alias("to"), "blocks"), ["unit", "to"]).select("unit", "node", "band", "to", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    a, b = F.struct(F.col("band"), F.col("own").alias("k")), F.struct(F.col("to").alias("band"), F.col("other").alias("k"))
    both = same.unionByName(beside).withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b))
    both = both.select(F.concat_ws("-", "unit", "low.band", "low.k", "high.band", "high.k").alias("cell"), "node", F.xxhash64("band", "own").alias("side"))
    return small.unionByName(few).unionByName(both)


def similar_groups(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null and empty texts: an empty set, linked with nothing.  Very long texts: read whole.  Repeated rows: equal
    sets, so one component.  Null ids: members like any other; a component of only such has a null id.  Empty
    table: no rows.  Further columns are ignored.
    """
    keyed = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("body"), "text")
    sets = materialise(_sets(keyed, words).withColumn("row", F.monotonically_increasing_id()), "sets")
    key = ["n", "d1", "d2"]
    classes = sets.filter("n > 0").groupBy(*key).agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    classes = materialise(classes, "classes")

    k = F.expr(f"n - (n * {threshold} + 99) div 100 + 1")
    total = (sets.agg(F.sum("n")).first()[0] or 0) * 6 // 10
    need = max(1, -(-total // BUCKET))
    buckets = min(need, COARSE)
    regions = _regions(keyed, words, threshold, buckets).repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket")
    if need > buckets:
        regions = _split(regions, buckets, -(-need // buckets))
    met = classes.join(_alone(regions, buckets), "d1", "left").filter(F.coalesce("alone", F.lit(0)) < k)
    wanted = sets.join(met.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), F.col("doc_id").alias("id"), F.col("body").alias("of"))
    wanted = materialise(wanted, "wanted")
    full = materialise(_full_sets(keyed, wanted, words), "full")

    listed = full.select("node", "n", F.explode("elements").alias("element"))
    shared = listed.groupBy("element").agg(F.count("*").alias("times")).filter("times > 1")
    common = listed.join(shared, "element").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("times", "element"))).alias("common"))
    alone = F.col("n") - F.size("common")  # elements of no other set come first in the order of rarity
    rarest = F.slice("common", F.lit(1), F.greatest(F.lit(0), k - alone).cast("int"))
    prefixes = materialise(common.select("node", "n", alone.alias("before"), rarest["element"].alias("prefix")).filter(F.size("prefix") > 0), "prefixes")
    postings = prefixes.select("node", F.explode("prefix").alias("element"))
    lists = postings.groupBy("element").agg(F.min("node").alias("b"))
    groups = components(postings.join(lists, "element").select(F.col("node").alias("a"), "b"))

    members = groups.join(prefixes.select("node", "n", "prefix"), "node")
    members = members.join(members.groupBy("component").agg(F.sum("n").alias("total")), "component")
    cells = _cells(members, threshold, block).join(prefixes.select("node", "before", "prefix"), "node").join(full.select("node", "elements"), "node")
    links = components(_link_cells(cells.repartition("cell").sortWithinPartitions("cell"), threshold))

    found = classes.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = found.join(lowest, "component").select(*key, "component_id")
    return sets.select("doc_id", *key, "row").join(found, key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_similar(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have the smallest id of their group.  Where an id is null or repeated,
    the first row of a group stays."""
    told, key = with_unique_ids(docs, id_col)
    groups = similar_groups(told, words, threshold, key, text_col).filter("doc_id = component_id")
    return told.join(groups.select(F.col("doc_id").alias(key)), key, "left_semi").select(docs.columns)


def op8_ngram_jaccard(spark, sf_dir):
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS, threshold: int = THRESHOLD) -> list[tuple[int, int, int]]:
    """(doc_id, n_shingles, component_id) by all pairs; for tests."""
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").encode().translate(bytes(_LOWER)).split(None) if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)]
