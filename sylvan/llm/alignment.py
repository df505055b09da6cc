"""Alignment of two tokenizers' tokens, relationally, over the corpus' distinct units.

Tokens of A (byte-level) and B (pieces) cover the same bytes of a text.  Where both end, they are cut into groups; an A and a B token are linked
where their byte ranges overlap.  Neither tokenizer's tokens cross the beginning of a word, so that a text falls into units (a word with the white space
before it, or the signs after one) that are tokenised, cut and linked alike wherever they stand.  A unit that recurs is therefore aligned once:

1.  A scan writes documents in chunks, and the distinct units of each part (many chunks) with their counts.
2.  Distinct units are tokenised.  Their tokens are exploded with positions; cumulative lengths are window sums; ends of A and B meet in an equi-join on
    unit and end; running counts of the cuts number the groups; a join on unit and group brings the tokens of a group together, and those whose
    ranges overlap are links.  All this runs on one exchange, by unit.
3.  Links, weighted by their unit's count, are summed by id pair; each link is told its pair's count and whether it is its B id's highest.
4.  A part's units get their unit's sums by a join and meet the part's documents, which add them up in order.

Whether a vocabulary keeps to such units is read from its pieces; where one doesn't, a whole text is its only unit.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, chunked, packed, unpacked
from .common import discard, id_and_text, map_batches, materialise
from .tokens import BLANKS, BYTE_CHARS, OTHER, PRINTABLE, UNEVEN, encoder

#: Bytes of text whose distinct units are one part.
PART_BYTES = 48 << 20
#: Units whose bytes a worker remembers to agree.
MEMORY = 300_000
SPACE_SIGN = "▁"
#: Latin letters, after which a full stop or comma begins a unit.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"

_pairs: dict[tuple[str, str], TokenPair] = {}


class TokenPair:
    """Both vocabularies: units of a text, their ids, and each id's bytes."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = encoder(a_path), SentencePieceProcessor(model_file=b_path)
        byte_of = {chr(b): b for b in PRINTABLE} | {c: b for b, c in BYTE_CHARS.items()}
        entries = [self.a.library.id_to_token(i) or "" for i in range(self.a.library.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entries]
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        whole = not self.a.split or self.a.lower or any("\n" in p or re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p) for p in plain) or self.b.encode("\n", out_type=str) != [SPACE_SIGN, "<0x0A>"]
        breaks = " \n" + "\t" * (not any("\t" in p for p in plain))
        marks = "".join(c for c in ".," if not any(re.search(rf"[{LATIN}]\{c}", p) for p in plain))
        body = rf"(?:[^\s{marks}]+|(?<![{LATIN}])[{marks}])" if marks else r"\S+"
        first = rf"(?:[{marks}]{body}*|{body}+)" if marks else body
        self.unit = None if whole else re.compile(rf"\s*{first}(?:[^\S{breaks}]\s*(?:{body})*)*|\s+")
        self.agreed: dict[str, bool] = {}
        # A has all bytes as entries; B takes texts as they are, and bytes for what it has no piece for: only U+2581 reads as another character then
        self.lossless = self.a.split and not self.a.lower and set(byte_of) <= set(entries) and self._takes_all(b_path, n)

    def _takes_all(self, path: str, n: int) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as described

        model = described.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return model.normalizer_spec.name == "identity" and model.trainer_spec.byte_fallback and sum(self.b.is_byte(i) for i in range(n)) == 256

    def parts(self, text: str) -> list[str]:
        """A space and the text as runs of whole units, most of which are met again and again: words with the white space before them."""
        if not text:
            return []
        if self.unit is None or text[0] in BLANKS or text[-1] in BLANKS or any(x in text for x in UNEVEN) or OTHER.search(text):
            return self._cut(" " + text)
        return [" " + p if p[0] != "\n" else p for p in text.replace("\n", " \n").split(" ")]

    def _cut(self, part: str) -> list[str]:
        found = self.unit.findall(part) if self.unit else [part]
        return found if sum(map(len, found)) == len(part) else [part]

    def units_of(self, parts: Iterable[str]) -> Iterator[list[str]]:
        """Each part's units; only a full stop or comma can divide one."""
        for p in parts:
            yield self._cut(p) if "." in p or "," in p else [p]

    def units(self, text: str) -> list[str]:
        """Units of a space and the text; none of an empty text."""
        return list(itertools.chain.from_iterable(self.units_of(self.parts(text))))

    def b_ids(self, units: list[str]) -> list[list[int]]:
        """B puts a space before a text that is not empty; where that is not the unit's own, a line feed, a token of its own, stands between."""
        own = [u[0] == " " and len(u) > 1 for u in units]
        ids = self.b.encode([u[1:] if o else "\n" + u for u, o in zip(units, own, strict=True)], num_threads=1)
        return [i if o else i[2:] for i, o in zip(ids, own, strict=True)]

    def a_ids(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.library.encode_batch_fast(units, add_special_tokens=False)]

    def agrees(self, text: str, parts: list[str]) -> bool:
        """Whether the tokens of A and of B are the text's bytes."""
        if self.lossless:
            return SPACE_SIGN not in text
        units = list(itertools.chain.from_iterable(self.units_of(parts)))
        new = list(set(units).difference(self.agreed))
        if len(self.agreed) + len(new) > MEMORY:
            self.agreed, new = {}, list(set(units))
        for u, a, b in zip(new, self.a_ids(new), self.b_ids(new), strict=True):
            self.agreed[u] = b"".join([self.b_bytes[i] for i in b]) == u.encode() == b"".join([self.a_bytes[i] for i in a])
        return all(map(self.agreed.__getitem__, units))


def token_pair(a_path: str, b_path: str) -> TokenPair:
    """The worker's pair of those vocabulary files."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = TokenPair(a_path, b_path)
    return _pairs[a_path, b_path]


SCANNED = "part long, docs binary, ref int, unit string, n long"


def _scan(docs: DataFrame, a_path: str, b_path: str, part_bytes: int, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds: chunks of documents (with whether their bytes agree), and a part's distinct units in order of their first place (ref) with counts."""
    names, kinds = ["part", "docs", "ref", "unit", "n"], [pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64()]

    def batch(rows: int, part: int, **columns) -> pa.RecordBatch:
        columns["part"] = [part] * rows
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in zip(names, kinds, strict=True)], names)

    def unit_rows(part: int, words: Counter) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for own, times in zip(token_pair(a_path, b_path).units_of(words), words.values(), strict=True):
            for u in own:
                counts[u] = counts.get(u, 0) + times
        units, times = list(counts), list(counts.values())
        for lo in range(0, len(units), 50_000):
            hi = min(lo + 50_000, len(units))
            yield batch(hi - lo, part, ref=np.arange(lo, hi, dtype=np.int32), unit=units[lo:hi], n=times[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, counts, part, held = token_pair(a_path, b_path), Counter(), None, 0
        for number, ids, texts in chunked(batches, chunk_bytes):
            part = number if part is None else part
            fine = []
            for text in texts:
                parts = pair.parts(text)
                fine.append(bool(parts) and pair.agrees(text, parts))
                if fine[-1]:
                    counts.update(parts)
            yield batch(1, part, docs=[packed({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string()), "fine": pa.array(fine)})])
            held += sum(map(len, texts))
            if held >= part_bytes:
                yield from unit_rows(part, counts)
                counts, part, held = Counter(), None, 0
        if part is not None:
            yield from unit_rows(part, counts)

    return materialise(map_batches(docs, run, SCANNED), "scanned")


def _tokenised(units: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(u, unit, n) with the ids and lengths in bytes of A's and B's tokens."""
    lists = [pa.list_(pa.int32())] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(a_path, b_path)
        sizes = [np.array([len(x) for x in every]) for every in (pair.a_bytes, pair.b_bytes)]
        for b in batches:
            if not b.num_rows:
                continue
            texts, out = b.column(1).to_pylist(), []
            for ids, size in zip((pair.a_ids(texts), pair.b_ids(texts)), sizes, strict=True):
                edge = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, edge[-1])
                out += [pa.ListArray.from_arrays(edge, flat), pa.ListArray.from_arrays(edge, size[flat].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *(c.cast(k) for c, k in zip(out, lists, strict=True))], ["u", "unit", "n", "a", "a_size", "b", "b_size"])

    return materialise(map_batches(units, run, "u long, unit string, n long, a array<int>, a_size array<int>, b array<int>, b_size array<int>"), "tokenised")


def _tokens(base: DataFrame, side: str) -> DataFrame:
    """(u, unit, n, id, start, end): a unit's tokens with their byte ranges."""
    rows = base.select("u", "unit", "n", F.posexplode(F.arrays_zip(side, f"{side}_size")).alias("pos", "token"))
    rows = rows.select("u", "unit", "n", "pos", F.col(f"token.{side}").alias("id"), F.col(f"token.{side}_size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("u").orderBy("pos"))
    return rows.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size"))


def _grouped(tokens: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """(u, g, unit, n, list of tokens in order): a token's group is the number of cuts before its end."""
    ends = others.select("u", "end", F.lit(1).alias("cut"))
    earlier = Window.partitionBy("u").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    told = tokens.join(ends, ["u", "end"], "left").withColumn("g", F.coalesce(F.sum("cut").over(earlier), F.lit(0)))
    return told.groupBy("u", "g").agg(F.first("unit").alias("unit"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("end", "start", "id"))).alias(name))


def aligned_units(units: DataFrame) -> DataFrame:
    """(u, unit, n, groups: array of (g, a, b), tokens as (end, start, id)) of tokenised units; one exchange, by unit."""
    setting, spark = "spark.sql.requireAllClusterKeysForCoPartition", units.sparkSession  # else (u, end) and (u, g) would be exchanged again
    before = spark.conf.get(setting)
    base = units.repartition("u")
    a, b = _tokens(base, "a"), _tokens(base, "b")
    both = _grouped(a, b, "a").join(_grouped(b, a, "b").drop("unit", "n"), ["u", "g"])
    out = both.groupBy("u").agg(F.first("unit").alias("unit"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("g", "a", "b"))).alias("groups"))
    spark.conf.set(setting, "false")
    try:
        return materialise(out, "aligned")
    finally:
        spark.conf.set(setting, before)


def _links(aligned: DataFrame) -> DataFrame:
    """(u, n, a, b): a row for each pair of a unit's tokens whose ranges overlap; those are in one group."""
    g = aligned.select("u", "n", F.explode("groups").alias("g")).select("u", "n", F.explode("g.a").alias("x"), F.col("g.b").alias("y"))
    overlap = F.filter("y", lambda y: (y["start"] < F.col("x.end")) & (F.col("x.start") < y["end"]))
    return g.select("u", "n", F.col("x.id").alias("a"), F.explode(overlap).alias("y")).select("u", "n", "a", F.col("y.id").alias("b"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, times, best): how many links of the corpus an id pair has, and whether that is its B id's highest count."""
    pairs = _links(aligned).groupBy("a", "b").agg(F.sum("n").alias("times"))
    highest = pairs.groupBy("b").agg(F.max("times").alias("most"))
    return materialise(pairs.join(highest, "b").select("a", "b", "times", (F.col("times") == F.col("most")).cast("int").alias("best")), "pairs")


def _text(groups: str) -> Column:
    ids = lambda side: F.array_join(F.transform(side, lambda t: t["id"].cast("string")), ",")
    return F.array_join(F.transform(groups, lambda g: F.concat(ids(g["a"]), F.lit("|"), ids(g["b"]))), ";")


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def unit_sums(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit, SUMS, groups as text)."""
    links = _links(aligned).join(pairs, ["a", "b"]).groupBy("u").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("times").alias("count_sum"))
    size = lambda side: F.aggregate("groups", F.lit(0), lambda n, g: n + F.size(g[side]))
    shown = aligned.select("u", "unit", size("a").alias("n_a"), size("b").alias("n_b"), F.size("groups").alias("n_groups"), _text("groups").alias("groups"))
    return shown.join(links, "u").select("unit", *SUMS, "groups")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, chunk_bytes: int = CHUNK_BYTES, with_groups: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if ``with_groups``, groups (``a1,a2|b1;a3|b2,b3``).

    Null and empty texts, and texts whose tokens are not their bytes (a text with U+2581): zeros and empty groups, and no part in counts.  Very long texts: read
    whole, a chunk alone; one without white space is one unit.  Null ids and repeated rows: like any other.  Empty table: no rows.  Further columns are ignored.
    """
    scanned = _scan(id_and_text(docs, id_col, text_col), a_path, b_path, part_bytes, chunk_bytes)
    asked = scanned.filter("unit IS NOT NULL")
    units = materialise(asked.groupBy("unit").agg(F.sum("n").alias("n")).select(F.monotonically_increasing_id().alias("u"), "unit", "n"), "units")
    tokenised = _tokenised(units, a_path, b_path)
    discard(units)
    aligned = aligned_units(tokenised)
    discard(tokenised)
    sums = materialise(unit_sums(aligned, pair_counts(aligned)), "sums")
    discard(aligned)
    told = asked.select("part", "unit", "ref").join(sums, "unit").select("part", "ref", *SUMS, "groups", F.lit(None).cast("binary").alias("docs"))
    told = materialise(told, "told")  # so that nothing before it is held while the texts move
    discard(sums)
    every = told.unionByName(scanned.filter("docs IS NOT NULL").select("part", "docs"), allowMissingColumns=True)
    dealt = every.repartition("part").sortWithinPartitions("part", F.col("ref").asc_nulls_last())  # a part's units come before its documents
    fields = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in SUMS), ("groups_sha256", pa.string()), ("groups", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    class Sums:
        """A part's units with their sums, and the words made of them."""

        def __init__(self):
            self.number, self.held, self.groups = {}, [], []
            self.place, self.said, self.words = {}, [], np.zeros((1024, len(SUMS)), np.int64)

        def add(self, told: pa.RecordBatch) -> None:
            self.held.append(np.stack([told.column(2 + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(SUMS))], 1))
            self.groups += told.column(2 + len(SUMS)).to_pylist()

        def learn(self, new: list[str]) -> None:
            """Words in order of their first place, so that units get the numbers that the scan gave them."""
            if len(self.held) > 1:
                self.held = [np.concatenate(self.held)]
            pair, first = token_pair(a_path, b_path), len(self.said)
            units = [[self.number.setdefault(u, len(self.number)) for u in own] for own in pair.units_of(new)]
            for word, own in zip(new, units, strict=True):
                self.place[word] = len(self.said)
                self.said.append(";".join([self.groups[k] for k in own]))
            if len(self.said) > len(self.words):
                self.words = np.concatenate([self.words, np.zeros((max(len(self.words), len(self.said)), len(SUMS)), np.int64)])
            edge = np.cumsum([0, *map(len, units)])[:-1]
            self.words[first : len(self.said)] = np.add.reduceat(self.held[0][list(itertools.chain.from_iterable(units))], edge)

        def of(self, words: list[str]) -> tuple[list[int], str]:
            new = list(itertools.filterfalse(self.place.__contains__, dict.fromkeys(words)))
            if new:
                self.learn(new)
            at = list(map(self.place.__getitem__, words))
            return self.words[at].sum(0).tolist(), ";".join(map(self.said.__getitem__, at))

    def summed(data: bytes, sums: Sums) -> Iterator[tuple]:
        pair = token_pair(a_path, b_path)
        for doc_id, text, fine in zip(*(c.to_pylist() for c in unpacked(data).columns), strict=True):
            if fine:
                numbers, said = sums.of(pair.parts(text))
                yield doc_id, *numbers, hashlib.sha256(said.encode()).hexdigest(), said if with_groups else None
            else:
                yield doc_id, *[0] * len(SUMS), "", ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums, rows = None, None, []
        for batch in batches:
            parts = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True]))) if len(parts) else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if parts[lo] != part:
                    part, sums = parts[lo], Sums()
                own = batch.slice(lo, hi - lo)
                units = own.num_rows - own.column(1).null_count
                if units:
                    sums.add(own.slice(0, units))
                for data in own.column(3 + len(SUMS)).slice(units):
                    for row in summed(data.as_py(), sums):
                        rows.append(row)
                        if len(rows) >= 1000:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    out = map_batches(dealt.select("part", "ref", *SUMS, "groups", "docs"), run, "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string, groups string")
    return out if with_groups else out.drop("groups")


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers as P

    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), with_groups=False)
