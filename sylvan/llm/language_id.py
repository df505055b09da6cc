"""Language identification with bit-sliced Bloom filters of n-grams.

For each language a set of typical n-grams is learned.  All sets live in one table of 2**bits slots; a
slot is a mask with a bit for each language, so the table is as many Bloom filters as languages, bit-sliced.
A mask has as many words of 64 bits as the languages need.
The AND of an n-gram's slots names all languages that hold it at once.  A text is decided by its
per-language popcounts (how many of its n-grams' masks have the bit), from which the hits that the filter's fill
lets expect by chance are taken: (hits - n * f) / (1 - f), f = fill ** hashes.

Training counts n-grams of a bounded sample: at most ``max_train_docs`` labelled documents of a language,
chosen by a hash of id and text, each read whole.  An n-gram belongs to each language in which its share of all n-grams
is at least ``SHARE`` of its largest share in any language, if it is among the language's ``TOP`` most frequent ones
and was seen in at least MIN_DOCS documents, or in one where the language has fewer than FEW_DOCS to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, id_remainder, map_batches

ORDERS = (2, 3, 4)
TOP, SHARE, MIN_DOCS, FEW_DOCS = 20_000, 0.3, 2, 5
BITS, HASHES = 20, 3
MAX_TRAIN_DOCS = 4000
#: Code points handled at once.
CHUNK = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _folded(text: str) -> np.ndarray:
    """Code points in lower case; whatever is no letter separates words as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_letter = (points >= 97) & (points <= 122)
    other = np.flatnonzero(points > 127)
    letter = ascii_letter
    if len(other):
        distinct, which = np.unique(points[other], return_inverse=True)
        letter[other] = np.array([chr(c).isalpha() for c in distinct])[which]
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of separators after a letter, the first
    if len(keep) and not letter[-1]:
        last = np.flatnonzero(letter)
        keep[last[-1] + 1 if len(last) else 0 :] = False  # the closing space comes by itself
    return np.concatenate(([np.uint32(32)], points[keep], [np.uint32(32)]))


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of all orders, in chunks of a bounded size; none span only separators."""
    points = _folded(text)
    for lo in range(0, len(points), CHUNK):
        p = points[lo : lo + CHUNK + max(ORDERS) - 1].astype(np.uint64)
        for n in ORDERS:
            m = min(CHUNK, len(points) - lo - n + 1, len(p) - n + 1)
            if m > 0:
                h = np.full(m, n, np.uint64)
                for k in range(n):
                    h = h * MIX + p[k : k + m]
                yield _mixed(h)


class Filters:
    """The bit-sliced filters: ``slots`` of masks, a row for each word of 64 languages, a bit a language."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.languages, self.slots = languages, np.zeros((max(1, -(-len(languages) // 64)), 1 << BITS), kind)
        for k, grams in enumerate(members):
            for at in self._places(grams):
                np.bitwise_or.at(self.slots[k // 64], at, kind(1 << k % 64))
        fill = np.array([np.count_nonzero(self.slots[k // 64] & kind(1 << k % 64)) for k in range(len(languages))]) / (1 << BITS)
        self.chance = fill**HASHES

    @staticmethod
    def _places(h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(HASHES):
            yield (h >> np.uint64(k * BITS)) & np.uint64((1 << BITS) - 1)

    def masks(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """The masks of n-grams, word by word."""
        places = list(self._places(h))
        for word in self.slots:
            out = word[places[0]]
            for at in places[1:]:
                out &= word[at]
            yield out

    def decide(self, text: str) -> tuple[str, float]:
        """(language, share of the corrected hits that are its own); ``und`` without a letter."""
        if not any(c.isalpha() for c in text):
            return "und", 0.0
        hits, n = np.zeros(len(self.languages)), 0
        for h in ngrams(text):
            n += len(h)
            for word, masks in enumerate(self.masks(h)):
                part = hits[64 * word : 64 * word + 64]
                part += np.bincount(masks, minlength=256) @ _BIT_OF[:, : len(part)] if masks.dtype == np.uint8 else [np.count_nonzero(masks & np.uint64(1 << k)) for k in range(len(part))]
        if not len(hits):
            return "und", 0.0
        own = np.maximum(0, (hits - n * self.chance) / (1 - self.chance))
        best = int(np.argmax(own))  # the first of equals, in the order of language names
        return self.languages[best], float(own[best] / own.sum()) if own.sum() else 0.0


_BIT_OF = (np.arange(256)[:, None] >> np.arange(8)) & 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_docs: int = MAX_TRAIN_DOCS) -> Filters:
    """Filters learned from the rows of docs with a language; leave out rows to be held out before."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return Filters([], [])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    part = F.when(F.lit(False), 1.0)  # one flat CASE, whatever the number of languages
    for lang, n in sizes.items():
        if n > max_train_docs:
            part = part.when(F.col("lang") == lang, F.lit(max_train_docs / n))
    part = part.otherwise(1.0)
    sample = rows.filter(chance < part).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = list(ngrams(text))
                if parts:
                    grams, n = np.unique(np.concatenate(parts), return_counts=True)
                    seen.setdefault(lang, []).append((grams, n))
            for lang in list(seen):
                grams = np.concatenate([g for g, _ in seen[lang]])
                times = np.concatenate([n for _, n in seen.pop(lang)])
                distinct, which, in_docs = np.unique(grams, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct.view(np.int64)), pa.array(np.bincount(which, times).astype(np.int64)), pa.array(in_docs.astype(np.int64))], ["lang", "gram", "n", "docs"])

    counted = map_batches(sample, count, "lang string, gram long, n long, docs long")
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    grams = grams.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    few = [lang for lang, n in sizes.items() if min(n, max_train_docs) < FEW_DOCS]
    grams = grams.filter((F.col("docs") >= MIN_DOCS) | F.col("lang").isin(few)).withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    kept = grams.filter(F.col("share") >= SHARE * F.col("most")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).filter(F.col("k") <= TOP)
    found = kept.select("lang", "gram").toArrow()  # at most TOP rows a language
    languages = sorted(sizes)
    which = pc.index_in(found["lang"], value_set=pa.array(languages, pa.string())).to_numpy()
    order = np.argsort(which, kind="stable")
    members = np.split(found["gram"].to_numpy()[order].view(np.uint64), np.searchsorted(which[order], np.arange(1, len(languages))))
    return Filters(languages, members)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    Null or empty text, or none but digits and signs: ``und`` and 0.  Very long texts: read whole, in chunks.
    Ties: the first language by name.  Null ids and repeated rows: answered like any other.  Filters without a
    language: always ``und``.  Empty table: no rows.  Further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**BITS slots, whatever the corpus

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.decide(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = id_and_text(docs, id_col, text_col)
    return map_batches(rows, decide, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, filters: Filters, text_col: str = "text", out_col: str = "lang") -> DataFrame:
    """docs with the decision in out_col (which may be there already), rows of no language (``und``) left out.

    All columns pass the worker in one go, so that a text is decided once.  Null or empty texts are ``und``.  Null ids, repeated rows,
    very long texts and further columns: kept as they are.  Empty table: no rows.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(filters), docs.columns.index(text_col)
    to = docs.columns.index(out_col) if out_col in docs.columns else len(docs.columns)
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    fields[to : to + 1] = [T.StructField(out_col, T.StringType())]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shared.value.decide(t.as_py() or "")[0] for t in batch.column(place)], pa.string())
            columns = list(batch.columns)
            columns[to : to + 1] = [found]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields]).filter(pc.not_equal(found, "und"))

    return map_batches(docs, decide, T.StructType(fields))


def op5_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = id_remainder(F.col("doc_id"), 4) == 2
    return identify(docs, train(docs.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")
