"""A corpus pipeline of five stages over documents: language, exact copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns documents' columns; the last
returns packed pieces.  Between stages the rows are written as Parquet, so that a lost executor costs one
stage's tasks and each stage plans with true sizes.

In every stage null and empty texts are texts without words: the first stage drops them, as they have no letter; the others
would keep them.  Rows with null or repeated ids are rows of their own.  Repeated rows and ties: the first of equals stays.  Very long
texts are read whole.  Null sources are a source of their own.  An empty table gives an empty result.  Further columns, whatever their names,
are kept up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import exact_dedup, language_id, mixing, ngram_jaccard, packing
from sylvan.llm.common import id_remainder, materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from docs with a lang (crc32(doc_id) mod 4 not 2), drops rows without a letter, sets lang to the prediction."""
    filters = language_id.train(docs.filter(id_remainder(F.col("doc_id"), 4) != 2))
    return language_id.with_language(docs, filters)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for white space) the longest, then first, stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more of five-word shingles, the first stays."""
    return ngram_jaccard.drop_similar(docs, words=5, threshold=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows as often as they are in the mix."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 ids: a row for each piece."""
    import public_tokenizers

    return packing.packed_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mix), ("packing", pack)]

#: Language identification and tokenisation have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
