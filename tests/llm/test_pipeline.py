import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm import mixing, ngram_jaccard
from sylvan.llm.common import materialise

duckdb = pytest.importorskip("duckdb")
public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer


def test_stages_against_brute_force(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    junk = spark.createDataFrame([(100_000, "123 !!", None, None, 6), (100_001, None, "en", "src1", 0)], docs.schema)
    docs = docs.select(*docs.columns).unionByName(junk)
    rows = {r.doc_id: r for r in docs.collect()}

    kept = p.language(spark, docs, data)
    assert kept.columns == docs.columns
    after = {r.doc_id for r in kept.collect()}
    assert after == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}

    kept = p.exact_copies(spark, kept, data)
    groups = defaultdict(list)
    for i in after:
        groups["".join(c for c in rows[i].text if c not in " \t\n\x0b\x0c\r")].append((-len(rows[i].text), i))
    stay = {min(g)[1] for g in groups.values()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == stay

    kept = p.near_copies(spark, kept, data)
    found = ngram_jaccard.brute_force([(i, rows[i].text) for i in sorted(stay)], 5, 80)
    stay = {c for _, _, c in found}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == stay

    kept = materialise(kept, "kept")
    path = shared_path(kept, spark)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = {}
    for i, size, _, _, taken in con.execute(mixing.ORACLE).fetchall():
        want[i] = taken // size if size else None  # an empty text's copies cannot be told from its words
    mixed = materialise(p.mix(spark, kept, data), "mixed")
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert {i: n for i, n in copies.items() if want[i] is not None} == {i: n for i, n in want.items() if n}

    got = p.pack(spark, mixed, data).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ids = {i: [*library.encode(rows[i].text, add_special_tokens=False).ids, 1] for i in copies}
    pieces, seats = Counter(), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id, r.start, r.length] += 1
        seats[r.sequence_id].append((r.offset, r.length))
    for i, n in copies.items():  # each copy's ids once
        own = sorted((start, length) for (j, start, length) in pieces if j == i)
        assert all(pieces[i, *x] == n for x in own) and [a for a, _ in own] == [0, *np.cumsum([k for _, k in own])[:-1].tolist()]
        assert sum(k for _, k in own) == len(ids[i])
    for own in seats.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([k for _, k in own])[:-1].tolist()] and sum(k for _, k in own) <= 2048


def shared_path(df, spark):
    return df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")


def test_repeated_and_null_ids(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (None, "a b c d e f g ", "en", None, 1), (None, None, "en", None, 1), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    assert p.exact_copies(spark, docs, "").count() == 2
    assert p.near_copies(spark, docs, "").count() == 3
    assert p.mix(spark, docs, "").count() >= 3
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_clashing_columns_and_long_texts(spark):
    """Further columns of any name pass all stages but the last, and texts of a million characters do."""
    import corpus_pipeline as p

    clash = {"row": 1, "leaf": 2, "n": 3, "part": 4, "copies": 5, "size": 6, "component_id": 7, "bucket": 8, "lang_pred": 9}
    long = " ".join(f"w{k % 997}x" for k in range(180_000))
    rows = [(1, long, "en", "s", 1), (2, long + " tail", "en", "s", 1), (3, "an other text of some words", "en", None, 1), (4, None, None, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(v) for c, v in clash.items()})
    left = [3, 3, 2]
    for (_, stage), n in zip(p.STAGES, left, strict=False):
        docs = materialise(stage(spark, docs, ""), "stage")
        assert set(clash) < set(docs.columns) and docs.count() == n
    docs = materialise(p.mix(spark, docs, ""), "mixed")
    assert set(clash) < set(docs.columns) and docs.select(*clash).distinct().collect() == [tuple(clash.values())]
    assert p.pack(spark, docs, "").agg(F.max("doc_tokens")).first()[0] > 300_000


def test_run_is_its_stages(spark, data):
    import corpus_pipeline as p

    names = [n for n, _ in p.STAGES]
    assert names == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in p.STAGES:
        docs = materialise(stage(spark, docs, data), "stage")
    got = p.run(spark, data)
    assert got.columns == docs.columns and got.drop("sequence_id", "offset").exceptAll(docs.drop("sequence_id", "offset")).isEmpty() and got.count() == docs.count()
