"""Difference-cover anchors against all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm import substring_dedup as S


def brute_force(rows, window):
    """(id, words, spans, text) of (id, text), window by window; a null id is the least."""
    key = lambda i: (i is not None, i or 0)
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            least[s] = min(least.get(s, key(i)), key(i))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < key(i) for j in range(k, k + window)}
        spans = [j for j in range(len(w) + 1) if (j in gone) != (j - 1 in gone)]
        out.append((i, len(w), list(zip(spans[::2], spans[1::2], strict=True)), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def made_up(seed, n=90):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdef") for _ in range(r.randrange(3, 25))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.6 else " ".join(r.choice(["a", "bé", "c", "dd", "e"]) for _ in range(r.randrange(9))) for _ in range(r.randrange(7))]
        out.append((r.choice([None, i, i, i, i // 2, -i]), r.choice([" ", "\n", " \t"]).join(parts)))
    return out + [(5, None), (6, ""), (7, " \x0b "), out[3], out[4], (400, out[5][1]), (401, "x " * 60), (402, "x " * 50)]


def found(df):
    return sorted(((r.doc_id, r.n_words, [(s.start, s.until) for s in r.spans], r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize(("window", "period", "cover"), [(13, 7, (0, 1, 3)), (5, 3, (0, 1)), (4, 4, (0, 1, 2)), (3, 1, (0,))])
def test_against_brute_force(spark, window, period, cover):
    rows = made_up(window)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = found(S.remove_passages(docs, window=window, period=period, cover=cover, chunk_bytes=300, bucket_text=500))
    assert got == sorted(brute_force(rows, window), key=str)
    assert sum(bool(s) for _, _, s, _ in got) > 10


def test_chunks_change_nothing(spark):
    rows = made_up(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(S.remove_passages(docs, window=5, period=3, cover=(0, 1))) == found(S.remove_passages(docs, window=5, period=3, cover=(0, 1), chunk_bytes=1))


def test_long_words_and_texts(spark):
    r = random.Random(2)
    long = " ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(300_000))
    rows = [(1, long), (2, "y " + long[5000:9000]), (3, "z" * (S.STRIDE + 9) + " " + "q " * 20), (4, "z" * (S.STRIDE + 9) + " " + "q " * 20), (5, "z" * (S.STRIDE + 8) + " q" * 12)]
    got = found(S.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(brute_force(rows, 13), key=str)


def test_covers(spark):
    with pytest.raises(ValueError, match="cover"):
        S.check_cover(13, 7, (0, 1, 2))
    places = S.Documents([b"w " * 50], 13, 7).anchors(7, (0, 1, 3))[1]
    for i in range(20):
        for j in range(20):
            assert any(np.isin(i + k, places) and np.isin(j + k, places) for k in range(7))


def test_empty_table(spark):
    assert S.remove_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {i: (n, sum(y - x for x, y in s), hashlib.sha256(t.encode()).hexdigest(), t) for i, n, s, t in brute_force(docs, 13)}
    got = S.op11_substring_dedup(spark, data)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and got.filter(F.col("n_removed") > 0).count() > 10
