import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm import suffix_dedup as S


def texts(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randrange(20, 90))) for _ in range(5)]
    out = []
    for _ in range(60):
        t = "".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcd ") for _ in range(r.randrange(60))) for _ in range(r.randrange(6)))
        if r.random() < 0.2:
            t += r.choice(["ab", "aaa", " x"]) * r.randrange(40)
        out.append(t)
    return out + [None, "", "a" * 100, "é" * 70, out[7]]


@pytest.mark.parametrize("hot", [50_000, 2])
def test_against_brute_force(spark, hot):
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["start"])
    cut = S.remove_repeats(docs, 25, hot=hot).select("n_bytes", removed, F.size("spans"), F.sha2("kept", 256))
    assert sorted(tuple(r) for r in cut.collect()) == sorted(S.brute_force([t for _, t, _ in rows], 25))


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_change_nothing(monkeypatch):
    text = ("".join(t or "" for t in texts(2)) * 2).encode()
    whole = S.Anchors(text, 25, 8)
    monkeypatch.setattr(S, "CHUNK", 57)
    parts = S.Anchors(text, 25, 8)
    for name in ("at", "low", "high", "string", "left", "until"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name
    assert whole.contexts(text) == parts.contexts(text)
    assert (whole.high[:-1] >= 0).all() and (whole.high - whole.low + 1).sum() == len(text) - 24


def test_family_finds_equal_windows_on_both_sides():
    """Batches in any order, against all windows compared byte for byte."""
    r, length, gram = random.Random(0), 20, 6
    pieces = ["".join(r.choice("ab\x00é") for _ in range(r.randrange(5, 30))).encode() for _ in range(12)]
    texts = [b"".join(r.choice(pieces) for _ in range(4)) for _ in range(80)]
    rows = []
    for k, t in enumerate(texts):
        a = S.Anchors(t, length, gram)
        rows += [(k, t, *x) for x in zip(a.at.tolist(), a.low.tolist(), a.high.tolist(), a.left.tolist(), a.until.tolist(), strict=True)]
    r.shuffle(rows)
    family = S.Family(length, gram)
    for lo in range(0, len(rows), 37):
        part = rows[lo : lo + 37]
        column = lambda f: np.array([f(x) for x in part])
        family.add([x[1][x[5] : x[6]] for x in part], column(lambda x: x[2] - x[5]), column(lambda x: x[3]), column(lambda x: x[4]))
    assert len(family.levels) < 6
    windows = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for k, (_, t, at, low, high, _, _) in enumerate(rows):
        again = [d for d in range(low, high + 1) if windows[t[at - d : at - d + length]] > 1]
        assert (family.nearest[k], family.farthest[k]) == ((again[0], again[-1]) if again else (-1, -1))


def test_query_against_brute_force(spark, data):
    """400 bytes, production parameters, all documents; the text left is what the digest is of."""
    got = S.op10_suffix_dedup(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, S.brute_force([d.text for d in docs]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(docs)
    assert sum(r.n_removed > 0 for r in got) > 10
    assert all(r.text is not None and len(r.text.encode()) >= r.n_bytes - r.n_removed for r in got)


def test_very_long_text_and_clashing_columns(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long + "x" * 900, "a"), (2, "y" + long[1000:2000], "b"), (None, "", None), (4, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    cut = S.remove_repeats(docs, 400).select("n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["start"]), F.size("spans"), F.sha2("kept", 256))
    assert sorted(tuple(x) for x in cut.collect()) == sorted(S.brute_force([t for _, t, _ in rows], 400))
