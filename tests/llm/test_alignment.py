"""Token alignment against loops over whole texts' tokens by the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from sylvan.llm import alignment as A

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def byte_chars():
    """Byte-level vocabularies' characters for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokens(libraries, text):
    """((id, bytes) of A, (id, bytes) of B), or none."""
    t, s = libraries
    chars = byte_chars()
    if not text:
        return [], []
    a = [(i, bytes(chars[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()) for i in s.encode(text)]
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def brute_force(libraries, docs):
    spans, links = [], []
    for _, text in docs:
        both = []
        for own in tokens(libraries, text):
            at, out = 0, []
            for i, data in own:
                out.append((i, at, at + len(data)))
                at += len(data)
            both.append(out)
        spans.append(both)
        a, b = both
        own, first = [], 0
        for i, lo, hi in a:
            while first < len(b) and b[first][2] <= lo:
                first += 1
            k = first
            while k < len(b) and b[k][1] < hi:
                own.append((i, b[k][0]))
                k += 1
        links.append(own)
    times = Counter(p for own in links for p in own)
    most = Counter()
    for (_, b), n in times.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), (a, b), own in zip(docs, spans, links, strict=True):
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        said, i, j = [], 0, 0
        for c in cuts:
            k, m = i, j
            while i < len(a) and a[i][2] <= c:
                i += 1
            while j < len(b) and b[j][2] <= c:
                j += 1
            said.append(",".join(str(x[0]) for x in a[k:i]) + "|" + ",".join(str(x[0]) for x in b[m:j]))
        digest = hashlib.sha256(";".join(said).encode()).hexdigest() if said else ""
        out.append((doc_id, len(a), len(b), len(cuts), len(own), sum(times[p] == most[p[1]] for p in own), sum(times[p] for p in own), digest))
    return sorted(out, key=str)


ODD = [None, "", " ", "  ", "\n", "a▁b", "<s> x</s> <|endoftext|> <unk> <0x41>", "it's.don't, ok.,a", "x  y\x0bz \x1c q\r\n\r\n.", "  two  spaces\n\n  here \t.tab\t,x", "naïve café.². 3.5,7 你好 \U0001f600\U0001f680 é", "　wide", "x" * 700, "foo.\rbar;\r\n", "a. b.c,d .e ,f\n.g", "\x00\x01 z", "def f(x):\n    return x  # ok\n", "é" * 90 + ". " + "ß,"]


def test_against_loops(spark, libraries):
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "Null id."), (3, "Null id.")]
    rows += [(100 + i, "".join(r.choice(["the ", "cat.", "\n", " sat, ", "ünï", " ", ".", "x1,", "\t", "\r", "don't ", " "]) for _ in range(r.randrange(30)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, unit string").repartition(3)
    got = A.align_tokens(docs, A_PATH, B_PATH, part_bytes=200, chunk_bytes=60).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(libraries, rows)


def test_query_against_loops(spark, data, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = A.op12_token_alignment(spark, data)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(libraries, docs)


def test_units_and_whole_texts_agree(spark, data, monkeypatch):
    """A vocabulary that keeps to no units is aligned text by text."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(15)
    by_units = sorted(map(tuple, A.align_tokens(docs, A_PATH, B_PATH).collect()))
    pair = A.token_pair(A_PATH, B_PATH)
    assert all("".join(pair.units(t)) == " " + t for t in ODD if t) and pair.units("word.Next, one\n") == [" word", ".Next", ",", " one", "\n"]
    assert len(by_units) == 15 and all(len(r[8].split(";")) == r[3] for r in by_units if r[1])


def test_a_check_of_every_unit_gives_the_same(spark, libraries, monkeypatch):
    """Without what is known of these vocabularies, tokens are held against bytes unit by unit."""
    pair = A.token_pair(A_PATH, B_PATH)
    assert pair.lossless
    monkeypatch.setattr(pair, "lossless", False)
    assert [pair.agrees(t, pair.parts(t)) for t in ODD if t] == [bool(tokens(libraries, t)[0]) for t in ODD if t]
    monkeypatch.setattr(A, "MEMORY", 3)
    assert pair.units("one two one. three, four\none") == [" one", " two", " one", ".", " three", ",", " four", "\none"]


def test_empty_table(spark):
    assert A.align_tokens(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0
