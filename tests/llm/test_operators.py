"""Each operator on odd tables (nulls, empty and very long texts, repeated rows, no rows, clashing columns) and against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm import common, exact_dedup, language_id, mixing, ngram_jaccard, packing, quality, records, suffix_dedup, tokens, topk, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
CLASH = "row long, leaf int, key string, size long, part int, n long, body string, count long, score double, step long, h long, stage int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def odd_rows():
    r = random.Random(5)
    long = " ".join(r.choice(["the", "le", "der", "word", "Éclair", "x1"]) for _ in range(60_000))
    texts = [None, "", " \n\t", "a b  c", "a b c", "abc", "123 !!", long, long, "ça va\u00a0bien? I've \u4e2d\u6587 \U0001f600 e\u0301", "<|endoftext|> it's", "A\x0bB\x1cC"]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", ""][i % 4], 1) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "abc", "en", None, 0), (None, None, None, None, None)]
    return [(*row, *[1, 1, "k", 1, 1, 1, "b", 1, 0.5, 1, 1, 1]) for row in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = {}
    for path in (BYTE, WORD):
        out[path] = Tokenizer.from_file(path)
        out[path].encode_special_tokens = True
    return out


def stripped(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_groups(odd):
    rows = [(r[0], r[1]) for r in odd_rows()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[stripped(t)].append((-len(t or ""), i is None, i or 0))
    got = exact_dedup.exact_groups(odd, fan_in=2).collect()
    assert len(got) == len(rows)
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(groups[key])
        assert r.keep_id == (None if best[1] else best[2]) and r.group_size == len(groups[key])
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(k.encode()).hexdigest(): 1 for k in groups})
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_merge_rounds_keep_the_best(spark):
    docs = spark.range(300).select("id", F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text")).repartition(40)
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs, "id", fan_in=2).collect()}
    assert got == {i: i % 7 for i in range(300)}


@pytest.mark.parametrize("size", [40, 200_000])
def test_runs_are_sorted_slices_of_one_record_a_digest(spark, monkeypatch, size):
    monkeypatch.setattr(exact_dedup, "SLICE", size)
    docs = spark.range(900).select("id", F.concat(F.lit("t"), (F.col("id") % 250).cast("string")).alias("text")).repartition(30)
    runs = common.materialise(exact_dedup.digest_runs(docs, "id"), "digests")
    for df, most in ((exact_dedup.leaf_runs(runs, 5), 30), (exact_dedup.merge_round(exact_dedup.leaf_runs(runs, 5), 4, 7, 9), 8)):
        ranges = defaultdict(list)
        for r in df.collect():
            x = np.frombuffer(r.records, exact_dedup.RECORD)
            assert (x["key"][1:] > x["key"][:-1]).all()
            ranges[r.run].append((x["key"][0], x["key"][-1], int(x["size"].sum())))
        assert len(ranges) <= most and sum(n for own in ranges.values() for _, _, n in own) == 900
        for own in ranges.values():
            own.sort()
            assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))
    found = exact_dedup.merge_runs(runs, 30, 3).collect()
    assert sorted((r.keep_id, r.group_size) for r in found) == [(i, 4 if i < 150 else 3) for i in range(250)]


def test_ids_are_whole_numbers(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for call in (exact_dedup.exact_groups, ngram_jaccard.similar_groups, suffix_dedup.remove_repeats):
        with pytest.raises(TypeError, match="whole numbers"):
            call(docs)


def test_urls_against_rules(spark):
    urls = ["http://a.ORG/x", "https://example.org/es/1", "https://www.example.org/en/17?q", "http://example.org/en/2", "http://x.com/fr/", "http://com/de/1", "http://xcom/de/1", "ftp://org", "http://org/", None, "", "no scheme", "a://b.org:80/", "http://É.org/#y", "http://a.org/b://c.com/de/", "x" * 9000 + "://q.com/fr/" + "y" * 9000, "http://a.org/x", "http://" + "l." * 5000 + "org/"]
    pages = spark.createDataFrame([(i if i != 3 else None, u, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")

    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, "allow"))

    got = url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect()
    assert sorted(map(str, ((r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, map(judge, urls)))
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_url_list_of_many_entries(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".net/p")).alias("url"))
    got = url_filter.filter_urls(pages, listed)
    assert got.filter("(verdict = 'block') <> (page_id < 3000)").isEmpty()


@pytest.mark.parametrize("wide", [False, True])
def test_top_products(spark, wide):
    r = np.random.default_rng(1)
    vectors = [[float(x) for x in v] for v in r.normal(size=(400, 12)).astype(np.float32)] + [[0.5] * 12] * 8
    if wide:
        vectors[7] = [1e30] * 12
        vectors[9] = [1.0] * 5
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    rows += [(50, vectors[50], 1), (900, None, 1), (901, [1.0, None], 1), (902, [float("nan")], 1), (None, [1.0] * 12, 1), (None, vectors[50], 1), (903, [float("inf")], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm int").repartition(3)
    used = [(i, [int(np.floor(256 * x)) if abs(x) < 1e15 else int(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    used = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for (i, _), (_, v, _) in zip(used, [x for x in rows if x[1] and all(y is not None and np.isfinite(y) for y in x[1])], strict=True)]
    want = []
    for k, (i, q) in enumerate(used):
        if i is not None and i % 50 == 0:
            s = sorted((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=False)))) * -1, j is None, j) for m, (j, c) in enumerate(used) if m != k)
            want += [(i, n + 1, j, -x) for n, (x, _, j) in enumerate(s[:5])]
    got = topk.top_products(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(x[2] is None for x in want)
    assert topk.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_products(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(library, path):
    r = random.Random(2)
    enc, pool = tokens.Encoder(path), [chr(c) for c in range(0x180)] + list(" \n'.,!stveld") * 20
    for _ in range(4000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(14)))
        want = np.array(library[path].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.ids([text])[0] == want, ascii(text)


def test_memory_turns_over(monkeypatch, library):
    monkeypatch.setattr(tokens, "MEMORY", 5)
    enc = tokens.Encoder(BYTE)
    for text in ["a b c d e f g", "h i j a b", "k, l. m? a, b.", "a b c d e f g"]:
        assert enc.ids([text])[0] == np.array(library[BYTE].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_vocabularies_go_through_the_library(tmp_path, library):
    """A split that isn't one of the two known ones: ids are the library's all the same."""
    import json

    d = json.load(open(BYTE))
    d["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, d["pre_tokenizer"]]}
    path = tmp_path / "digits.json"
    path.write_text(json.dumps(d))
    from tokenizers import Tokenizer

    enc, own = tokens.Encoder(str(path)), Tokenizer.from_file(str(path))
    assert not enc.split and tokens.Encoder(BYTE).split and tokens.Encoder(WORD).split
    for text in ("in 1984 or 20250", "x12y", ""):
        assert enc.ids([text])[0] == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces_of(library, end):
    return Counter(zlib.crc32(np.array([*library[BYTE].encode(r[1] or "", add_special_tokens=False).ids, end], "<u4").tobytes()) for r in odd_rows())


def test_packing(odd, library):
    rows = packing.pack_documents(odd, BYTE, 1, 64).orderBy("sequence_id", "offset").collect()
    whole = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        whole[r.sequence_id].append(r)
    for own in whole.values():
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1]) and sum(r.length for r in own) <= 64
    assert sorted(whole) == list(range(len(whole)))
    docs = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
    singles = {i: d for i, d in docs.items() if i is not None and i != 4}
    want = pieces_of(library, 1)
    for own in singles.values():
        own.sort(key=lambda r: r.start)
        joined = b"".join(bytes(r.ids) for r in own)
        assert len(joined) == 4 * own[0].doc_tokens and want[zlib.crc32(joined)] >= 1
    assert packing.pack_documents(odd.limit(0), BYTE).count() == 0


def test_plan_is_best_fit_decreasing():
    r = random.Random(4)
    for _ in range(30):
        counts = Counter(r.randrange(1, 41) for _ in range(r.randrange(200)))
        open_, used = [], 0
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [x for x in open_ if x >= length]
                if fits:
                    open_.remove(min(fits))
                    open_.append(min(fits) - length)
                else:
                    open_.append(40 - length)
                    used += 1
        seats = defaultdict(list)
        for length, low, high, first, each, at in packing.plan_windows(counts, 40):
            for k in range(high - low):
                seats[first + k // each].append((at + k % each * length, length))
        assert len(seats) == used and sum(len(s) for s in seats.values()) == sum(counts.values())
        for s in seats.values():
            s.sort()
            assert [a for a, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 40


def test_language_id_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = language_id.op5_language_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()


def test_language_id_odd(spark, odd):
    filters = language_id.train(odd)
    got = language_id.identify(odd, filters).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 6)} == {"und"}
    assert language_id.train(odd.limit(0)).languages == []
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(odd.limit(0))).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), filters).count() == 0
    assert language_id.with_language(odd, filters).columns == odd.columns


def test_language_id_beyond_one_word(spark):
    own = lambda k: " ".join(chr(0x4E00 + 40 * k + j) + chr(0x4E00 + 40 * k + j + 1) for j in range(20))
    docs = spark.createDataFrame([(3 * k + i, own(k), f"x{k:03d}") for k in range(130) for i in range(3)], "doc_id long, text string, lang string")
    filters = language_id.train(docs)
    assert len(filters.languages) == 130 and filters.slots.shape[0] == 3
    got = language_id.identify(docs, filters).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 390 and all(r.lang_pred == r.lang for r in got)


def test_language_of_one_document(spark):
    rows = [(k, "the cat sat on the mat", "en") for k in range(9)] + [(9, "żółw śpi pod łóżkiem", "pl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.train(docs)).filter("doc_id = 9").first()
    assert got.lang_pred == "pl"


def test_language_sample_of_null_ids(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    ngrams = language_id.ngrams

    def counted(text):
        read.add(1)
        return ngrams(text)

    monkeypatch.setattr(language_id, "ngrams", counted)
    docs = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text ', repeat('ab', CAST(id % 7 AS INT)), ' ', id) AS text", "'en' AS lang")
    language_id.train(docs, max_train_docs=200)
    assert 100 < read.value < 300


def test_ngrams_hold_a_letter():
    for text in ("  ab, c!  ", "...", "", "a", "1a1"):
        p = language_id._folded(text)
        assert not ((p[1:] == 32) & (p[:-1] == 32)).any() or not any(c.isalpha() for c in text)
    assert "".join(map(chr, language_id._folded("--Ab  c?? "))) == " ab c "


def test_language_chunks(monkeypatch):
    text = "Der Wald und die Stadt " * 20
    whole = Counter(np.concatenate(list(language_id.ngrams(text))).tolist())
    monkeypatch.setattr(language_id, "CHUNK", 13)
    assert Counter(np.concatenate(list(language_id.ngrams(text))).tolist()) == whole


def test_quality_held_out(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").groupBy("doc_id").agg(F.first("quality").alias("q"))
    got = quality.op1_quality(spark, data).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["q"]).mean() >= 0.9 and got["score"].between(0, 1).all()


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(8)] + [(3, 0, 9), (None, 1, 9), (2, None, 9)], "doc_id long, quality int, score int")
    for model in (quality.train(odd, labels), quality.train(odd, labels.limit(0)), quality.train(odd.limit(0), labels), quality.train(odd, labels.withColumn("quality", F.lit(1)))):
        got = quality.score(odd, model).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score(odd.limit(0), model).count() == 0


def test_rules_are_compiled_as_learned(spark):
    r = np.random.default_rng(3)
    x = {"a": r.normal(size=500), "b": r.normal(size=500)}
    y = ((x["a"] > 0.2) & (x["b"] <= 0.5)).astype(float)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) < 30
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x["a"], x["b"], strict=True)], "a double, b double")
    got = np.array([s[0] for s in df.select(model.score()).collect()])
    z = model.intercept + sum(w * rule.holds(x) for rule, w in zip(model.rules, model.weights, strict=True))
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got >= 0.5) == y).mean() > 0.97


def test_records(spark, odd, library, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "SHARD_BYTES", 100_000)
    path = records.write_records(odd, f"file://{tmp_path}/r", WORD)
    got = records.record_digests(spark, path).orderBy("start").collect()
    hashed = dict(odd.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect())
    order = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = np.array([*library[WORD].encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    index = spark.read.parquet(f"{path}/index").orderBy("shard", "offset").collect()
    one = index[len(index) // 2]
    shard = open(f"{tmp_path}/r/data/{one.file}", "rb").read()
    found = next(records.frames(shard[one.offset : one.offset + one.size]))
    assert found[2] == one.doc_id and len(found[3]) == 4 * one.n_tokens
    for k in (0, 9, one.size // 2, one.size - 2):
        broken = bytearray(shard[one.offset : one.offset + one.size])
        broken[k] ^= 1
        with pytest.raises(ValueError, match="checksum|cut off"):
            list(records.frames(bytes(broken)))
    for k in (5, 13, one.size - 1):
        with pytest.raises(ValueError, match="cut off"):
            list(records.frames(shard[one.offset : one.offset + k]))
    wanted = spark.createDataFrame([(r.file, r.offset, k) for k, r in enumerate(reversed(index))], "file string, offset long, position long")
    met = {r.position: (r.doc_id, r.n_tokens) for r in records.read_at(spark, path, wanted).collect()}
    assert met == {k: (r.doc_id, r.n_tokens) for k, r in enumerate(reversed(index))}
    a, b = ([(r.position, r.doc_id, zlib.crc32(r.ids)) for r in records.shuffled_records(spark, path, s).collect()] for s in (1, 2))
    crcs = Counter(r.ids_crc32 for r in got)
    assert a == sorted(a, key=lambda r: r[0]) and Counter(x[2] for x in a) == Counter(x[2] for x in b) == crcs and [x[2] for x in a] != [x[2] for x in b]
    empty = records.write_records(odd.limit(0), f"file://{tmp_path}/e", WORD)
    assert records.record_digests(spark, empty).count() == 0


def test_wide_ids():
    data = records.frame(None, np.array([70_000, 1], "<u4").tobytes()) + b"\n" + records.frame(-5, b"") + b"\n"
    assert [(d, np.frombuffer(i, "<u4").tolist()) for _, _, d, i in records.frames(data)] == [(None, [70_000, 1]), (-5, [])]


def test_mixing(spark, odd):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(odd_rows())
    per = defaultdict(list)
    for r in got:
        assert 0 <= r.copies <= 3
        per[r.source].append(r)
    for own in per.values():
        taken, most = sum(r.copies * r["size"] for r in own), max(r["size"] for r in own)
        assert abs(taken - own[0].target) <= 2 * most and own[0].target <= 3 * own[0].source_size
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(odd.repartition(5)).collect()), key=str)
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1), ("d", 500)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 3 and got["c"] == 3 and got["a"] == got["d"] == pytest.approx(298)


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    words = common.bloom_words(df, "h", 5000)
    inside = np.array([r.h for r in df.collect()])
    assert common.bloom_passes(words, inside).all()
    assert common.bloom_passes(words, np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.1


def test_short_vectors_stay_out(spark, monkeypatch):
    """Small blocks and few known vectors: groups that cannot hold an answer are dropped before the join, and results stay whole."""
    r = np.random.default_rng(8)
    vectors = [[float(x) for x in v] for v in r.normal(size=(3000, 8)) * np.where(np.arange(3000) < 300, 10.0, 0.01)[:, None]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    for name, value in (("LEAST_BLOCK", 100), ("HEAD", 200), ("QUERIES", 7)):
        monkeypatch.setattr(topk, name, value)
    got = topk.top_products(df, F.col("vec_id") % 50 == 0).collect()
    v = np.floor(256 * np.array(vectors)).astype(np.int64)
    want = []
    for i in range(0, 3000, 50):
        s = sorted((-int(v[i] @ v[j]), j) for j in range(3000) if j != i)[:5]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_lasso_reaches_its_optimum():
    r = np.random.default_rng(6)
    base = r.random((4000, 30)) < 0.3
    h = np.hstack([base, base[:, :20] & base[:, 10:]]).astype(np.float32)  # rules that imply others, as paths of trees do
    y = (r.random(4000) < 1 / (1 + np.exp(-(2.0 * h[:, 0] - 1.5 * h[:, 31] - 0.5)))).astype(float)
    most = float(np.abs(h.T @ (y - y.mean())).max() / len(y))
    w = None
    for p in quality.PENALTIES:
        w = quality.lasso(h, y, p * most, w)
        assert quality.off_optimum(np.hstack([np.ones((4000, 1)), h]), y, w, p * most) <= 0.06 * p * most
        if p == 0.1:
            assert w[1] > 0.5 and w[32] < -0.3 and (np.abs(w[1:]) > 1e-6).sum() < 20


def test_packing_query_against_the_library(spark, data, library):
    docs = {r.doc_id: [*library[BYTE].encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    seats, parts = defaultdict(list), defaultdict(list)
    for r in packing.op4_packing(spark, data).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(docs[r.doc_id])
        seats[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length))
    assert set(parts) == set(docs)
    for i, own in [*parts.items(), *seats.items()]:
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()], i
    assert all(sum(n for _, n in own) == len(docs[i]) for i, own in parts.items()) and all(sum(n for _, n in own) <= 2048 for own in seats.values())
    total = sum(map(len, docs.values()))
    assert len(seats) <= -(-total // 2048) + 2  # little padding


def test_records_query_against_the_library(spark, data, library):
    docs = sorted((r.doc_id, [*library[WORD].encode(r.text or "", add_special_tokens=False).ids, 2]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    starts = np.cumsum([0] + [len(ids) for _, ids in docs])
    want = [(i, int(at), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, ids), at in zip(docs, starts, strict=False)]
    assert sorted(tuple(r) for r in records.op6_binary_records(spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_language_decisions_against_plain_sets(spark, data):
    """The learned sets without a filter, n-grams as strings counted in Python: the same decisions, and no n-gram lost."""
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [r for r in rows if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    filters = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))

    def grams(text):
        folded = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} "
        return [] if not folded.strip() else [folded[k : k + n] for n in language_id.ORDERS for k in range(len(folded) - n + 1)]

    total, docs = defaultdict(Counter), defaultdict(Counter)
    for r in train:
        g = grams(r.text)
        total[r.lang].update(g)
        docs[r.lang].update(set(g))
    size = {k: sum(c.values()) for k, c in total.items()}
    few = {k for k in total if sum(r.lang == k for r in train) < language_id.FEW_DOCS}
    share = {k: {g: n / size[k] for g, n in c.items() if docs[k][g] >= language_id.MIN_DOCS or k in few} for k, c in total.items()}
    most = Counter()
    for c in share.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    member = {k: {g for g, x in c.items() if x >= language_id.SHARE * most[g]} for k, c in share.items()}
    assert max(map(len, member.values())) <= language_id.TOP and sorted(member) == filters.languages
    agree = 0
    for r in rows:
        g = grams(r.text or "")
        hits = [sum(x in member[k] for x in g) for k in filters.languages]
        got = np.zeros(len(hits), int)
        for h in language_id.ngrams(r.text or ""):
            for masks in filters.masks(h):
                got += [int(np.count_nonzero(masks & masks.dtype.type(1 << k))) for k in range(len(hits))]
        assert (got >= hits).all()
        agree += not max(hits, default=0) or filters.decide(r.text or "")[0] == filters.languages[int(np.argmax(hits))]
    assert agree >= 0.99 * len(rows)


def plain_statistics(t):
    """All statistics of a text by loops."""
    import re
    import unicodedata

    words, lines, kinds = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n"), [unicodedata.category(c) for c in t]
    letters, w, n = sum(k[0] == "L" for k in kinds), max(1, len(words)), max(1, len(t))
    return {
        "chars": len(t), "words": len(words), "word_length": letters / w, "letters": letters / n, "upper": kinds.count("Lu") / max(1, letters), "digits": sum(c in "0123456789" for c in t) / n,
        "symbols": sum(c in "#$%&*+/<=>@\\^_`{|}~[]" for c in t) / n, "calls": t.count("!") / w, "stops": t.count(".") / w, "commas": t.count(",") / w,
        "distinct_words": len(set(re.split(r"[\x20\x09-\x0D]+", t.strip(" ")))) / w, "distinct_lines": len(set(lines)) / len(lines), "line_words": len(words) / len(lines),
    }


def test_statistics_against_plain_python(spark):
    texts = ["", " ", "One two.\nTHREE, four! five 55", "a,b,c\n\na,b,c", "  #$ %&  ÉÜ é\t\tx. a_b [c] {d} ~ \\ ^|`<=>@*+/", "x" * 50_000 + " y", "a b a b \x0bb"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.asDict() for r in table.select("k", *[c.alias(f) for f, c in quality.statistics(F.col("t")).items()]).collect()}
    for k, t in enumerate(texts):
        assert {f: v for f, v in got[k].items() if f != "k"} == pytest.approx(plain_statistics(t)), t[:30]


def test_quality_query_against_plain_rules(spark, data):
    """Every document's score by loops over the learned rules and statistics of its text; labels of held-out rows teach nothing."""
    import math
    import zlib

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows = labels.collect()
    kept = spark.createDataFrame([r for r in rows if not held(r.doc_id)], labels.schema)
    model = quality.train(docs, kept)
    assert model.rules and len(rows) > kept.count()
    want = {}
    for d in docs.collect():
        x = plain_statistics(d.text or "")
        holds = [all(x[f] > t if above else x[f] <= t for f, above, t in rule.conditions) for rule in model.rules]
        z = model.intercept + sum(w for w, h in zip(model.weights, holds, strict=True) if h)
        want[d.doc_id] = (held(d.doc_id), pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12), int(z >= 0))
    got = quality.op1_quality(spark, data).collect()
    assert {r.doc_id: (r.held_out, r.score, r.predicted) for r in got} == want and len(got) == len(want)
