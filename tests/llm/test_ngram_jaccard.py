import random

import pytest

from sylvan.llm import ngram_jaccard as J


def rows(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["The", "of"] * 5
    out = []
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 5, 30, 60, 120]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
            out.append((len(out), r.choice([" ", "\n", " \t"]).join(t).replace("w1", r.choice(["w1", "W1"]))))
    return out + [(len(out), None), (len(out) + 1, " \n")]


@pytest.mark.parametrize(("seed", "block"), [(1, J.BLOCK), (2, 200)])
def test_against_brute_force(spark, seed, block):
    data = rows(seed)
    docs = spark.createDataFrame([(i, t, i) for i, t in data], "doc_id long, text string, n long")
    got = J.similar_groups(docs, block=block).collect()
    assert sorted(tuple(r) for r in got) == sorted(J.brute_force(data))
    assert len({r[2] for r in got}) < len(data) - 10


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = " ".join(f"x{i}" for i in range(50))
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (None, "solo")], "doc_id long, text string")
    assert sorted(J.similar_groups(docs).collect(), key=str) == sorted([(5, 48, 5), (5, 48, 5), (None, 48, 5), (None, 1, None)], key=str)
    assert J.similar_groups(docs.limit(0)).count() == 0


def test_buckets_are_split_again(spark, monkeypatch):
    """Few coarse buckets of many elements: each is split where it lies."""
    monkeypatch.setattr(J, "BUCKET", 300)
    monkeypatch.setattr(J, "COARSE", 3)
    data = rows(5, 80)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(tuple(r) for r in J.similar_groups(docs).collect()) == sorted(J.brute_force(data))


def chained(n):
    """One candidate group: neighbours share a few rare words, and a cluster of near copies hangs on it."""
    r = random.Random(9)
    word = lambda k: [f"p{k}_{i}" for i in range(12)]
    out = [(k, " ".join(word(k) + word(k + 1))) for k in range(n)]
    base = word(3) + [f"c{i}" for i in range(60)]
    for k in range(n, 2 * n):
        t = list(base)
        t[r.randrange(len(t))] = f"q{r.randrange(9)}"
        out.append((k, " ".join(t)))
    return out


@pytest.mark.parametrize("block", [60, 400])
def test_one_giant_group(spark, block):
    """Units by prefix element, bands and pairs of blocks give what all pairs give."""
    data = chained(50)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(tuple(r) for r in J.similar_groups(docs, 1, 60, block=block).collect()) == sorted(J.brute_force(data, 1, 60))


def test_large_group_is_not_all_pairs(spark):
    """Rows of cells grow with the group where elements are rare, not with its square."""
    made = []
    for n in (200, 400):
        members = spark.range(n).selectExpr("id AS node", "50 AS n", "array(id, id + 1) AS prefix", "0 AS component", f"{50 * n} AS total")
        made.append(J._cells(members, 90, 500).count())
    assert made[1] < 2.2 * made[0]


def test_positions_skip_no_link():
    """A cell's answers are those of all pairs, for sets whose prefixes are in one order of rarity."""
    import numpy as np

    r = np.random.default_rng(4)
    base = [r.choice(4000, 60, replace=False) for _ in range(8)]
    sets = [np.unique(np.concatenate((b[r.random(60) > 0.05], r.choice(4000, 3)))).astype(np.uint64) for b in base for _ in range(12)]
    elements, times = np.unique(np.concatenate(sets), return_counts=True)
    rank = {int(e): (int(t), int(e)) for e, t in zip(elements, times, strict=True)}
    prefixes, before = [], []
    for s in sets:
        order = sorted(s.tolist(), key=rank.__getitem__)[: J._prefix(len(s), 80)]
        own = sum(rank[e][0] == 1 for e in order)
        prefixes.append(np.array(order[own:], np.uint64))
        before.append(own)
    keep = [k for k in range(len(sets)) if len(prefixes[k])]
    cell = J.Cell(np.array(keep), np.zeros(len(keep), int), [sets[k] for k in keep], [prefixes[k] for k in keep], np.array([before[k] for k in keep]), 80)
    got = dict(zip(cell.nodes.tolist(), cell.link().tolist(), strict=True))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert all(got[k] == find(k) for k in keep) and len({find(k) for k in keep}) < len(keep)


def test_very_long_texts_and_clashing_columns(spark):
    words = [f"w{k * 7919 % 100_003}" for k in range(200_000)]
    near, far = list(words), list(words)
    near[::4001] = ["x"] * len(near[::4001])
    far[::20] = ["y"] * len(far[::20])
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, 0, "e") for i, t in rows], "doc_id long, text string, n long, element string")
    got = {r.doc_id: r.component_id for r in J.similar_groups(docs).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 5: 5, 6: 6}
