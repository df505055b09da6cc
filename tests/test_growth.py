"""Steps whose work or memory a task or the driver once held whole."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvan.operators import features, kernel, predict, sampling, tree
from sylvan.plans.catalogue import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_subsample_ranks_one_range_of_hashes(spark):
    rows = spark.range(400).select(F.col("id").alias("key"))
    for n in (0, 1, 37, 400, 500):
        got = sampling.subsample(rows, "key", n, bags=2)
        every = rows.crossJoin(spark.range(2).select(F.col("id").alias("bag"))).withColumn("h", sampling.hash_number(F.lit("1"), F.col("bag").cast("string"), F.col("key").cast("string"))).toPandas()
        want = every.sort_values(["h", "key"]).groupby("bag").head(n)
        assert sorted((r.bag, r.key) for r in got.collect()) == sorted(zip(want["bag"], want["key"], strict=True))
    assert "_at" in plan(got) and "salt" not in plan(got)  # only rows of the range that holds the n-th are ranked


def test_top_features_of_marked_tables(spark):
    scores = spark.createDataFrame([(str(k), float(k * 37 % 50)) for k in range(300)], "attr string, score double")
    marked = [str(k) for k in range(0, 300, 7)]
    want = {s: sorted(map(tuple, features.top_features(scores, 20, marked, s).collect())) for s in (None, 12)}
    order = sorted(((-float(k * 37 % 50), str(k)) for k in range(300)))
    place = {a: i + 1 for i, (_, a) in enumerate(order)}
    first = sorted(marked, key=place.get)
    for s, rows in want.items():
        got = features.top_features(scores, 20, scores.filter(F.col("attr").cast("int") % 7 == 0), s)
        assert sorted(map(tuple, got.collect())) == rows and "Window" not in plan(got)
        kept = {a for a in place if place[a] <= 20} | set(first[:s])
        assert sorted((a, -order[place[a] - 1][0], place[a]) for a in kept) == rows


def test_recursive_walk_joins_nodes_alone(spark):
    rows = spark.createDataFrame([(k, float(k % 5), 1.0, None if k % 7 == 3 else float(k % 4), float(k % 3)) for k in range(60)], "row_no long, y double, w double, a double, b double")
    items = rows.select(F.lit(0).cast("long").alias("bag"), "row_no", F.col("w").alias("coef"), F.col("y").alias("resp"))
    nodes = tree.grow(rows, items, ["a", "b"], max_depth=3)
    got = {r.row_no: r.pred for r in predict.recursive_walk(rows, nodes, ["a", "b"]).collect()}
    want = {r.row_no: r.pred for r in predict.tree_predictions(rows, nodes, ["a", "b"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("name", ["grove_bag_errors", "grove_stump_sweeps", "grove_sweep_errors"])
def test_back_fitting_gives_no_task_the_table(spark, data, name, monkeypatch):
    def refused(*args, **more):
        raise AssertionError("a bag's table in one task")

    monkeypatch.setattr(kernel, "per_bag", refused)
    assert QUERIES[name](spark, data) is not None


def test_blocks_are_narrow_where_that_loses_nothing():
    for values, kind in (([0.5, np.nan, 0.25], np.float32), ([0.1, np.nan, 0.25], np.float64)):
        batch = pa.RecordBatch.from_arrays([pa.array([3, 1, 2]), pa.array([1.0, 2.0, 3.0]), pa.array([1.0] * 3), pa.array([True] * 3), pa.array(values)], ["key", "y", "w", "own", "x0"])
        blocks = [tuple(c[0].as_py() for c in b.columns) for b in kernel._packed(1)(iter([batch]))]
        key, y, _, _, x = kernel._gathered(blocks, 1)
        assert x.dtype == kind and key.tolist() == [1, 2, 3] and y.tolist() == [2.0, 3.0, 1.0]
        assert np.array_equal(x[0].astype(float), [values[1], values[2], values[0]], equal_nan=True)


def test_borders_between_narrow_neighbours():
    a = np.float32(1.0)
    v = np.array([a, np.nextafter(a, np.float32(2))], np.float32)
    t = kernel.grow_tree(v[:, None], np.ones(2), np.array([0.0, 1.0]), 0.0, 2, [0])
    assert float(v[0]) < t.border[0] < float(v[1]) and t.predict(v[:, None]).tolist() == [0.0, 1.0]


def made(n=90, width=8):
    r = np.random.default_rng(3)
    x = r.integers(0, 9, (n, width)).astype(float)
    return x, np.where(x[:, 1] > 4, 6.0, 0.0) + x[:, 5] + r.integers(0, 2, n)


def test_sets_share_the_groves_they_have_in_common():
    x, y = made()
    data = kernel.BagData(x, y, np.ones(len(y)), 0, 1, list(range(8)), set())
    sets = [(a, b) for a in range(8) for b in range(a + 1, 8)] + [(0, 1, 5), (5, 1), (3,), (5,)]
    found, pred = 0, {}
    for own, trees in kernel.restricted(data, 0.2, 2, sets):
        found += 1
        pred |= {s: np.sum([t.predict(x) for t in trees], axis=0) for s in own}
    assert sorted(pred) == list(range(len(sets))) and found < len(sets)
    for k, s in enumerate(sets):
        want = kernel.layered(data, 0.2, 2, s)
        assert np.allclose(pred[k], np.sum([t.predict(x) for t in want.trees], axis=0), atol=1e-12)


def test_elimination_grows_only_groves_that_change(spark, monkeypatch):
    x, y = made()
    names = [f"e{k}" for k in range(8)]  # all constant but one
    rows = spark.createDataFrame(pd.DataFrame({"key": np.arange(len(y)), "y": y, "w": 1.0, "set": np.where(np.arange(len(y)) % 5 == 0, "valid", "train")} | {n: x[:, k] * (k == 1) for k, n in enumerate(names)}))
    grown = []
    plain = kernel.per_bag
    monkeypatch.setattr(kernel, "per_bag", lambda train, bags, *args, **more: (grown.append(bags), plain(train, bags, *args, **more))[1])
    kept = features.backward_elimination(rows, names, 0.2, 1, 2, 2).filter("kept").collect()
    assert [r.attr for r in kept] == ["e1"]
    assert sum(map(len, grown)) <= 2 * 2 + 2  # the first ensembles, and one without e1
