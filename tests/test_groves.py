"""Grove queries over all components, against plain loops without Spark and without shared trees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sylvan.functions.scalars import alpha_steps, alpha_value
from sylvan.operators import features, grid, kernel, predict, sampling, wide_grove
from sylvan.plans.catalogue import QUERIES
from sylvan.sources import tables

WIDTH = 64


@pytest.fixture(scope="module")
def table():
    r = np.random.default_rng(7)
    x = r.integers(0, 6, (60, WIDTH)).astype(float)
    return x, np.where(x[:, 40] > 2, 1.0, -1.0) * np.where(x[:, 63] > 2, 4.0, -4.0) + 3 * x[:, 63], np.arange(60)


def plain_grove(x, y, bag, attrs, alpha, trees, barred=()):
    single, grown = [np.zeros(len(y))] * trees, [None] * trees
    steps, one = alpha_steps(alpha, len(y)), np.ones(len(y))
    for k in range(steps):
        a = alpha_value(k) if k < steps - 1 else alpha
        drawn = kernel.draw(1, bag, k, len(y))
        out = np.setdiff1d(np.arange(len(y)), drawn)
        errors = lambda: [kernel.rmse(sum(single)[i], y[i], one[i]) for i in (drawn, out)]
        seen = [errors()]
        while True:
            for j in [trees - 1, *range(trees - 1)]:
                left = y - (sum(single) - single[j])
                tried = [kernel.grow_tree(x[drawn], one[drawn], left[drawn], a, len(y), c) for c in ([[f for f in attrs if f != b] for b in barred] or [attrs])]
                grown[j] = min(tried, key=lambda t: kernel.rmse(t.predict(x[out]), left[out], one[out]))
                single[j] = grown[j].predict(x)
            seen.append(errors())
            k = 0 if seen[-1][0] else 1
            if seen[-1][k] == 0 or seen[-2][k] - seen[-1][k] <= kernel.GAIN * seen[-2][k]:
                break
    return grown


def plain_preds(table, bags, attrs, alpha, trees, barred=()):
    x, y, key = table
    train, valid = key % 5 != 0, key % 5 == 0
    groves = [plain_grove(x[train], y[train], b, attrs, alpha, trees, barred) for b in bags]
    return np.mean([sum(t.predict(x[valid]) for t in g) for g in groves], axis=0), y[valid], key[valid]


def plain_error(*args):
    pred, y, _ = plain_preds(*args)
    return kernel.rmse(pred, y, np.ones(len(y)))


def test_queries_take_all_components(spark, data, monkeypatch):
    taken = {}

    class Done(Exception):
        pass

    def take(name):
        def run(*args, **more):
            taken[name] = args, more
            raise Done

        return run

    for name, module, operator in (("backward_elimination", features, "backward_elimination"), ("interaction_scan", features, "interaction_scan"), ("grove_grid", grid, "train_grid"), ("grove_layered_preds", kernel, "per_bag")):
        monkeypatch.setattr(module, operator, take(name))
        with pytest.raises(Done):
            QUERIES[name](spark, data)
        args, more = taken[name]
        every = [f"e{k}" for k in range(64)]
        assert every in args and set(every) <= set(args[0].columns)
        assert not {"bags", "repeats"} & set(more) and (name == "grove_layered_preds" or len(args) == 4)  # the operator's own


def test_elimination_against_plain_loops(spark, table):
    x, y, key = table
    names, small = [f"e{k}" for k in range(6)], (x[:, 43::4], y, key)
    pdf = pd.DataFrame({"key": key, "y": y, "w": 1.0, "set": np.where(key % 5 == 0, "valid", "train")} | {n: small[0][:, k] for k, n in enumerate(names)})
    rows = features.backward_elimination(spark.createDataFrame(pdf), names, 0.2, 2, 2, 2).collect()
    active, measured, again = list(range(6)), {}, True
    while again:
        again, left, at = False, 0, len(active) - 1
        e = [plain_error(small, range(2 * k, 2 * k + 2), active, 0.2, 2) for k in range(2)]
        mean, std = np.mean(e), np.std(e)
        while left < len(active) and len(active) > 1:
            if active[at] not in measured:
                measured[active[at]] = plain_error(small, range(2), [a for a in active if a != active[at]], 0.2, 2)
            error = measured[active[at]]
            left += 1
            if error <= mean + 3 * std:
                del active[at]
                measured, again, left = {}, True, 0
                if error <= mean - 3 * std and std > 0:
                    break
            at = (at - 1) % len(active)
    kept = {names[a]: measured.get(a) for a in active}
    assert all(r.perf == pytest.approx(kept[r.attr]) and r.importance == pytest.approx(kept[r.attr] - mean) for r in rows if r.kept and kept[r.attr] is not None)
    assert [r.attr for r in rows if r.kept] == [names[a] for a in active]


def test_scan_of_all_pairs_and_a_triple(spark, table):
    x, y, key = table
    pdf = pd.DataFrame({"key": key, "y": y, "w": 1.0, "set": np.where(key % 5 == 0, "valid", "train")} | {f"e{k}": x[:, 40 + 4 * k] for k in range(6)})
    names, small = [f"e{k}" for k in range(6)], (x[:, 40::4], y, key)
    for sets in ([(a, b) for a in range(6) for b in range(a + 1, 6)], [(0, 3, 5), (1, 2)]):
        got = features.interaction_scan(spark.createDataFrame(pdf), names, 0.2, 2, 2, 2, sets=[tuple(names[i] for i in s) for s in sets]).collect()
        want = [plain_error(small, range(2), list(range(6)), 0.2, 2, s) for s in sets]
        assert [r.perf for r in got] == pytest.approx(want)


def test_roc_metric(spark, table):
    x, y, key = table
    label = (y > 0).astype(float)
    pdf = pd.DataFrame({"key": key, "y": label, "w": 1.0, "set": np.where(key % 5 == 0, "valid", "train")} | {f"e{k}": x[:, 40 + 23 * k] for k in range(2)})
    got = features.grove_errors(spark.createDataFrame(pdf), ["e0", "e1"], ["e0", "e1"], 0.2, 2, 2, 1, metric="roc")
    pred, truth, _ = plain_preds((x[:, [40, 63]], label, key), range(2), [0, 1], 0.2, 2)
    above = [(a > b) + (a == b) / 2 for a in pred[truth == 1] for b in pred[truth == 0]]
    assert got == [pytest.approx(np.mean(above))]
    kept = features.backward_elimination(spark.createDataFrame(pdf), ["e0", "e1"], 0.2, 1, 2, 2, metric="roc").collect()
    assert len(kept) == 2 and any(r.kept for r in kept)
    scan = features.interaction_scan(spark.createDataFrame(pdf), ["e0", "e1"], 0.2, 2, 2, 2, metric="roc", known=(0.9, 0.01)).first()
    assert scan.z == pytest.approx((0.9 - scan.perf) / 0.01)


def test_a_draw_leaves_a_row_out():
    for n in (2, 3):
        assert all(len(set(kernel.draw(1, bag, 0, n).tolist())) < n for bag in range(200))
    assert kernel.draw(1, 0, 0, 1).tolist() == [0]


def test_wide_groves_are_the_kernels(spark):
    """Level by level over tables, or bag by bag in memory: the same groves, over two steps of alpha and with missing values."""
    r = np.random.default_rng(2)
    n, alpha = 24, 0.2
    x = r.integers(0, 2, (n, 2)).astype(float)
    y = (4 * x[:, 0] - 2 * x[:, 1] * x[:, 0] + r.integers(0, 2, n)).astype(float)
    pdf = pd.DataFrame({"key": np.arange(n), "y": y, "w": 1.0 + np.arange(n) % 2, "a": x[:, 0], "b": x[:, 1]})
    pdf.loc[pdf["key"] % 7 == 3, "a"] = np.nan
    rows = tables.nan_to_null(spark.createDataFrame(pdf))
    wide = wide_grove.layered_nodes(rows, "key", ["a", "b"], alpha, 2, 2)
    own = features.layered_nodes(rows.withColumn("set", F.lit("train")), ["a", "b"], ["a", "b"], alpha, 2, 2)
    table = rows.withColumnRenamed("key", "row_no")
    got, want = ({(q.row_no, q.bag, q.tree): q.pred for q in predict.tree_predictions(table, nodes, ["a", "b"]).collect()} for nodes in (wide, own))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_draws_of_both_engines(spark):
    for n, step in ((3, 0), (50, 4)):
        got = sampling.bootstrap_draws(spark, n, 40, 2, step).orderBy("bag", "draw").collect()
        assert [q.row_no for q in got] == [int(i) for bag in range(40) for i in kernel.draw(2, bag, step, n)]


SMALL = ["a", "b"]


@pytest.fixture(scope="module")
def small(spark):
    """Rows of two features of two values, with missing ones, train and valid, as a table and as arrays; targets with noise, so that no two ways are equally good."""
    r = np.random.default_rng(5)
    n = 20
    x = r.integers(0, 2, (n, 2)).astype(float)
    y = (4 * x[:, 0] - 3 * x[:, 1] * x[:, 0] + r.integers(0, 4, n)).astype(float)
    pdf = pd.DataFrame({"key": np.arange(n), "y": y, "w": 1.0 + np.arange(n) % 2, "set": np.where(np.arange(n) % 4 == 1, "valid", "train"), "a": x[:, 0], "b": x[:, 1]})
    pdf.loc[pdf["key"] % 9 == 3, "a"] = np.nan
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield tables.nan_to_null(spark.createDataFrame(pdf)).coalesce(1).cache(), pdf
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def plain_grid(pdf, alpha, trees, bags, mode):
    """{(bag, t, a): (from below, predictions of valid rows)} by loops over cells, ways and trees."""
    from sylvan.functions.scalars import tree_count, tree_count_steps

    train, valid = pdf[pdf["set"] == "train"], pdf[pdf["set"] == "valid"]
    x, y, w = train[SMALL].to_numpy(float), train["y"].to_numpy(), train["w"].to_numpy()
    n, out, turns = len(y), {}, {}
    for bag in range(bags):
        cells = {}
        for a in range(alpha_steps(alpha, n)):
            share = alpha_value(a) if a < alpha_steps(alpha, n) - 1 else alpha
            for t in range(tree_count_steps(trees)):
                ways = [up for up, there in ((False, a > 0), (True, t > 0)) if there] or [False]
                if mode == "layered":
                    ways = [False]
                if mode == "fast" and bag and len(ways) == 2:
                    ways = [turns[t, a]]
                tried = []
                for up in ways:
                    before = cells.get((t - 1, a) if up else (t, a - 1))
                    single = [s.copy() for s in before[0]] if before else []
                    single += [np.zeros(n) for _ in range(tree_count(t) - len(single))]
                    grown = list(before[1]) if before else []
                    grown += [None] * (tree_count(t) - len(grown))
                    drawn = kernel.draw(1, bag, 1000 * a + t, n)
                    left_out = np.setdiff1d(np.arange(n), drawn)
                    errors = lambda s, i: kernel.rmse(sum(s)[i], y[i], w[i])
                    seen = [(errors(single, drawn), errors(single, left_out))]
                    while True:
                        for k in [len(single) - 1, *range(len(single) - 1)]:
                            rest = y - (sum(single) - single[k])
                            grown[k] = kernel.grow_tree(x[drawn], w[drawn], rest[drawn], share, n, [0, 1])
                            single[k] = grown[k].predict(x)
                        seen.append((errors(single, drawn), errors(single, left_out)))
                        which = 0 if seen[-1][0] else 1
                        if seen[-1][which] == 0 or seen[-2][which] - seen[-1][which] <= 0.002 * seen[-2][which]:
                            break
                    tried.append((*seen[-1], up, single, grown))
                best = min(tried, key=lambda r: r[:3])
                cells[t, a] = best[3:]
                turns.setdefault((t, a), best[2])
                out[bag, t, a] = best[2], sum(g.predict(valid[SMALL].to_numpy(float)) for g in best[4])
    return out, valid["key"].tolist()


def cells_of(run):
    out = {}
    for r in run.cells.orderBy("key").collect():
        out.setdefault((r.bag, r.tig_no, r.alpha_no), (r.from_below, []))[1].append(r.pred)
    return out


@pytest.mark.parametrize(("mode", "bags"), [("slow", 1), ("fast", 2)])
def test_grids_of_both_engines_and_plain_loops(small, mode, bags):
    """Ways, choices and predictions of all cells: bag by bag in memory, on tables, and by loops; and the table engine goes on from a smaller grid."""
    rows, pdf = small
    want, keys = plain_grid(pdf, 0.2, 2, bags, mode)
    for run in (grid.train_grid(rows, SMALL, 0.2, 2, bags, mode), wide_grove.train_grid(rows, SMALL, 0.2, 2, bags, mode)):
        got = cells_of(run)
        assert got.keys() == want.keys() and all(len(p) == len(keys) for _, p in got.values())
        for cell, (below, pred) in want.items():
            assert got[cell][0] == below and np.allclose(got[cell][1], pred, atol=1e-8), cell
        valid = rows.filter("set = 'valid'").withColumnRenamed("key", "row_no")
        nodes = run.nodes.filter("tig_no = 1 AND alpha_no = 1")
        pred = {(r.bag, r.row_no): r.pred for r in predict.tree_predictions(valid, nodes, SMALL).groupBy("bag", "row_no").agg(F.sum("pred").alias("pred")).collect()}
        assert all(pred[b, k] == pytest.approx(p) for b in range(bags) for k, p in zip(keys, want[b, 1, 1][1], strict=True))


def test_wide_grids_go_on(small):
    rows, pdf = small
    part = wide_grove.train_grid(rows, SMALL, 0.5, 1, 1, "slow")
    grown = grid.expand_grid(part, rows, SMALL, 0.5, 2, 2, train=wide_grove.train_grid)
    want, _ = plain_grid(pdf, 0.5, 2, 2, "slow")
    got = cells_of(grown)
    assert got.keys() == want.keys()
    for cell, (below, pred) in want.items():
        assert got[cell][0] == below and np.allclose(got[cell][1], pred, atol=1e-8), cell


def test_restrictions_and_removals_as_keys(small):
    """All sets, and all candidates for removal, in one growth each: the kernel's errors one by one."""
    rows, _ = small
    sets = [("a", "b"), ("b",)]
    assert wide_grove.restricted_errors(rows, SMALL, sets, 0.5, 2, 2) == pytest.approx(features.restricted_errors(rows, SMALL, sets, 0.5, 2, 2))
    want = {a: features.grove_errors(rows, SMALL, [b for b in SMALL if b != a], 0.5, 1, 2, 1)[0] for a in SMALL}
    assert wide_grove.removal_errors(rows, SMALL, SMALL, 0.5, 1, 2) == pytest.approx(want)
