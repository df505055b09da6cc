import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.operators import effects, ensemble, features, grid, kernel, metrics, predict, prefix, sampling, tree
from sylvan.sources import sinks
from sylvan.sources.tables import long_form

FEATURES = ["a", "b", "c"]


def table(spark, n=60, missing=False, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = float(r.randrange(8)), float(r.randrange(5)), float(r.randrange(2))
        y = float(2 * a - 3 * b * c + r.randrange(3))
        gone = lambda v: None if missing and r.random() < 0.2 else v
        rows.append((i, y, float(1 + i % 3), gone(a), gone(b), gone(c)))
    return spark.createDataFrame(rows, "row_no long, y double, w double, a double, b double, c double")


def whole(rows):
    return rows.select(F.lit(0).cast("long").alias("bag"), "row_no", F.col("w").alias("coef"), F.col("y").alias("resp"))


@pytest.mark.parametrize(("missing", "alpha"), [(False, 0.0), (True, 0.0), (False, 0.2)])
def test_kernel_and_level_wise_trees_agree(spark, missing, alpha):
    rows = table(spark, missing=missing)
    nodes = tree.grow(rows, whole(rows), FEATURES, alpha, ["c"], 4).cache()
    pdf = rows.orderBy("row_no").toPandas()
    x = pdf[FEATURES].to_numpy(float)
    t = kernel.grow_tree(x, pdf["w"].to_numpy(), pdf["y"].to_numpy(), alpha, len(pdf), [0, 1, 2], {2}, 4)
    got = predict.tree_predictions(rows, nodes, FEATURES).orderBy("row_no").toPandas()["pred"].to_numpy()
    assert np.allclose(got, t.predict(x), atol=1e-7)
    table_walk = predict.walked_predictions(rows, nodes, FEATURES).orderBy("row_no").toPandas()["pred"].to_numpy()
    assert np.allclose(table_walk, got, atol=1e-9)
    case = rows.select("row_no", predict.ensemble_expression(nodes).alias("p")).orderBy("row_no").toPandas()["p"].to_numpy()
    assert np.allclose(case, got, atol=1e-9)
    walked = predict.recursive_predictions(spark, long_form(rows, ["row_no"], FEATURES), nodes).orderBy("row_no").toPandas()["pred"].to_numpy()
    assert np.allclose(walked, got, atol=1e-9)
    leaves = nodes.filter("attr IS NULL").agg(F.sum("v")).first()[0]
    assert leaves == pytest.approx(pdf["w"].sum())  # routing loses nothing


def test_full_tree_and_shift(spark):
    rows = table(spark, 30)
    distinct = rows.dropDuplicates(FEATURES)
    nodes = tree.grow(distinct, whole(distinct), FEATURES, 0.0, ["c"])
    met = predict.tree_predictions(distinct, nodes, FEATURES).join(distinct, "row_no")
    assert met.filter(F.abs(F.col("pred") - F.col("y")) > 1e-9).isEmpty()
    moved = distinct.withColumn("y", F.col("y") + 10)
    shifted = predict.tree_predictions(moved, tree.grow(moved, whole(moved), FEATURES, 0.0, ["c"]), FEATURES)
    assert shifted.join(met.select("row_no", F.col("pred").alias("p")), "row_no").filter(F.abs(F.col("pred") - F.col("p") - 10) > 1e-9).isEmpty()


def test_trees_beyond_61_levels(spark):
    n = 64
    rows = spark.createDataFrame([(k, float(k), 4.0**k, 1.0) for k in range(n)], "row_no long, a double, y double, w double").coalesce(1).cache()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        leaves = tree.grow(rows, whole(rows), ["a"]).filter("attr IS NULL").select("node_id", "depth", "value").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.value for r in leaves) == [4.0**k for k in range(n)]
    assert max(r.depth for r in leaves) == n - 1 and len({r.node_id for r in leaves}) == n


def test_ids_of_deep_kernel_trees():
    x, y = np.arange(200.0)[:, None], 4.0 ** np.arange(200)
    t = kernel.grow_tree(x, np.ones(200), y, 0.0, 200, [0])
    ids = [r[4] for r in grid.tree_rows(0, 0, 0, kernel_grove(t), ["a"])]
    assert len(set(ids)) == 399 and max(map(len, ids)) == 200
    assert all(i == "1" or i[:-1] in set(ids) for i in ids)


def kernel_grove(t):
    g = kernel.Grove.__new__(kernel.Grove)
    g.trees = [t]
    return g


def test_model_file_and_code(spark, tmp_path):
    rows = table(spark, missing=True)
    nodes = tree.grow(rows, whole(rows), FEATURES, 0.0, ["c"], 3).withColumn("tree", F.lit(0))
    predict.write_model(nodes, str(tmp_path / "m"), 0.01, 1, 1, [True, False], FEATURES)
    header, back = predict.read_model(spark, str(tmp_path / "m"), FEATURES)
    assert header == {"mode": 1, "directions": [True, False], "trees": 1, "alpha": 0.01}
    key = ["node_id", "attr", "border", "missing_l", "value"]
    assert sorted(map(str, back.select(key).collect())) == sorted(map(str, nodes.select(key).collect()))
    code = {}
    exec(predict.tree_code([r.asDict() for r in tree.grow(table(spark), whole(table(spark)), FEATURES, 0.0, ["c"], 2).collect()]), code)
    assert isinstance(code["predict"]({"a": 1.0, "b": 2.0, "c": 0.0}), float)
    exec(predict.tree_code([r.asDict() for r in nodes.collect()], "gone"), code)  # missing values go both ways
    known = {r["row_no"]: r["pred"] for r in predict.tree_predictions(rows, nodes, FEATURES).collect()}
    assert all(code["gone"](r.asDict()) == pytest.approx(known[r["row_no"]]) for r in rows.collect())


def test_bagging_and_scores(spark):
    nodes, rows = ensemble.bagged_trees(table(spark).withColumnRenamed("row_no", "key"), "key", FEATURES, 3, 0.2, booleans=["c"])
    scores = ensemble.feature_scores(nodes, rows.agg(F.sum("w")).first()[0]).collect()
    assert {r.attr for r in scores} <= set(FEATURES) and all(r.score > 0 for r in scores)
    draws = sampling.bootstrap_draws(spark, 60, 3)
    out = sampling.out_of_bag(rows.select("row_no"), draws, 3)
    assert sampling.in_bag(draws).count() + out.count() == 180
    few = sampling.bootstrap_draws(spark, 2, 60)
    assert sampling.out_of_bag(spark.range(2).select(F.col("id").alias("row_no")), few, 60).select("bag").distinct().count() == 60
    assert sampling.subsample(rows, "row_no", 7, bags=2).groupBy("bag").count().collect()[0]["count"] == 7


def test_boosting_learns(spark):
    train = table(spark).withColumnRenamed("row_no", "key")
    nodes, preds = ensemble.boosted_trees(train, "key", FEATURES, 3, 0.5, booleans=["c"], max_depth=2)
    e = metrics.rmse(preds.join(train, "key")).first()[0]
    assert e < metrics.rmse(train.withColumn("pred", F.lit(0.0))).first()[0]
    curve = ensemble.boosting_curve(train.withColumnRenamed("key", "row_no"), nodes, FEATURES).orderBy("tree").collect()
    assert len(curve) == 3 and curve[-1].rmse < curve[0].rmse


def test_curves_and_recommendations():
    assert metrics.curve_needs_more([1.0] * 20) and not metrics.curve_needs_more([1.0] * 21)
    assert metrics.curve_needs_more([1.0 - 0.01 * k for k in range(30)])
    assert metrics.next_bags(60) == 90 and metrics.next_bags(90) == 140
    falling = [[10.0 - t - a for a in range(3)] for t in range(7)]
    assert metrics.interaction_cell(falling) == (6, 2, True)
    assert metrics.interaction_cell([[1.0, 2.0], [2.0, 3.0]]) == (1, 0, False)
    train = {"min_alpha": 0.1, "max_n": 2, "bags": 60, "mode": "fast", "rows": 1000}
    best = {"perf": 0.5, "alpha": 0.1, "n": 2, "tig_no": 1, "alpha_no": 1}
    flat = {(t, a): [1.0] * 40 for t in range(2) for a in range(2)}
    assert metrics.recommendation(best, flat, train) == {"action": "expand", "alpha": pytest.approx(0.01), "n": 3}
    assert metrics.recommendation(best | {"alpha": 0.5, "n": 1}, flat, train) == {"action": "save", "alpha": 0.5, "n": 1}
    assert metrics.worse_than_baseline(2, 1) and metrics.worse_than_baseline(0.4, 1, False)


def test_roc(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (1.0, 1.0, 1.0), (2.0, 1.0, 2.0), (0.0, 0.0, 1.0)], "pred double, y double, w double")
    assert metrics.roc_auc(df).first()[0] == pytest.approx((1 * 1 + 2 * 2 + 0.5) / 6)
    metrics.check_labels(df)
    with pytest.raises(metrics.RocError):
        metrics.check_labels(df.filter("y = 1"))
    with pytest.raises(metrics.RocError):
        metrics.check_labels(df.withColumn("y", F.lit(2.0)))


@pytest.fixture(scope="module")
def marked(spark):
    return table(spark, 80).withColumnRenamed("row_no", "key").withColumn("set", F.when(F.col("key") % 4 == 0, "valid").otherwise("train")).cache()


@pytest.mark.parametrize("mode", ["slow", "fast", "layered"])
def test_grid_modes(marked, mode):
    run = grid.train_grid(marked, FEATURES, 0.2, 2, 2, mode)
    cells = run.cells.select("tig_no", "alpha_no").distinct().collect()
    assert len(cells) == 2 * 2
    truth = marked.filter("set = 'valid'").select("key", "y", "w")
    assert grid.curves(run, truth).count() == 8
    best = metrics.best_cell(grid.surface(run, truth)).first()
    std = metrics.weighted_std(truth).first()[0]
    assert not metrics.worse_than_baseline(best.perf, std)
    assert metrics.direction_table(run.cells.select("bag", "tig_no", "alpha_no", "from_below").distinct()).count() == 4


def test_expand_merge_save(spark, marked, tmp_path):
    run = grid.train_grid(marked, FEATURES, 0.2, 1, 2, "layered")
    more = grid.expand_grid(run, marked, FEATURES, trees=2, bags=3)
    assert more.cells.select("bag", "tig_no", "alpha_no").distinct().count() == 3 * 2 * 2
    assert more.cells.count() == 3 * 2 * 2 * marked.filter("set = 'valid'").count()  # each cell once
    other = grid.train_grid(marked, FEATURES, 0.2, 1, 2, "layered", seed=2)
    both = grid.merge_runs([run, other])
    assert both.bags == 4 and both.cells.select("bag").distinct().count() == 4
    with pytest.raises(ValueError, match="seeds"):
        grid.merge_runs([run, run])
    nodes = grid.save_cell([run, other], 0, 0)
    preds = predict.grove_predictions(predict.tree_predictions(marked.filter("set = 'valid'").withColumnRenamed("key", "row_no"), nodes, FEATURES))
    want = both.cells.filter("tig_no = 0 AND alpha_no = 0").groupBy("key").agg(F.avg("pred").alias("p"))
    assert preds.join(want, preds["row_no"] == want["key"]).filter(F.abs(F.col("pred") - F.col("p")) > 1e-9).isEmpty()
    sinks.save_run(run, str(tmp_path / "run"))
    back = sinks.load_run(spark, str(tmp_path / "run"))
    assert (back.seed, back.bags, back.cells.count()) == (1, 2, run.cells.count())
    sinks.write_report(back.cells.select("key", "pred"), str(tmp_path / "preds"), ["key"])


@pytest.mark.parametrize("mode", ["slow", "fast", "layered"])
def test_expanding_trains_missing_cells_only(marked, mode, monkeypatch):
    """Grown in steps, a grid is that of one run, and no cell is trained twice."""
    whole_run = grid.train_grid(marked, FEATURES, 0.1, 3, 3, mode)
    part = grid.train_grid(marked, FEATURES, 0.2, 2, 2, mode)
    trained = []
    train = grid.train_grid
    monkeypatch.setattr(grid, "train_grid", lambda *a, **k: trained.append(train(*a, **k)) or trained[-1])
    grown = grid.expand_grid(part, marked, FEATURES, 0.1, 3, 3)
    cells = trained[0].cells.select("bag", "tig_no", "alpha_no").distinct()
    assert cells.count() == 3 * 3 * 3 - 2 * 2 * 2 and cells.join(part.cells, ["bag", "tig_no", "alpha_no"], "left_semi").isEmpty()
    key = ["bag", "tig_no", "alpha_no", "key"]
    both = grown.cells.join(whole_run.cells.select(*key, F.col("pred").alias("other"), F.col("from_below").alias("way")), key)
    assert both.count() == whole_run.cells.count() == grown.cells.count()
    assert both.filter((F.abs(F.col("pred") - F.col("other")) > 1e-9) | (F.col("from_below") != F.col("way"))).isEmpty()
    assert grown.nodes.count() == whole_run.nodes.count()


def test_prefix_sums(spark):
    """Against plain loops: any magnitude, null groups, no group, no rows."""
    r = random.Random(1)
    rows = []
    for g in (0, 1, None):
        values = {r.choice([r.gauss(0, 1), r.gauss(1e9, 1), -1e300 * r.random(), r.random() * 1e-310, float(r.randrange(50))]) for _ in range(200)}
        rows += [(g, v, r.randrange(10)) for v in values | {1.7e308, -1.7e308, 0.0, 5e-324}]
    df = spark.createDataFrame(rows, "g int, v double, n long")
    got = {(x.g, x.v): (x.n_before, x.n_all, x.last_v) for x in prefix.running(df, ["g"], "v", ["n"], ["v"]).collect()}
    for g in (0, 1, None):
        own, before, last = sorted((v, n) for k, v, n in rows if k == g), 0, None
        for v, n in own:
            assert got[g, v] == (before, sum(m for _, m in own), last)
            before, last = before + n, v
    one = df.filter("g = 0")
    assert {x.v: x.n_before for x in prefix.running(one, [], "v", ["n"]).collect()} == {v: b for (g, v), (b, _, _) in got.items() if g == 0}
    assert prefix.running(df.limit(0), ["g"], "v", ["n"], ["v"]).isEmpty() and prefix.running(df.limit(0), [], "v", ["n"]).isEmpty()


def test_one_class_and_no_weight(spark, tmp_path):
    """What has no meaning is null, not an error of division."""
    df = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("a", 2.0, 1.0, 1.0), ("b", 1.0, 0.0, 0.0), ("b", 2.0, 1.0, 0.0)], "g string, pred double, y double, w double")
    assert {r.g: r.auc for r in metrics.roc_auc(df, ["g"]).collect()} == {"a": None, "b": None}
    assert {r.g: r.rmse for r in metrics.rmse(df, ["g"]).collect()} == {"a": pytest.approx(0.5**0.5), "b": None}
    assert metrics.weighted_std(df.filter("w = 0")).first()[0] is None and metrics.roc_auc(df.limit(0)).first()[0] is None
    rows = table(spark, 12).withColumn("w", F.lit(0.0))
    assert tree.grow(rows, whole(rows), FEATURES).filter("value IS NULL").isEmpty()
    sinks.write_distribution(spark, 1.5, 0.25, str(tmp_path / "d"))
    assert sinks.read_distribution(spark, str(tmp_path / "d")) == (1.5, 0.25)
    sinks.write_performance(spark.createDataFrame([(1, 2.0), (0, 3.0)], "bag int, rmse double"), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).collect()[0][0] == "3.0"


def test_analysis(spark, marked):
    keep = features.backward_elimination(marked, FEATURES, 0.2, 1, 2, 2)
    assert keep.count() == 3 and keep.filter("kept").count() >= 1
    scan = features.interaction_scan(marked, FEATURES, 0.2, 1, 2, 2).collect()
    assert {r.attrs for r in scan} == {"a*b", "a*c", "b*c"}
    assert features.interaction_scan(marked, FEATURES, 0.2, 1, 1, 2, sets=[("a", "b", "c")]).count() == 1
    rho = features.spearman(marked, "key", FEATURES)
    assert features.correlation_list(rho).count() == 3 and features.correlation_matrix(rho).count() == 3
    assert all(abs(r.rho) <= 1 for r in features.spearman(marked, "key", FEATURES, exact=True).collect())


def test_effects(spark, marked):
    rows = marked.withColumnRenamed("key", "row_no")
    nodes = tree.grow(rows, whole(rows), FEATURES, 0.0, ["c"], 2)
    score = predict.ensemble_expression(nodes)
    p, q = effects.quantile_points(marked, "a", 5), effects.quantile_points(marked, "b", 3)
    assert effects.effect(p, "a", FEATURES, score).filter("pred IS NULL").isEmpty()
    joint = effects.joint_effect(p, q, "a", "b", FEATURES, score, effects.read_fixed("c 1\n"))
    assert joint.count() == p.count() * q.count() and effects.effect_matrix(joint).count() == p.count()
    dens = effects.density(marked, "a", "b", p, q)
    assert dens.agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert {r.mark for r in effects.density_markers(dens, 4).collect()} <= {"dense", "sparse", "even"}
    assert effects.quantile_points(marked.withColumn("k", F.lit(1.0)), "k", 3).collect()[0].n == 3
    assert effects.quantile_points(marked.limit(0), "a", 3).isEmpty()


def test_stream(spark, marked, tmp_path):
    from sylvan.streaming.scoring import score_stream, scored

    rows = marked.withColumnRenamed("key", "row_no")
    nodes = tree.grow(rows, whole(rows), FEATURES, 0.0, ["c"], 2).cache()
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, nodes, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("pred")).first()[0]
    assert math.isclose(got, scored(rows, nodes).agg(F.sum("pred")).first()[0])


def test_range_partitions_in_spite_of_outliers(spark, monkeypatch):
    """With an outlier at either end no task holds much more than its share; sums over parts are those of one window."""
    r = random.Random(8)
    values = {r.gauss(1e9, 1) for _ in range(40_000)} | {0.0, -1e300, 1e300, 1e9}
    df = spark.createDataFrame([("a" if k % 100 else "b", v, k % 7) for k, v in enumerate(values)], "g string, v double, n long").cache()
    sizes = [x["count"] for x in prefix.ranged(df, ["g"], "v", 16).groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    one = {(x.g, x.v): tuple(x) for x in prefix.running(df, ["g"], "v", ["n"], ["v", "n"]).collect()}
    monkeypatch.setattr(prefix, "SINGLE", 5000)
    assert {(x.g, x.v): tuple(x) for x in prefix.running(df, ["g"], "v", ["n"], ["v", "n"]).collect()} == one
    assert {x.v: x.n_before for x in prefix.running(df.drop("g"), [], "v", ["n"]).collect()} == {x.v: x.n_before for x in prefix.running(df.drop("g"), [], "v", ["n"], largest=1).collect()}


def chain(depth, bag=0):
    """Nodes of a tree in which every right child is split again."""
    rows, i = [], "1"
    for d in range(depth):
        rows += [(bag, 0, i, "ab"[d % 2], float(d) if d % 5 else None, 0.25, None), (bag, 0, i + "0", None, None, None, float(d + bag))]
        i += "1"
    return [*rows, (bag, 0, i, None, None, None, 99.0)]


NODES = "bag long, tree int, node_id string, attr string, border double, missing_l double, value double"


def test_models_are_columns_of_their_nodes_size(spark, tmp_path):
    """A chain of depth 40 and 60 of depth 30, on tables and streams; the column grows with the nodes."""
    from sylvan.streaming.scoring import score_stream

    text = lambda n: len(str(predict.ensemble_expression(spark.createDataFrame(chain(n), NODES))._jc.toString()))
    assert text(400) < 12 * text(40)
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else float(k % 45), None if k % 11 == 0 else float(k % 50)) for k in range(300)], "row_no long, a double, b double")
    deep = spark.createDataFrame(chain(40), NODES)
    full = spark.createDataFrame([n for bag in range(60) for n in chain(30, bag)], NODES)
    for nodes in (deep, full):
        want = {r.row_no: r.pred for r in predict.tree_predictions(rows, nodes, ["a", "b"]).groupBy("row_no").agg(F.avg("pred").alias("pred")).collect()}
        got = {r.row_no: r.pred for r in rows.select("row_no", predict.ensemble_expression(nodes).alias("pred")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    rows.write.parquet(str(tmp_path / "in"))
    score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), full, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.row_no: r.pred for r in spark.read.parquet(str(tmp_path / "out")).collect()} == pytest.approx(want)
    assert rows.limit(1).select(predict.ensemble_expression(spark.createDataFrame([], NODES)).alias("p")).first().p == 0


def written_bytes(df):
    import glob
    import os

    from sylvan.plans.storage import _paths

    return sum(os.path.getsize(f) for f in glob.glob(_paths[df].removeprefix("file://") + "/*.parquet"))


def test_a_level_writes_features_once(spark, monkeypatch):
    """Bytes a level grow with rows x (features + bags): more bags add the same whatever the number of features."""
    r = random.Random(2)
    wide = [f"f{k}" for k in range(12)]
    rows = spark.createDataFrame([(i, float(r.randrange(9)), *[r.random() for _ in wide]) for i in range(400)], ["row_no", "y", *wide]).coalesce(1).cache()

    def most(bags, features):
        sizes = []
        whole_stored = tree.stored
        monkeypatch.setattr(tree, "stored", lambda df: (lambda out: sizes.append(written_bytes(out)) or out)(whole_stored(df)))
        items = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bags - 1).cast("long"))).alias("bag"), "row_no", F.lit(1.0).alias("coef"), F.col("y").alias("resp"))
        tree.grow(rows, items, features, max_depth=2)
        monkeypatch.undo()
        return max(sizes)

    few = most(20, wide[:2]) - most(1, wide[:2])
    assert most(20, wide) - most(1, wide) < 2 * few + 20_000


def test_many_cuts_meet_their_items_in_a_join(spark):
    rows = table(spark, 60, missing=True)
    state = rows.select("row_no", *FEATURES, F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.col("w").alias("coef"), F.col("y").alias("resp"))).alias("items")).cache()
    key = ["bag", "node_id", "depth", "attr", "border"]
    few, many = (tree.grow_state(state, {0: 60}, FEATURES, 60, 0.05, ["c"], 3, cuts=n) for n in (100, 1))
    assert sorted(map(str, few.select(key).collect())) == sorted(map(str, many.select(key).collect())) and few.count() > 7
    total = lambda nodes: nodes.filter("attr IS NULL").agg(F.sum("v")).first()[0]
    assert total(few) == pytest.approx(total(many))


@pytest.mark.parametrize("block", [256, 3])
def test_rank_correlations_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(features, "BLOCK", block)
    r = np.random.default_rng(3)
    x = r.integers(0, 9, (70, 7)).astype(float)
    names = [f"x{k}" for k in range(7)]
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], ["key", *names]).repartition(3)
    ranks = np.stack([np.array([(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c]) for c in x.T], 1)
    for exact in (False, True):
        got = {(q.attr1, q.attr2): q.rho for q in features.spearman(df, "key", names, exact).collect()}
        want = {(names[i], names[j]): np.corrcoef(ranks[:, i], ranks[:, j])[0, 1] if exact else 1 - 6 * np.square(ranks[:, i] - ranks[:, j]).sum() / (70 * (70**2 - 1)) for i in range(7) for j in range(i + 1, 7)}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("shipped", [3, 7, 40, 10_000])
def test_large_models_are_cut(spark, shipped):
    """Tops at the rows, parts below in a join: the answers of trees shipped whole, with missing values, leaves in the tops and chains."""
    rows = table(spark, 60, missing=True)
    nodes = tree.grow(rows, whole(rows), FEATURES, 0.02, ["c"]).select("bag", F.lit(0).alias("tree"), "node_id", "attr", "border", "missing_l", "value")
    chains = spark.createDataFrame(chain(12, 1) + chain(2, 2), NODES)
    every = nodes.unionByName(chains).cache()
    got = {(r.row_no, r.bag): r.pred for r in predict.cut_predictions(rows, every, FEATURES, shipped).collect()}
    want = {(r.row_no, r.bag): r.pred for r in predict.tree_predictions(rows, every, FEATURES).collect()}
    assert got == pytest.approx(want) and len(want) == 180
