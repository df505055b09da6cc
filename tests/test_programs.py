import random

import pytest
from pyspark.sql import functions as F

from sylvan.operators import grid
from sylvan.plans import programs as p
from sylvan.sources import sinks


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d, r = tmp_path_factory.mktemp("files"), random.Random(1)
    (d / "attr").write_text("y: cont (class).\na: cont.\nb: cont (split).\nc: 0,1.\nname: nom.\ncontexts:\nname never.\n")
    for name in ("train", "valid", "test"):
        lines = []
        for _ in range(60):
            a, b, c = r.randrange(9), r.randrange(5), r.randrange(2)
            lines.append(f"{'?' if name == 'test' and not lines else a - 2 * b * c}\t{a}\t{'?' if r.random() < 0.1 else b}\t{c}\tx")
        (d / name).write_text("\n".join(lines) + "\n")
    schema = p.read_attributes(spark, str(d / "attr"))
    return [p.load(spark, str(d / n), schema, n) for n in ("train", "valid", "test")]


def test_bagged_run(data):
    train, valid, test = data
    out = p.train_bagged(train, valid, 2, 0.1, keep=1)
    assert out["more"] and out["bags"] == 3 and out["preds"].count() == 60 and out["curve"].count() == 2
    assert "b" in out["schema"].active and len(out["schema"].active) <= 2
    preds, error = p.score(test, out["nodes"].select("bag", "node_id", "attr", "border", "missing_l", "value"))
    assert preds.count() == 60 and error is None
    assert p.score(valid, out["nodes"])[1] == pytest.approx(p.performance(out["preds"], valid.rows))
    assert p.feature_effect(valid, out["nodes"], "a", 4).count() >= 2
    joint, density = p.interaction_plot(valid, out["nodes"], "a", "b", 3, 3, {"c": 1.0})
    assert joint.count() >= 4 and density.count() >= 4


def test_analysis_runs(data, spark, tmp_path):
    train, valid, _ = data
    out = p.select_features(train, valid, 0.2, 2, 2, 2, points=4)
    kept = {r["attr"] for r in out["table"].filter("kept").collect()}
    assert set(out["schema"].active) == kept and {r["attr"] for r in out["effects"].select("attr").distinct().collect()} == kept
    assert {r["attr"] for r in out["nodes"].filter("attr IS NOT NULL").collect()} <= kept and out["effects"].filter("pred IS NULL").isEmpty()
    sinks.write_core_features(out["table"], str(tmp_path / "core"))
    assert len(spark.read.text(str(tmp_path / "core")).collect()) == len(kept)
    found = p.find_interactions(train, valid, 0.2, 2, 2, 2, known=(0.0, 0.01), points=3)
    present = {tuple(r["attrs"].split("*")) for r in found["table"].filter("present <> 'none'").collect()}
    assert present == set(found["plots"]) and present
    joint, density = next(iter(found["plots"].values()))
    assert joint.count() >= 4 and density.count() >= 2
    one = p.probe_interaction(train, valid, "b\nc\n", 0.2, 2, 2, 2, known=(0.0, 0.01))
    per_tree = one["nodes"].filter("attr IN ('b', 'c')").groupBy("bag", "tree").agg(F.countDistinct("attr").alias("n"))
    assert one["present"] and per_tree.filter("n > 1").isEmpty()
    with pytest.raises(ValueError, match="no active feature"):
        p.probe_interaction(train, valid, ["zz"], 0.2, 2)


def test_boosting_and_merging(data, tmp_path):
    train, valid, _ = data
    out = p.train_boosted(train, valid, 2, 0.5, alpha=0.2)
    assert out["curve"].count() == 2
    runs = [grid.train_grid(p.together(train, valid), train.features, 0.2, 2, 2, "slow", s, train.booleans) for s in (1, 2)]
    merged = p.merge_groves(runs, train, valid)
    assert merged["run"].bags == 4 and merged["surface"].filter("converged").isEmpty()
    nodes = p.save_merged(runs, 1, 0, str(tmp_path / "model"), train.features)
    preds, error = p.score_file(valid, str(tmp_path / "model"))
    assert error == pytest.approx(p.score(valid, nodes)[1])
    with pytest.raises(ValueError, match="bagged"):
        p.score_file(valid, str(tmp_path / "model"), bagged=True)
    p.save_merged(runs, 0, 0, str(tmp_path / "single"), train.features)
    assert p.score_file(valid, str(tmp_path / "single"), bagged=True)[1] > 0
    both = p.merge_predictions([(preds, 2), (preds.withColumn("pred", F.col("pred") + 2), 2)], valid)
    assert both["curve"].count() == 2 and both["preds"].join(preds.select("row_no", F.col("pred").alias("one")), "row_no").filter(F.abs(F.col("pred") - F.col("one") - 1) > 1e-9).isEmpty()


def test_grove_run(data):
    train, valid, _ = data
    out = p.train_groves(train, valid, 0.2, 1, 2, "layered")
    assert out["best"]["perf"] > 0 and out["next"]["action"] == "expand" and out["next"]["bags"] == 3
    nodes = grid.save_cell([out["run"]], out["best"]["tig_no"], out["best"]["alpha_no"])
    assert p.score(valid, nodes)[1] == pytest.approx(out["best"]["perf"])


def test_bagged_runs_grow(data):
    """Bags added to a run: its trees are taken over, and the whole is that of one run."""
    train, valid, _ = data
    part, whole = (p.train_bagged(train, valid, n, 0.3) for n in (2, 3))
    grown = p.train_bagged(train, valid, 3, 0.3, prior=part)
    rows = lambda df: sorted(map(str, df.collect()))
    key = ["bag", "node_id", "n", "attr", "border", "missing_l", "value"]
    assert rows(grown["nodes"].select(key)) == rows(whole["nodes"].select(key)) and grown["per"].count() == 180
    assert [r.rmse for r in grown["curve"].orderBy("bag").collect()] == pytest.approx([r.rmse for r in whole["curve"].orderBy("bag").collect()])
    assert p.train_bagged_until(train, valid, 2, 3, alpha=0.3)["trained"] == 3
