"""Whole runs from files: what the command lines of such a suite do, with their options as keywords.

Train, valid and test are paths of headerless tables, attributes the path of an attribute file.  Results are data frames and node
tables; ``sources.sinks`` writes them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import snap_alpha, snap_tree_count
from ..operators import effects, ensemble, features, grid, metrics, predict
from ..sources.schema import FeatureSchema, parse_schema
from ..sources.tables import checked_as_read, has_targets, read_table
from .storage import numbered, stored


@dataclass(frozen=True)
class Data:
    """A table with row_no, y, w and the active features."""

    rows: DataFrame
    schema: FeatureSchema

    @property
    def features(self) -> list[str]:
        return list(self.schema.active)

    @property
    def booleans(self) -> list[str]:
        return list(self.schema.booleans)


def read_attributes(spark: SparkSession, path: str) -> FeatureSchema:
    return parse_schema("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def load(spark: SparkSession, path: str, schema: FeatureSchema, role: str) -> Data:
    df, _ = checked_as_read(read_table(spark, path, schema), schema, role, stored)  # the file is read once, before rows are numbered
    w = F.col(schema.weight) if schema.weight else F.lit(1.0)
    df = df.select(F.col(schema.target).alias("y"), w.alias("w"), *schema.active)
    return Data(stored(numbered(df, *[F.col(c).asc_nulls_last() for c in df.columns])), schema)


def together(train: Data, valid: Data) -> DataFrame:
    """key, y, w, features and set of both tables, as groves take them."""
    n = train.rows.count()
    part = lambda d, name, shift: d.rows.select((F.col("row_no") + shift).alias("key"), "y", "w", *d.features, F.lit(name).alias("set"))
    return stored(part(train, "train", 0).unionByName(part(valid, "valid", n)))


def performance(preds: DataFrame, truth: DataFrame, metric: str = "rmse") -> float | None:
    """The metric of (row_no, pred), None where targets are missing."""
    if not has_targets(truth, "y"):
        return None
    both = preds.join(truth.select("row_no", "y", "w"), "row_no")
    if metric == "roc":
        metrics.check_labels(truth)
        return metrics.roc_auc(both).first()[0]
    return metrics.rmse(both).first()[0]


def train_bagged(train: Data, valid: Data, bags: int = 60, alpha: float = 0.0, metric: str = "rmse", seed: int = 1, keep: int | None = None, prior: dict | None = None) -> dict:
    """nodes, preds and curve on valid, scores, whether more bags are needed and how many; with ``keep`` the schema of the best features.  prior: a run of fewer bags with the same
    options, whose trees and predictions are taken over."""
    alpha = snap_alpha(alpha, train.rows.count()) if alpha else 0.0
    done = prior["trained"] if prior else 0
    nodes, rows = ensemble.bagged_trees(train.rows.withColumnRenamed("row_no", "key"), "key", train.features, bags, alpha, seed, train.booleans, done=done)
    per = stored(predict.tree_predictions(valid.rows, nodes, valid.features))
    if prior:
        nodes, per = prior["nodes"].unionByName(nodes), prior["per"].unionByName(per)
    curve = metrics.bagging_curve(per, valid.rows.select("row_no", "y", "w"), "rmse" if metric == "rmse" else "roc")
    scores = features.ranking(ensemble.feature_scores(nodes, rows.agg(F.sum("w")).first()[0]))
    value = "rmse" if metric == "rmse" else "auc"
    errors = [r[value] if metric == "rmse" else 1 - r[value] for r in curve.orderBy("bag").collect()]
    more = metrics.curve_needs_more(errors)
    schema = train.schema
    if keep is not None:
        marked = [a.name for a in schema.features if a.split]
        stay = {r["attr"] for r in features.top_features(scores.drop("place"), keep, marked).collect()}
        for name in train.features:
            schema = schema if name in stay else schema.without(name)
    return {"nodes": nodes, "per": per, "trained": bags, "preds": per.groupBy("row_no").agg(F.avg("pred").alias("pred")), "curve": curve, "scores": scores, "more": more, "bags": metrics.next_bags(bags) if more else bags, "schema": schema}


def train_bagged_until(train: Data, valid: Data, bags: int = 60, most: int = 1000, **options) -> dict:
    """train_bagged, with bags added until the curve on valid is flat, or there are ``most``; no tree is grown twice."""
    run = train_bagged(train, valid, bags, **options)
    while run["more"] and run["trained"] < most:
        run = train_bagged(train, valid, min(run["bags"], most), prior=run, **options)
    return run


def score(test: Data, nodes: DataFrame, metric: str = "rmse") -> tuple[DataFrame, float | None]:
    """Predictions of a saved model, bagged or groves, and the metric where all targets are known."""
    preds = stored(predict.grove_predictions(predict.tree_predictions(test.rows, nodes, test.features)))
    return preds, performance(preds, test.rows, metric)


def score_file(test: Data, path: str, metric: str = "rmse", bagged: bool = False) -> tuple[DataFrame, float | None]:
    """score of a model file.  bagged: only single trees in slow mode are such a model, any other is an error."""
    header, nodes = predict.read_model(test.rows.sparkSession, path, test.features)
    if bagged and (header["mode"] != 0 or header["trees"] != 1):
        raise ValueError(f"not a model of bagged trees: mode {header['mode']}, {header['trees']} trees")
    return score(test, nodes, metric)


def train_boosted(train: Data, valid: Data, trees: int = 100, shrinkage: float = 0.01, subsample: float = -1, alpha: float = 0.0, seed: int = 1, metric: str = "rmse") -> dict:
    if metric == "roc":
        metrics.check_labels(valid.rows)
    nodes, _ = ensemble.boosted_trees(train.rows.withColumnRenamed("row_no", "key"), "key", train.features, trees, shrinkage, subsample, alpha, seed, train.booleans)
    return {"nodes": nodes, "curve": ensemble.boosting_curve(valid.rows, nodes, valid.features, metric)}


def train_groves(train: Data, valid: Data, alpha: float = 0.01, trees: int = 8, bags: int = 60, mode: str = "fast", metric: str = "rmse", seed: int = 1) -> dict:
    """The run, its surface, its best cell and what to do next."""
    alpha, trees = snap_alpha(alpha, train.rows.count()), snap_tree_count(trees)
    run = grid.train_grid(together(train, valid), train.features, alpha, trees, bags, mode, seed, train.booleans)
    return {"run": run, **judge(run, train, valid, metric)}


def expand_groves(run: grid.GridRun, train: Data, valid: Data, alpha: float | None = None, trees: int | None = None, bags: int | None = None, metric: str = "rmse") -> dict:
    run = grid.expand_grid(run, together(train, valid), train.features, alpha, trees, bags, train.booleans)
    return {"run": run, **judge(run, train, valid, metric)}


def merge_groves(runs: list[grid.GridRun], train: Data, valid: Data, metric: str = "rmse") -> dict:
    """One run with the bags of all, judged anew."""
    run = grid.merge_runs(runs)
    return {"run": run, **judge(run, train, valid, metric)}


def merge_predictions(tables: list[tuple[DataFrame, int]], valid: Data, metric: str = "rmse") -> dict:
    """The mean predictions of runs that were scored apart, (row_no, pred) and bags of each, and the metric after each of them."""
    steps = stored(grid.merge_predictions([(t.withColumnRenamed("row_no", "key"), bags) for t, bags in tables]))
    both = steps.join(valid.rows.select(F.col("row_no").alias("key"), "y", "w"), "key")
    curve = metrics.rmse(both, ["step"]) if metric == "rmse" else metrics.roc_auc(both, ["step"])
    return {"preds": steps.filter(F.col("step") == len(tables) - 1).select(F.col("key").alias("row_no"), "pred"), "curve": curve}


def save_merged(runs: list[grid.GridRun], tig_no: int, alpha_no: int, path: str, attrs: list[str], bags: int | None = None) -> DataFrame:
    """The nodes of one cell over all runs, also as a model file."""
    nodes = stored(grid.save_cell(runs, tig_no, alpha_no, bags))
    cell = runs[0].cells.filter((F.col("tig_no") == tig_no) & (F.col("alpha_no") == alpha_no)).select("n", "alpha").first()
    predict.write_model(nodes, path, cell["alpha"], cell["n"], 0, None, attrs)
    return nodes


def judge(run: grid.GridRun, train: Data, valid: Data, metric: str = "rmse") -> dict:
    """Surface, curves' verdict, best cell and what to do next.  In layered mode the best cell is the one for interaction tests."""
    rms, n = metric == "rmse", train.rows.count()
    if not rms:
        metrics.check_labels(valid.rows)
    truth = valid.rows.select((F.col("row_no") + n).alias("key"), "y", "w")
    surface = stored(grid.surface(run, truth, "rmse" if rms else "roc"))
    lines: dict[tuple[int, int], list[float]] = {}
    for r in grid.curves(run, truth, "rmse" if rms else "roc").orderBy("bag").collect():  # a number a bag and cell
        lines.setdefault((r["tig_no"], r["alpha_no"]), []).append(r["perf"])
    fits = True
    if run.mode == "layered":
        cells = {(r["tig_no"], r["alpha_no"]): r.asDict() for r in surface.collect()}
        tigs, alphas = 1 + max(t for t, _ in cells), 1 + max(a for _, a in cells)
        t, a, fits = metrics.interaction_cell([[cells[t, a]["perf"] for a in range(alphas)] for t in range(tigs)], rms)
        best = cells[t, a]
    else:
        best = metrics.best_cell(surface, rms).first().asDict()
    settled = [(t, a, not metrics.curve_needs_more(line)) for (t, a), line in sorted(lines.items())]
    settled = surface.sparkSession.createDataFrame(settled, "tig_no int, alpha_no int, converged boolean")
    about = {"min_alpha": run.alpha, "max_n": run.trees, "bags": run.bags, "mode": run.mode, "rows": n}
    std = metrics.weighted_std(valid.rows).first()[0]
    return {"surface": surface.join(settled, ["tig_no", "alpha_no"]), "best": best, "fits": fits, "next": metrics.recommendation(best, lines, about, rms, fits), "below_baseline": metrics.worse_than_baseline(best["perf"], std, rms)}


def select_features(train: Data, valid: Data, alpha: float, trees: int, bags: int = 10, repeats: int = 10, seed: int = 1, metric: str = "rmse", points: int = 10) -> dict:
    """table (as backward_elimination's, best kept features first), schema of the kept features, nodes of a layered ensemble over them, and the
    effects of all of them."""
    rows = together(train, valid)
    table = stored(features.backward_elimination(rows, train.features, alpha, trees, bags, repeats, seed, train.booleans, metric))
    schema = train.schema
    for r in table.filter("NOT kept").collect():
        schema = schema.without(r["attr"])
    active = [r["attr"] for r in table.filter("kept").collect()]
    nodes = stored(features.layered_nodes(rows, train.features, active, alpha, trees, bags, seed, (), train.booleans))
    order = F.col("perf") if metric == "rmse" else -F.col("perf")
    return {"table": table.orderBy(F.col("kept").desc(), order.desc(), "attr"), "schema": schema, "nodes": nodes, "effects": feature_effects(valid, nodes, active, points)}


def find_interactions(train: Data, valid: Data, alpha: float, trees: int, bags: int = 10, repeats: int = 10, seed: int = 1, metric: str = "rmse", known: tuple[float, float] | None = None, points: int = 10) -> dict:
    """table of all pairs, nodes of the model without restrictions, and the joint effects and densities of the pairs found."""
    rows = together(train, valid)
    table = stored(features.interaction_scan(rows, train.features, alpha, trees, bags, repeats, seed, train.booleans, None, metric, known))
    nodes = stored(features.layered_nodes(rows, train.features, train.features, alpha, trees, bags, seed, (), train.booleans))
    pairs = [tuple(r["attrs"].split("*")) for r in table.filter("present <> 'none'").orderBy(F.col("z").desc(), "attrs").collect()]
    return {"table": table, "nodes": nodes, "plots": {p: interaction_plot(valid, nodes, *p, points, points) for p in pairs}}


def probe_interaction(train: Data, valid: Data, names: str | list[str], alpha: float, trees: int, bags: int = 10, repeats: int = 10, seed: int = 1, metric: str = "rmse", known: tuple[float, float] | None = None) -> dict:
    """One interaction of several features, by name or as the text of a file with a name a line: z, whether it is present (over 3), and the nodes of
    the restricted model."""
    barred = tuple(names.split() if isinstance(names, str) else names)
    for name in barred:
        if name not in train.features:
            raise ValueError(f"no active feature {name}")
    rows = together(train, valid)
    found = features.interaction_scan(rows, train.features, alpha, trees, bags, repeats, seed, train.booleans, [barred], metric, known).first()
    nodes = stored(features.layered_nodes(rows, train.features, train.features, alpha, trees, bags, seed, barred, train.booleans))
    return {"perf": found["perf"], "z": found["z"], "present": found["z"] > 3, "nodes": nodes}


def model_scores(probe: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """probe (some columns and all features) with pred, by joins level by level: fit for models of any size."""
    rows = stored(probe.withColumn("row_no", F.monotonically_increasing_id()))
    return rows.join(predict.grove_predictions(predict.tree_predictions(rows, nodes, features)), "row_no").drop("row_no")


def feature_effects(valid: Data, nodes: DataFrame, attrs: list[str], points: int = 10) -> DataFrame:
    """(attr, val, n, pred): effects of several features at once."""
    probes = []
    for attr in attrs:
        p = effects.quantile_points(valid.rows, attr, points)
        probes.append(p.select(F.lit(attr).alias("attr"), "val", "n", *[(F.col("val") if f == attr else F.lit(None)).cast("double").alias(f) for f in valid.features]))
    return model_scores(reduce(DataFrame.unionByName, probes), nodes, valid.features).select("attr", "val", "n", "pred")


def feature_effect(valid: Data, nodes: DataFrame, attr: str, points: int = 10) -> DataFrame:
    return feature_effects(valid, nodes, [attr], points).drop("attr")


def interaction_plot(valid: Data, nodes: DataFrame, attr1: str, attr2: str, points1: int = 10, points2: int = 10, fixed: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(joint effect, density)."""
    p, q = effects.quantile_points(valid.rows, attr1, points1), effects.quantile_points(valid.rows, attr2, points2)
    grid_ = effects.joint_points(p, q, attr1, attr2, valid.features, fixed)
    joint = model_scores(grid_, nodes, valid.features).select(F.col(attr1).alias("val1"), F.col(attr2).alias("val2"), "pred")
    return joint, effects.density(valid.rows, attr1, attr2, p, q)


def correlations(train: Data) -> tuple[DataFrame, DataFrame]:
    rho = stored(features.spearman(train.rows, "row_no", train.features))
    return features.correlation_list(rho), features.correlation_matrix(rho)
