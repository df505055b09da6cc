"""Grids of grove models: training, growing further, merging runs, picking cells."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import alpha_steps, alpha_value, tree_count
from ..plans.storage import stored
from . import kernel, metrics

CELLS = "bag long, tig_no int, alpha_no int, n int, alpha double, from_below boolean, key long, pred double, nodes string"


@dataclass(frozen=True)
class GridRun:
    """cells: a row for each bag, cell and scored row (bag, tig_no, alpha_no, n, alpha, from_below, key, pred); nodes: its trees; turns: in fast
    mode, whether a cell grows from the one below, by (tig_no, alpha_no)."""

    cells: DataFrame
    nodes: DataFrame
    seed: int
    alpha: float
    trees: int
    bags: int
    mode: str
    turns: dict[tuple[int, int], bool] | None = None


def tree_rows(bag: int, t: int, a: int, grove: kernel.Grove, names: list[str]) -> list[tuple]:
    """(bag, tig_no, alpha_no, tree, node_id, attr, border, missing_l, value) of a grove's nodes."""
    out = []
    for k, tree in enumerate(grove.trees):
        todo = [(0, "1")]
        while todo:
            i, node = todo.pop()
            leaf = tree.attr[i] < 0
            out.append((int(bag), t, a, k, node, None if leaf else names[tree.attr[i]], None if leaf or np.isnan(tree.border[i]) else float(tree.border[i]), None if leaf else float(tree.missing_l[i]), float(tree.value[i]) if leaf else None))
            if not leaf:
                todo += [(tree.left[i], node + "0"), (tree.right[i], node + "1")]
    return out


NODES = "array<struct<bag:long,tig_no:int,alpha_no:int,tree:int,node_id:string,attr:string,border:double,missing_l:double,value:double>>"


def _known(data: kernel.BagData, names: list[str], edge: pd.DataFrame, tigs: int, alphas: int) -> dict[tuple[int, int], kernel.Grove | None]:
    """The cells that a bag has already, with the groves of those at the edge; none for a new bag."""
    if not len(edge):
        return {}
    known: dict = {(t, a): None for t in range(tigs) for a in range(alphas)}
    for (t, a), own in edge.groupby(["tig_no", "alpha_no"]):
        grove = kernel.Grove(data, tree_count(int(t)))
        for k, rows in own.groupby("tree"):
            rows = rows.astype(object).where(rows.notna(), None)
            grove.trees[int(k)] = kernel.Tree.of_nodes(list(rows[["node_id", "attr", "border", "missing_l", "value"]].itertuples(index=False, name=None)), names)
        grove.single = [tree.predict(data.x) for tree in grove.trees]
        known[int(t), int(a)] = grove
    return known


def _edge(run: GridRun) -> tuple[DataFrame, int, int]:
    """(nodes of the cells that further ones start from, numbers of trees, alphas) of a run."""
    top = run.cells.agg(F.max("tig_no"), F.max("alpha_no")).first()
    nodes = run.nodes.filter((F.col("tig_no") == top[0]) | (F.col("alpha_no") == top[1]))
    return nodes.select("bag", "tig_no", "alpha_no", "tree", "node_id", "attr", "border", "missing_l", "value"), top[0] + 1, top[1] + 1


def _directions(rows: DataFrame, features: list[str], alpha: float, trees: int, seed: int, booleans: list[str], prior: GridRun | None) -> dict[tuple[int, int], bool]:
    """Fast mode: the first bag tries both ways and decides for all.  What a prior run has decided stays."""
    edge, tigs, alphas = _edge(prior) if prior else (None, 0, 0)

    def work(data, scored, *more):
        known = _known(data, features, more[0], tigs, alphas) if more else None
        yield pd.DataFrame([(t, a, below) for t, a, below, _, _, _ in kernel.grid(data, alpha, trees, known=known)], columns=["t", "a", "below"])

    first = kernel.per_bag(rows, 1, features, "t int, a int, below boolean", work, seed, booleans, nodes=edge.filter("bag = 0") if prior else None)
    return {**((prior.turns or {}) if prior else {}), **{(r["t"], r["a"]): r["below"] for r in first.collect()}}  # a flag a cell


def train_grid(rows: DataFrame, features: list[str], alpha: float = 0.01, trees: int = 8, bags: int = 60, mode: str = "fast", seed: int = 1, booleans: list[str] = (), prior: GridRun | None = None) -> GridRun:
    """rows: key, y, w, features, set (train or valid).  All cells up to (alpha, trees), all bags in parallel; of a bag that a prior run has, only the
    cells that it lacks, grown on from those at its edge."""
    names = list(features)
    turns = _directions(rows, names, alpha, trees, seed, booleans, prior) if mode == "fast" else None
    edge, tigs, depth = _edge(prior) if prior else (None, 0, 0)

    def work(data, scored, *more):
        steps = alpha_steps(alpha, len(data.y))
        known = _known(data, names, more[0], tigs, depth) if more else None
        for t, a, below, _, _, grove in kernel.grid(data, alpha, trees, mode, turns, known):
            pred = np.sum([tree.predict(scored.x) for tree in grove.trees], axis=0)
            cell = {"bag": data.bag, "tig_no": t, "alpha_no": a, "n": tree_count(t), "alpha": alpha_value(a) if a < steps - 1 else alpha, "from_below": below}
            yield pd.DataFrame(cell | {"key": scored.key, "pred": pred, "nodes": None})
            yield pd.DataFrame([cell | {"key": -1, "pred": 0.0, "nodes": json.dumps(tree_rows(data.bag, t, a, grove, names))}])

    done = stored(kernel.per_bag(rows, bags, names, CELLS, work, seed, booleans, nodes=edge))
    raw = done.filter("nodes IS NOT NULL").select(F.explode(F.from_json("nodes", "array<array<string>>")).alias("x"))
    nodes = raw.select(*[F.col("x")[k].cast(f.dataType).alias(f.name) for k, f in enumerate(_node_fields(NODES))])
    return GridRun(done.filter("nodes IS NULL").drop("nodes"), nodes, seed, alpha, trees, bags, mode, turns)


def _node_fields(schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).elementType.fields


def curves(run: GridRun, truth: DataFrame, metric: str = "rmse") -> DataFrame:
    """(tig_no, alpha_no, bag, perf) of the mean of the first bags; truth: key, y, w."""
    w = Window.partitionBy("tig_no", "alpha_no", "key").orderBy("bag").rowsBetween(Window.unboundedPreceding, 0)
    mean = run.cells.select("tig_no", "alpha_no", "bag", "key", F.avg("pred").over(w).alias("pred")).join(truth, "key")
    by = ["tig_no", "alpha_no", "bag"]
    return (metrics.rmse(mean, by) if metric == "rmse" else metrics.roc_auc(mean, by)).withColumnRenamed("rmse" if metric == "rmse" else "auc", "perf")


def surface(run: GridRun, truth: DataFrame, metric: str = "rmse") -> DataFrame:
    """(tig_no, alpha_no, n, alpha, perf) with all bags."""
    last = curves(run, truth, metric).filter(F.col("bag") == run.cells.agg(F.max("bag")).first()[0])
    return last.join(run.cells.select("tig_no", "alpha_no", "n", "alpha").distinct(), ["tig_no", "alpha_no"]).drop("bag")


def expand_grid(run: GridRun, rows: DataFrame, features: list[str], alpha: float | None = None, trees: int | None = None, bags: int | None = None, booleans: list[str] = (), train=None) -> GridRun:
    """A larger grid or more bags.  Only missing cells are trained: a bag of the run goes on from the groves at its edge, and new bags
    get all cells.  Draws hang on seed, bag and cell, so that the result is that of training everything at once.  train: train_grid, here or of wide_grove."""
    alpha = run.alpha if alpha is None else min(alpha, run.alpha)
    trees, bags = max(trees or 0, run.trees), max(bags or 0, run.bags)
    more = (train or train_grid)(rows, features, alpha, trees, bags, run.mode, run.seed, booleans, run)
    return GridRun(stored(run.cells.unionByName(more.cells)), stored(run.nodes.unionByName(more.nodes)), run.seed, alpha, trees, bags, run.mode, more.turns)


def merge_runs(runs: list[GridRun]) -> GridRun:
    """One run with the bags of all, renumbered.  The grids must be alike and the seeds differ."""
    first = runs[0]
    if any((r.alpha, r.trees, r.mode) != (first.alpha, first.trees, first.mode) for r in runs):
        raise ValueError("different grids")
    if len({r.seed for r in runs}) < len(runs):
        raise ValueError("equal seeds")
    cells, nodes, base = first.cells, first.nodes, first.bags
    for r in runs[1:]:
        cells = cells.unionByName(r.cells.withColumn("bag", F.col("bag") + base))
        nodes = nodes.unionByName(r.nodes.withColumn("bag", F.col("bag") + base))
        base += r.bags
    return GridRun(cells, nodes, first.seed, first.alpha, first.trees, base, first.mode)


def merge_predictions(tables: list[tuple[DataFrame, int]]) -> DataFrame:
    """(step, key, pred): the mean of all bags of the first runs; each run gives (its mean predictions, its bags)."""
    every = None
    for step, (df, bags) in enumerate(tables):
        part = df.select(F.lit(step).alias("step"), "key", (F.col("pred") * bags).alias("sum"), F.lit(bags).alias("bags"))
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return every.select("step", "key", (F.sum("sum").over(w) / F.sum("bags").over(w)).alias("pred"))


def save_cell(runs: list[GridRun], tig_no: int, alpha_no: int, bags: int | None = None) -> DataFrame:
    """Node table (bag, tree, node_id, attr, border, missing_l, value) of one cell's first bags over one run or several."""
    run = runs[0] if len(runs) == 1 else merge_runs(runs)
    own = run.nodes.filter((F.col("tig_no") == tig_no) & (F.col("alpha_no") == alpha_no) & (F.col("bag") < (bags or run.bags)))
    return own.select("bag", "tree", "node_id", "attr", "border", "missing_l", "value")
