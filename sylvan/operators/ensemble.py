"""Bagged and boosted trees on the level-wise engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import counted, discard, numbered, stored
from . import metrics, sampling
from .predict import ensemble_expression, tree_predictions
from .tree import grow, grow_state


def bag_items(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """(bag, row_no, coef, resp): a row drawn t times has t times its weight."""
    return sampling.in_bag(draws).join(rows.select("row_no", "y", "w"), "row_no").select("bag", "row_no", (F.col("times") * F.col("w")).alias("coef"), F.col("y").alias("resp"))


def bagged_trees(train: DataFrame, key: str, features: list[str], bags: int = 60, alpha: float = 0.0, seed: int = 1, booleans: list[str] | None = None, max_depth: int | None = None, done: int = 0) -> tuple[DataFrame, DataFrame]:
    """(node table with entropies, numbered rows).  train: key, y, w, features; all bags grow in one pass over the levels.  The first ``done`` bags are left out: draws hang on
    seed and bag, so that bags grown later are those of one run."""
    rows = stored(numbered(train.select(key, "y", "w", *features), key))
    draws = sampling.bootstrap_draws(train.sparkSession, rows.count(), bags, seed).filter(F.col("bag") >= done)
    nodes = grow(rows, bag_items(rows, draws), features, alpha, booleans, max_depth, with_entropy=True)
    return stored(nodes), rows


def bagged_predictions(rows: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    return tree_predictions(rows, nodes, features).groupBy("row_no").agg(F.avg("pred").alias("pred"))


def out_of_bag_predictions(rows: DataFrame, nodes: DataFrame, draws: DataFrame, features: list[str], bags: int) -> DataFrame:
    """Each row by the trees whose bags it is out of."""
    out = sampling.out_of_bag(rows.select("row_no"), draws, bags)
    return tree_predictions(rows, nodes, features).join(out, ["bag", "row_no"], "left_semi").groupBy("row_no").agg(F.avg("pred").alias("pred"))


def feature_scores(nodes: DataFrame, volume: float) -> DataFrame:
    """(attr, score): the volume of the nodes an attribute splits, each divided by its entropy there if above 1, over the bag's
    volume, as a mean of bags.  ``volume`` is the weight of all training rows."""
    bags = nodes.select("bag").distinct().count()
    inner = nodes.filter("attr IS NOT NULL")
    return inner.groupBy("attr").agg((F.sum(F.col("v") / F.greatest(F.lit(1.0), F.col("entropy"))) / F.lit(float(volume) * bags)).alias("score"))


def boosted_trees(train: DataFrame, key: str, features: list[str], rounds: int = 100, shrinkage: float = 0.01, subsample: float = -1, alpha: float = 0.0, seed: int = 1, booleans: list[str] | None = None, max_depth: int | None = None, bootstrap: bool = True) -> tuple[DataFrame, DataFrame]:
    """(node table with tree = round and values times shrinkage, predictions of the training rows).  Each round fits a tree to the
    residuals on a bootstrap bag, on subsample * n rows without replacement, or with bootstrap False on all rows; starts from 0.

    Rows keep their predictions with their features; a round's items are made of them as the first level reads them, and the step is one column of
    the round's tree, so that a round writes its levels and the rows once."""
    rows, n = counted(numbered(train.select(key, "y", "w", *[F.col(f).cast("double").alias(f) for f in features]), key).withColumn("pred", F.lit(0.0)))
    keys, trees = rows.select("row_no", key), []
    for k in range(rounds):
        item = lambda coef: F.array(F.struct(F.lit(0).cast("long").alias("slot"), coef.cast("double").alias("coef"), (F.col("y") - F.col("pred")).cast("double").alias("resp")))
        size = n
        if 0 < subsample <= 1:
            size = int(n * subsample)
            state = sampling.subsample(rows, "row_no", size, seed + k).withColumn("items", item(F.col("w")))
        elif bootstrap:
            drawn, size = counted(sampling.in_bag(sampling.bootstrap_draws(train.sparkSession, n, 1, seed + k)).select("row_no", "times"))
            state = rows.join(drawn, "row_no").withColumn("items", item(F.col("times") * F.col("w")))
        else:
            state = rows.withColumn("items", item(F.col("w")))
        state = state.select("row_no", *features, "items")
        if state_moves := 0 < subsample <= 1 or bootstrap:
            state = stored(state)
        nodes = grow_state(state, {0: size}, features, n, alpha, booleans, max_depth).withColumns({"tree": F.lit(k), "value": F.col("value") * shrinkage})
        if state_moves:
            discard(state)
        trees.append(nodes)
        later = stored(rows.withColumn("pred", F.col("pred") + ensemble_expression(nodes)))
        if k:
            discard(rows)
        rows = later
    return reduce(DataFrame.unionByName, trees), rows.select("row_no", "pred").join(keys, "row_no")


def back_fitted(train: DataFrame, key: str, features: list[str], trees: int, sweeps: int, seed: int = 1, booleans: list[str] | None = None, max_depth: int | None = None, bag: int | None = None) -> list[DataFrame]:
    """(key, y, w, times, pred) after each sweep over a grove's trees: each fitted anew to what the others leave, the last first.  Fitted to all rows once, or to a bag's
    draws of the first step (times: how often a row is drawn).

    As in boosting, rows keep what each tree answers with their features; the step is one column of the tree."""
    rows = train.select(F.col(key), F.col("y").cast("double"), F.col("w").cast("double"), *[F.col(f).cast("double").alias(f) for f in features])
    if bag is None:
        rows = rows.withColumns({"row_no": F.col(key), "times": F.lit(1).cast("long")})
    else:
        rows, n = counted(numbered(rows, key))
        drawn = sampling.in_bag(sampling.bootstrap_draws(train.sparkSession, n, bag + 1, seed, 0).filter(F.col("bag") == bag)).select("row_no", "times")
        rows = rows.join(drawn, "row_no", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    single = [f"_s{k}" for k in range(trees)]
    rows, n = counted(rows.withColumns({s: F.lit(0.0) for s in single}))
    total, out, kept = reduce(lambda a, b: a + b, [F.col(s) for s in single]), [], False
    for _ in range(sweeps):
        for k in [trees - 1, *range(trees - 1)]:
            item = F.struct(F.lit(0).cast("long").alias("slot"), (F.col("times") * F.col("w")).alias("coef"), (F.col("y") - (total - F.col(single[k]))).alias("resp"))
            state = rows.filter("times > 0").select("row_no", *features, F.array(item).alias("items"))
            nodes = grow_state(state, {0: n}, features, n, 0.0, booleans, max_depth)
            later = stored(rows.withColumn(single[k], ensemble_expression(nodes)))
            if not kept:
                discard(rows)
            rows, kept = later, False
        out.append(rows.select(key, "y", "w", "times", total.alias("pred")))
        kept = True
    return out


def boosting_curve(rows: DataFrame, nodes: DataFrame, features: list[str], metric: str = "rmse") -> DataFrame:
    """(tree, rmse or auc) of the first trees together."""
    per = tree_predictions(rows, nodes, features)
    sofar = Window.partitionBy("row_no").orderBy("tree").rowsBetween(Window.unboundedPreceding, 0)
    both = per.select("row_no", "tree", F.sum("pred").over(sofar).alias("pred")).join(rows.select("row_no", "y", "w"), "row_no")
    return metrics.rmse(both, ["tree"]) if metric == "rmse" else metrics.roc_auc(both, ["tree"])
