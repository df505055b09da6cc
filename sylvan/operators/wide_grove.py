"""Groves level by level: for training tables that no task can hold.

The in-memory kernel gives each bag to a task.  Here the trees of a turn grow together on the level-wise engine for all *runs*: a run is a bag, a bag
on one of the ways to a cell of a grid, or a bag under a restriction, and is a key of the trees' items.  Draws, split rules and stopping rule are the kernel's,
so that both give the same groves.  Rows, predictions by tree, and items stay tables; the driver knows a pair of errors a run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import alpha_steps, alpha_value, tree_count, tree_count_steps
from ..plans.storage import discard, numbered, stored
from . import metrics, sampling
from .grid import GridRun
from .kernel import gains
from .predict import tree_predictions
from .tree import grow

NODE = ["tree", "node_id", "attr", "border", "missing_l", "value"]
Errors = dict[int, tuple[float, float]]


def _singles(trees: int) -> list[str]:
    return [f"s{k}" for k in range(trees)]


def _sum(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


class Groves:
    """Groves of (row_no, y, w, features).  A state is (bag, row_no, s0, s1, …): what each tree of each run answers to each row."""

    def __init__(self, rows: DataFrame, features: list[str], seed: int = 1, booleans: list[str] | None = None):
        self.rows, self.features, self.seed, self.booleans = stored(rows.select("row_no", "y", "w", *features)), list(features), seed, booleans
        self.spark, self.n = rows.sparkSession, self.rows.count()

    def _table(self, pairs: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(pairs, schema)

    def zero(self, runs: list[int], trees: int) -> DataFrame:
        every = F.explode(F.array(*[F.lit(r).cast("long") for r in runs])).alias("bag")
        return self.rows.select(every, "row_no", *[F.lit(0.0).alias(s) for s in _singles(trees)])

    def state_of(self, nodes: DataFrame, trees: int) -> DataFrame:
        """The state of groves given as nodes (bag, tree, …)."""
        pred = tree_predictions(self.rows, nodes, self.features)
        return pred.groupBy("bag", "row_no").agg(*[F.sum(F.when(F.col("tree") == k, F.col("pred"))).alias(s) for k, s in enumerate(_singles(trees))])

    def _errors(self, state: DataFrame, drawn: DataFrame, joint: Column) -> Errors:
        """(error in the bag, where a row counts as often as drawn, error out of it) of each run."""
        both = state.select("bag", "row_no", joint.alias("pred")).join(self.rows.select("row_no", "y", "w"), "row_no").join(drawn, ["bag", "row_no"], "left")
        both = both.withColumn("inside", F.col("times").isNotNull()).withColumn("w", F.col("w") * F.coalesce("times", F.lit(1)))
        found: dict[int, list[float]] = {}
        for r in metrics.rmse(both, ["bag", "inside"]).collect():  # two numbers a run
            found.setdefault(r["bag"], [0.0, 0.0])[0 if r["inside"] else 1] = r["rmse"] or 0.0
        return {bag: tuple(e) for bag, e in found.items()}

    def _grown(self, items: DataFrame, share: float, barred: dict[int, tuple[str, ...]], drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes, predictions as (bag, row_no, new)) of a tree for each run of items.  Under a restriction, a tree is grown without each of its features in turn, and
        the best out of the bag stays; all of them grow together, the restriction being a part of their key."""
        if not barred:
            nodes = stored(grow(self.rows, items, self.features, share, self.booleans))
            return nodes, tree_predictions(self.rows, nodes, self.features).select("bag", "row_no", F.col("pred").alias("new"))
        tried = [(run, attr) for run in sorted(barred) for attr in barred[run]]
        key = self._table([(k, run) for k, (run, _) in enumerate(tried)], "try long, bag long")
        each = items.join(key, "bag").select(F.col("try").alias("bag"), "row_no", "coef", "resp")
        every = stored(grow(self.rows, each, self.features, share, self.booleans, without={k: attr for k, (_, attr) in enumerate(tried)}))
        pred = stored(tree_predictions(self.rows, every, self.features).select(F.col("bag").alias("try"), "row_no", "pred").join(key, "try"))
        told = pred.join(self._left, ["bag", "row_no"]).join(drawn, ["bag", "row_no"], "left_anti")
        error = {r["try"]: r["rmse"] for r in metrics.rmse(told, ["try"], target="resp").collect()}  # a number a try
        best: dict[int, tuple] = {}
        for k, (run, _) in enumerate(tried):
            best[run] = min(best.get(run, (error.get(k, 0.0), k)), (error.get(k, 0.0), k))
        chosen = self._table([(k, run) for run, (_, k) in best.items()], "try long, run long")
        nodes = stored(every.withColumnRenamed("bag", "try").join(chosen, "try").drop("try").withColumnRenamed("run", "bag"))
        return nodes, pred.join(chosen.select("try"), "try").select("bag", "row_no", F.col("pred").alias("new"))

    def converge(self, state: DataFrame, trees: int, share: float, step: int, bags: dict[int, int], barred: dict[int, tuple[str, ...]] | None = None) -> tuple[DataFrame, Errors, DataFrame | None]:
        """Passes over the trees, each fitted anew to what the others leave, the newest first, until a run gains too little.  bags: each run's bag, whose draws of
        ``step`` it takes.  (state, errors, nodes)."""
        single, runs = _singles(trees), self._table(sorted((b, r) for r, b in bags.items()), "bag long, run long")
        joint = _sum(single)
        draws = sampling.bootstrap_draws(self.spark, self.n, max(bags.values()) + 1, self.seed, step).select("bag", "row_no")
        draws = stored(draws.join(runs, "bag").select(F.col("run").alias("bag"), "row_no"))
        drawn = stored(draws.groupBy("bag", "row_no").agg(F.count("*").alias("times")))
        state = stored(state)
        errors, live = self._errors(state, drawn, joint), set(bags)
        known: dict[int, list[tuple[set[int], DataFrame]]] = {k: [] for k in range(trees)}  # fits of a tree, and whose runs they are of
        while live:
            own = self._table([(r,) for r in sorted(live)], "bag long")
            for k in [trees - 1, *range(trees - 1)]:
                self._left = state.join(own, "bag").select("bag", "row_no", (joint - F.col(single[k])).alias("others")).join(self.rows.select("row_no", "y", "w"), "row_no").select("bag", "row_no", "w", (F.col("y") - F.col("others")).alias("resp"))
                items = draws.join(self._left, ["bag", "row_no"]).select("bag", "row_no", F.col("w").alias("coef"), "resp")
                nodes, pred = self._grown(items, share, {r: barred[r] for r in live if barred.get(r)} if barred else {}, drawn)
                known[k] = [(b - live, df) for b, df in known[k] if b - live] + [(set(live), nodes)]
                later = stored(state.join(pred, ["bag", "row_no"], "left").select("bag", "row_no", *[F.coalesce("new", s).alias(s) if s == single[k] else F.col(s) for s in single]))
                discard(state)
                state = later
            now = self._errors(state, drawn, joint)
            live = {b for b in live if gains(errors[b], now[b])}
            errors = now
        discard(draws)
        discard(drawn)
        out = [df.join(self._table([(r,) for r in sorted(b)], "bag long"), "bag").withColumn("tree", F.lit(k)) for k, fits in known.items() for b, df in fits]
        return state, errors, reduce(DataFrame.unionByName, out).select("bag", *NODE)

    def layered(self, alpha: float, trees: int, bags: dict[int, int], barred: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
        """Nodes of groves of fixed size, alpha going down its grid to ``alpha``; a run that isn't fitted again on a later step keeps its trees."""
        state, steps = stored(self.zero(sorted(bags), trees)), alpha_steps(alpha, self.n)
        for step in range(steps):
            share = (alpha_value(step) if step < steps - 1 else alpha) or 1.0 / self.n
            later, _, nodes = self.converge(state, trees, share, step, bags, barred)
            discard(state)
            state = later
        return nodes


def _numbered(train: DataFrame, key: str, features: list[str]) -> DataFrame:
    return numbered(train.select(key, "y", "w", *features), key)


def layered_nodes(train: DataFrame, key: str, features: list[str], alpha: float, trees: int, bags: int, seed: int = 1, booleans: list[str] | None = None, barred: tuple[str, ...] = ()) -> DataFrame:
    """Node table (bag, tree, node_id, attr, border, missing_l, value) of a layered ensemble.  train: key, y, w, features.  No tree holds all of ``barred``."""
    groves = Groves(_numbered(train, key, features), features, seed, booleans)
    return groves.layered(alpha, trees, {b: b for b in range(bags)}, {b: barred for b in range(bags)} if barred else None)


def _mean_errors(rows: DataFrame, nodes: DataFrame, features: list[str], bags: int, runs: int, metric: str) -> list[float]:
    """Validation performance of each ensemble: its runs are numbered run * bags + bag."""
    valid = rows.filter("set = 'valid'").withColumnRenamed("key", "row_no")
    pred = tree_predictions(valid, nodes, features).groupBy("bag", "row_no").agg(F.sum("pred").alias("pred"))
    mean = pred.groupBy(F.floor(F.col("bag") / bags).alias("run"), "row_no").agg(F.avg("pred").alias("pred")).join(valid.select("row_no", "y", "w"), "row_no")
    found = metrics.rmse(mean, ["run"]) if metric == "rmse" else metrics.roc_auc(mean, ["run"])
    out = {r["run"]: r[1] for r in found.collect()}  # a number an ensemble
    return [out[k] for k in range(runs)]


def restricted_errors(rows: DataFrame, features: list[str], sets: list[tuple[str, ...]], alpha: float, trees: int, bags: int, seed: int = 1, booleans: list[str] = (), metric: str = "rmse") -> list[float]:
    """Validation performance of one layered ensemble for each set of features that no tree may hold all of; the sets are keys of one growth."""
    train = rows.filter("set = 'train'")
    groves = Groves(_numbered(train, "key", features), features, seed, list(booleans))
    runs = {k * bags + b: b for k in range(len(sets)) for b in range(bags)}
    nodes = groves.layered(alpha, trees, runs, {r: tuple(sets[r // bags]) for r in runs})
    return _mean_errors(rows, nodes, features, bags, len(sets), metric)


def removal_errors(rows: DataFrame, features: list[str], active: list[str], alpha: float, trees: int, bags: int, seed: int = 1, booleans: list[str] = (), metric: str = "rmse") -> dict[str, float]:
    """Validation performance without each of the active features: all candidates for removal are keys of one growth."""
    train = rows.filter("set = 'train'")
    groves = Groves(_numbered(train, "key", active), active, seed, [b for b in booleans if b in active])
    runs = {k * bags + b: b for k in range(len(active)) for b in range(bags)}
    nodes = groves.layered(alpha, trees, runs, {r: (active[r // bags],) for r in runs})
    return dict(zip(active, _mean_errors(rows, nodes, active, bags, len(active), metric), strict=True))


def train_grid(rows: DataFrame, features: list[str], alpha: float = 0.01, trees: int = 8, bags: int = 60, mode: str = "fast", seed: int = 1, booleans: list[str] = (), prior: GridRun | None = None) -> GridRun:
    """grid.train_grid on tables.  A cell is one growth of all bags, on both ways where both are tried; it starts from the stored states of its neighbours.  Of a bag
    that a prior run has, only the cells that it lacks are trained, from the nodes at its edge."""
    groves = Groves(_numbered(rows.filter("set = 'train'"), "key", features), features, seed, list(booleans))
    valid = rows.filter("set = 'valid'").withColumnRenamed("key", "row_no").select("row_no", *features)
    alphas, tigs = alpha_steps(alpha, groves.n), tree_count_steps(trees)
    top = prior.cells.agg(F.max("tig_no"), F.max("alpha_no")).first() if prior else (-1, -1)
    old = set(range(prior.bags)) if prior else set()
    turns = dict((prior.turns or {}) if prior else {})
    cells, kept, states = [], [], {}

    def known(t: int, a: int) -> DataFrame | None:
        """The state of a cell that the prior run has, for its bags."""
        if not (old and t <= top[0] and a <= top[1]):
            return None
        nodes = prior.nodes.filter((F.col("tig_no") == t) & (F.col("alpha_no") == a)).select("bag", *NODE)
        return groves.state_of(nodes, tree_count(t)).select("bag", "row_no", *_singles(tree_count(t)))

    def start(t: int, a: int, ways: list[tuple[int, bool]]) -> DataFrame:
        """States of runs (bag, from below): 2 * bag + way."""
        n, parts = tree_count(t), []
        for up in (False, True):
            own = [b for b, way in ways if way == up]
            before = states.get((t - 1, a) if up else (t, a - 1))
            if not own:
                continue
            runs = groves._table([(b, 2 * b + up) for b in own], "bag long, run long")
            if before is None:
                parts.append(groves.zero([2 * b + up for b in own], n))
                continue
            have = [c for c in before.columns if c.startswith("s")]
            parts.append(before.join(runs, "bag").select(F.col("run").alias("bag"), "row_no", *have, *[F.lit(0.0).alias(s) for s in _singles(n)[len(have) :]]))
        return reduce(DataFrame.unionByName, parts)

    def train(t: int, a: int, ways: list[tuple[int, bool]]) -> tuple[DataFrame, DataFrame, dict[int, bool]]:
        """(state, nodes, way) of the best way of each bag."""
        share = (alpha_value(a) if a < alphas - 1 else alpha) or 1.0 / groves.n
        state, errors, nodes = groves.converge(start(t, a, ways), tree_count(t), share, 1000 * a + t, {2 * b + up: b for b, up in ways})
        best = {b: min((*errors[2 * c + up], up) for c, up in ways if c == b)[2] for b, _ in ways}
        chosen = groves._table([(2 * b + up, b) for b, up in best.items()], "bag long, run long")
        pick = lambda df: df.join(chosen, "bag").drop("bag").withColumnRenamed("run", "bag")
        return stored(pick(state)), stored(pick(nodes)), best

    for a in range(alphas):
        for t in range(tigs):
            own = [b for b in range(bags) if not (b in old and t <= top[0] and a <= top[1])]
            parts = [p for p in [known(t, a)] if p is not None]
            both = a > 0 and t > 0 and mode != "layered"
            only = False if mode == "layered" or t == 0 else True  # where there is one way
            found = []
            if own and both and mode == "fast" and (t, a) not in turns and 0 in own:
                found.append(train(t, a, [(0, False), (0, True)]))  # the first bag decides for all
                turns[t, a] = found[0][2][0]
                own = [b for b in own if b]
            ways = ([False, True] if mode == "slow" else [turns[t, a]]) if both else [only]
            if own:
                found.append(train(t, a, [(b, up) for b in own for up in ways]))
            if mode == "fast" and found and (t, a) not in turns:
                turns[t, a] = only
            for state, nodes, best in found:
                parts.append(state)
                told = groves._table([(b, up) for b, up in best.items()], "bag long, from_below boolean")
                pred = tree_predictions(valid, nodes, features).groupBy("bag", F.col("row_no").alias("key")).agg(F.sum("pred").alias("pred")).join(told, "bag")
                value = alpha_value(a) if a < alphas - 1 else alpha
                cells.append(stored(pred.select("bag", F.lit(t).alias("tig_no"), F.lit(a).alias("alpha_no"), F.lit(tree_count(t)).alias("n"), F.lit(float(value)).alias("alpha"), "from_below", "key", "pred")))
                kept.append(nodes.select("bag", F.lit(t).alias("tig_no"), F.lit(a).alias("alpha_no"), *NODE))
            states[t, a] = stored(reduce(DataFrame.unionByName, parts)) if parts else None
        for t in range(tigs):
            if (t, a - 1) in states:
                discard(states.pop((t, a - 1)))
    every: Callable = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return GridRun(every(cells), every(kept), seed, alpha, trees, bags, mode, turns if mode == "fast" else None)
