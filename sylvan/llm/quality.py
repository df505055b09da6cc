"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark columns.  Boosted shallow trees are grown on them from a bounded sample of labelled
documents (at most ``max_train_docs``, chosen by a hash of the id, default MAX_TRAIN_DOCS); each
path from a root to a node is a conjunctive rule.  A lasso logistic regression on the rules keeps few of them.
The rules and their weights are compiled into one Spark column, so that scoring runs in generated code and
ships nothing but numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hinted, id_and_text, id_remainder

MAX_TRAIN_DOCS = 20_000
TREES, DEPTH, BINS, MIN_LEAF, RATE = 40, 3, 32, 10, 0.3
#: Lasso penalties tried, as shares of the least one that leaves no rule.
PENALTIES = (0.1, 0.03, 0.01, 0.003)
STEPS, SLACK = 50, 0.01


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as columns; all 0 for an empty one."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    only = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("double")
    count = lambda s: (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))).cast("double")
    words, lines = F.split(F.trim(text), r"[\x20\x09-\x0D]+"), F.split(text, "\n")
    w = F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("double")
    letters = F.greatest(only(r"\p{L}"), F.lit(1.0))
    return {
        "chars": F.length(text).cast("double"),
        "words": F.regexp_count(text, F.lit(WORD)).cast("double"),
        "word_length": only(r"\p{L}") / w,
        "letters": only(r"\p{L}") / n,
        "upper": only(r"\p{Lu}") / letters,
        "digits": only("0-9") / n,
        "symbols": only(r"#$%&*+/<=>@\\^_`{|}~\[\]") / n,
        "calls": count("!") / w,
        "stops": count(".") / w,
        "commas": count(",") / w,
        "distinct_words": F.size(F.array_distinct(words)).cast("double") / w,
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
        "line_words": F.regexp_count(text, F.lit(WORD)).cast("double") / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above?, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[f] > t) if above else (x[f] <= t) for f, above, t in self.conditions])

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            out = out & ((F.col(f) > F.lit(t)) if above else (F.col(f) <= F.lit(t)))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def tree_rules(x: dict[str, np.ndarray], y: np.ndarray) -> list[Rule]:
    """The paths of TREES boosted trees (squared loss on the logistic gradient), each rule once."""
    names = list(x)
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])) for f, v in x.items()}
    codes = {f: np.searchsorted(cuts[f], v, side="left") for f, v in x.items()}
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        residual = y - _sigmoid(margin)
        nodes = [((), np.arange(len(y)))]
        for _ in range(DEPTH):
            grown = []
            for path, rows in nodes:
                r, best = residual[rows], None
                for f in names:
                    if not len(cuts[f]):
                        continue
                    n = np.cumsum(np.bincount(codes[f][rows], minlength=len(cuts[f]) + 1))[:-1]
                    s = np.cumsum(np.bincount(codes[f][rows], r, len(cuts[f]) + 1))[:-1]
                    ok = (n >= MIN_LEAF) & (len(rows) - n >= MIN_LEAF)
                    if ok.any():
                        gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(rows) - n, 1), -1)
                        k = int(np.argmax(gain))
                        if best is None or gain[k] > best[0] + 1e-12:
                            best = (gain[k], f, k)
                if best is None or best[0] <= r.sum() ** 2 / len(rows) + 1e-9:
                    margin[rows] += 4 * RATE * r.mean()
                    continue
                _, f, k = best
                left = codes[f][rows] <= k
                for side, above in ((left, False), (~left, True)):
                    step = (*path, (f, above, float(cuts[f][k])))
                    rules[Rule(step)] = None
                    grown.append((step, rows[side]))
            nodes = grown
        for _, rows in nodes:
            margin[rows] += 4 * RATE * residual[rows].mean()
    return list(rules)


def lasso(h: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (intercept first, without penalty) of an L1 logistic regression: quadratic models of the loss, each minimised coordinate by
    coordinate, until no condition of the optimum is off by more than SLACK of the penalty."""
    a = np.hstack([np.ones((len(y), 1), np.float32), h])
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    bound = np.full(len(w), penalty)
    bound[0] = 0
    value = lambda u: _loss(a @ u, y) + penalty * np.abs(u[1:]).sum()
    for _ in range(STEPS):
        p = _sigmoid(a @ w)
        curve = np.maximum(p * (1 - p), 1e-5).astype(np.float32)
        gram = ((a * curve[:, None]).T @ a).astype(float) / len(y)
        pull = a.T @ (y - p) / len(y) + gram @ w
        u = _coordinates(gram, pull, bound, w)
        now, step = value(w), 1.0
        while value(w + step * (u - w)) > now and step > 1e-4:
            step /= 2
        w = w + step * (u - w)
        if off_optimum(a, y, w, penalty) <= SLACK * penalty:
            break
    return w


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _coordinates(gram: np.ndarray, pull: np.ndarray, bound: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The u with the least u' gram u / 2 - pull' u + sum of bound |u|: sweeps over all coordinates, and over those in use in between."""
    u, rest = start.copy(), pull - gram @ start
    for sweep in range(400):
        moved = 0.0
        for j in range(len(u)) if sweep % 10 == 0 else np.flatnonzero(u).tolist():
            x = rest[j] + gram[j, j] * u[j]
            new = math.copysign(max(abs(x) - bound[j], 0.0), x) / gram[j, j]
            if new != u[j]:
                moved = max(moved, abs(new - u[j]) * gram[j, j])
                rest -= gram[:, j] * (new - u[j])
                u[j] = new
        if moved < 1e-3 * max(bound[-1], 1e-9):
            if sweep % 10 == 0:
                break
    return u


def off_optimum(a: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> float:
    """How far the conditions of the optimum are missed: a slope of 0 for the intercept, of -penalty * sign for weights, of at most the penalty
    for weights of 0."""
    g = a.T @ (_sigmoid(a @ w) - y) / len(y)
    slopes = np.where(w[1:] != 0, np.abs(g[1:] + penalty * np.sign(w[1:])), np.maximum(np.abs(g[1:]) - penalty, 0))
    return float(max(abs(g[0]), slopes.max(initial=0.0)))


def fit(x: dict[str, np.ndarray], y: np.ndarray) -> RuleModel:
    """The model of the penalty with the least loss on every fifth row, fitted again on all.  Without rows: 0.5; with one
    class: its share, smoothed."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    rules = tree_rules(x, y) if 0 < y.sum() < len(y) else []
    columns: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in rules:  # of rules that hold for the same rows, the shortest
        h = rule.holds(x)
        if 0 < h.sum() < len(h):
            columns.setdefault(min(np.packbits(h).tobytes(), np.packbits(~h).tobytes()), (rule, h))
    if not columns:
        return RuleModel(float(math.log(prior / (1 - prior))), (), ())
    rules, h = [r for r, _ in columns.values()], np.stack([h for _, h in columns.values()], 1).astype(np.float32)
    test = np.arange(len(y)) % 5 == 4
    most = float(np.abs(h.T @ (y - y.mean())).max() / len(y))
    losses, w = [], None
    for p in PENALTIES:
        w = lasso(h[~test], y[~test], p * most, w)
        q = np.clip(_sigmoid(w[0] + h[test] @ w[1:]), 1e-9, 1 - 1e-9)
        losses.append(float(-np.mean(y[test] * np.log(q) + (1 - y[test]) * np.log(1 - q))) if test.any() else 0.0)
    w = lasso(h, y, PENALTIES[int(np.argmin(losses))] * most, w)
    kept = [k for k in range(len(rules)) if abs(w[k + 1]) > 1e-6]
    return RuleModel(float(w[0]), tuple(rules[k] for k in kept), tuple(float(w[k + 1]) for k in kept))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_docs: int = MAX_TRAIN_DOCS) -> RuleModel:
    """A model of label_col (0 or 1).  Null labels and labels without a document teach nothing; of several labels of a
    document the mean counts, 0.5 as 1."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    marked = marked.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    share = max_train_docs / max(1, marked.count())
    sample = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = id_and_text(docs, id_col, text_col).join(hinted(sample, 2 * max_train_docs, 32), "doc_id")  # about max_train_docs ids
    table = rows.select("y", *[c.alias(f) for f, c in statistics(F.col("text")).items()]).toPandas()
    table = table.sort_values(list(table.columns), ignore_index=True)
    table = table.iloc[np.random.default_rng(0).permutation(len(table))]
    return fit({f: table[f].to_numpy(float) for f in table.columns if f != "y"}, table["y"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    Null text: as empty, scored by its statistics of 0.  Null ids and repeated rows: scored like any
    other.  Very long texts: read whole.  Empty table: no rows.  Further columns are ignored.
    """
    stats = id_and_text(docs, id_col, text_col).select("doc_id", *[c.alias(f) for f, c in statistics(F.col("text")).items()])
    scored = stats.select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = id_remainder(F.col("doc_id"), 3) == 1
    return score(docs, train(docs, labels.filter(~out))).select("doc_id", out.alias("held_out"), "score", "predicted")
