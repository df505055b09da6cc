"""Errors, areas under ROC curves, bagging curves and what they recommend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_two_digits, tree_count, tree_count_steps
from .prefix import running


class RocError(ValueError):
    pass


def weighted_std(df: DataFrame, target: str = "y", weight: str = "w") -> DataFrame:
    """Population standard deviation of the target by weight, in two passes; null where the weights add up to 0."""
    mean = df.agg(F.try_divide(F.sum(F.col(weight) * F.col(target)), F.sum(weight)).alias("m")).first()["m"]
    return df.agg(F.sqrt(F.try_divide(F.sum(F.col(weight) * F.pow(F.col(target) - F.lit(mean).cast("double"), 2)), F.sum(weight))).alias("std"))


def error(pred: str = "pred", target: str = "y"):
    """pred - target, 0 where they differ by rounding only (a share below 1e-10)."""
    p, y = F.col(pred).cast("double"), F.col(target).cast("double")
    base = F.greatest(F.abs(p), F.abs(y))
    return F.when((base == 0) | (F.abs(p - y) < F.lit(1e-10) * base), F.lit(0.0)).otherwise(p - y)


def rmse(df: DataFrame, by: list[str] = (), pred: str = "pred", target: str = "y", weight: str = "w") -> DataFrame:
    """(by…, rmse); null where the weights add up to 0."""
    e = error(pred, target)
    return df.groupBy(*by).agg(F.sqrt(F.try_divide(F.sum(F.col(weight) * e * e), F.sum(weight))).alias("rmse"))


def roc_auc(df: DataFrame, by: list[str] = (), pred: str = "pred", target: str = "y", weight: str = "w") -> DataFrame:
    """(by…, auc): weighted, labels in [0, 1]; ties share their mean label; null where a group's labels are all 0 or all 1.  Tied scores are one
    row before any sum, and sums run in two levels."""
    by = list(by)
    w, y = F.col(weight).cast("double"), F.col(target).cast("double")
    ties = df.groupBy(*by, F.col(pred).cast("double").alias("_p")).agg(F.sum(w * y).alias("pos"), F.sum(w * (1 - y)).alias("neg"))
    t = running(ties, by, "_p", ["pos", "neg"])
    above = F.col("pos_all") - F.col("pos_before") - F.col("pos")
    return t.groupBy(*by).agg(F.try_divide(F.sum(F.col("neg") * (above + F.col("pos") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def check_labels(df: DataFrame, target: str = "y") -> None:
    """A label outside [0, 1], or all labels 0, or all 1, are errors."""
    low, high = df.agg(F.min(target), F.max(target)).first()
    if low is None or low < 0 or high > 1:
        raise RocError("labels outside 0 to 1")
    if low == high and low in (0, 1):
        raise RocError("all labels are equal")


def label_faults(df: DataFrame, by: list[str] = (), target: str = "y") -> DataFrame:
    """(by…, outside, single): whether labels lie outside [0, 1], and whether all are 0 or all are 1; what check_labels tells of a whole table."""
    low, high = F.min(target), F.max(target)
    return df.groupBy(*by).agg(((low < 0) | (high > 1)).alias("outside"), ((low == high) & low.isin(0, 1)).alias("single"))


def running_predictions(per_bag: DataFrame) -> DataFrame:
    """(row_no, bag, pred): the mean of the bags so far."""
    w = Window.partitionBy("row_no").orderBy("bag").rowsBetween(Window.unboundedPreceding, 0)
    return per_bag.select("row_no", "bag", F.avg("pred").over(w).alias("pred"))


def bagging_curve(per_bag: DataFrame, truth: DataFrame, metric: str = "rmse") -> DataFrame:
    """(bag, rmse or auc) of the mean of the bags so far; truth: row_no, y, w."""
    both = running_predictions(per_bag).join(truth, "row_no")
    return rmse(both, ["bag"]) if metric == "rmse" else roc_auc(both, ["bag"])


def needs_more_bags(curve: DataFrame, value: str = "rmse", order: str = "bag") -> DataFrame:
    """(more): no more bags are needed if over the last 20 the spread is below 1 / 500 and the gain below 1 / 1000."""
    c = curve.select(F.row_number().over(Window.orderBy(F.col(order).desc())).alias("k"), F.col(value).alias("v"))  # a number a bag
    last = F.col("k") <= 20
    g = c.agg(F.count("*").alias("n"), F.min(F.when(last, F.col("v"))).alias("best"), F.max(F.when(last, F.col("v"))).alias("worst"), F.max(F.when(F.col("k") == 21, F.col("v"))).alias("then"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("now"))
    flat = (F.col("worst") <= F.col("best")) | (F.col("worst") > 500 * (F.col("worst") - F.col("best")))
    still = (F.col("then") <= F.col("now")) | (F.col("then") > 1000 * (F.col("then") - F.col("now")))
    return g.select(((F.col("n") <= 20) | ~(flat & still)).alias("more"))


def curve_needs_more(values: list[float]) -> bool:
    """needs_more_bags of a list on the driver."""
    if len(values) <= 20:
        return True
    last, then, now = values[-20:], values[-21], values[-1]
    best, worst = min(last), max(last)
    flat = worst <= best or worst > 500 * (worst - best)
    still = then <= now or then > 1000 * (then - now)
    return not (flat and still)


def next_bags(bags: int) -> int:
    return round_two_digits(int(bags * 1.5 + 0.5))


def surface_pivot(cells: DataFrame, value: str = "perf") -> DataFrame:
    """A row for each number of trees, a column for each alpha_no."""
    alphas = sorted(r[0] for r in cells.select("alpha_no").distinct().collect())
    wide = cells.groupBy("tig_no").pivot("alpha_no", alphas).agg(F.first(value))
    return wide.select("tig_no", *[F.col(str(a)).alias(f"a{a}") for a in alphas])


def best_cell(cells: DataFrame, rms: bool = True) -> DataFrame:
    """The cell with the best perf; of equals the simpler by 2 ** alpha_no * n."""
    size = F.pow(F.lit(2.0), F.col("alpha_no")) * F.col("n")
    order = Window.orderBy(F.col("perf") if rms else -F.col("perf"), size)
    return cells.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def repeat_stats(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean and population standard deviation of repeated runs."""
    return runs.groupBy(*by).agg(F.avg("perf").alias("mean"), F.stddev_pop("perf").alias("std"))


def direction_table(cells: DataFrame) -> DataFrame:
    """Share of bags in which a cell grew from the one with fewer trees."""
    return cells.groupBy("tig_no", "alpha_no").agg(F.avg(F.col("from_below").cast("double")).alias("share"))


def interaction_cell(surface: list[list[float]], rms: bool = True) -> tuple[int, int, bool]:
    """(tig_no, alpha_no, fits) for interaction detection, from surface[tig_no][alpha_no].  A cell underfits while each step to it, along
    its row and along its column from the first, improved.  Groves of 6 trees or more are wanted (index 4), of 8 or more (5) unless
    they lose 0.7 % against all of 6 or more."""
    better = (lambda a, b: a < b) if rms else (lambda a, b: a > b)
    tigs, alphas = len(surface), len(surface[0])
    fit = [[all(better(surface[t][a], surface[t][a - 1]) for a in range(1, x + 1)) and all(better(surface[b][x], surface[b - 1][x]) for b in range(1, t + 1)) for x in range(alphas)] for t in range(tigs)]

    def best_from(first: int) -> tuple[float, int]:
        best = (surface[first][0], first)
        for a in range(alphas):
            for t in range(first, tigs):
                if fit[t][a] and better(surface[t][a], best[0]):
                    best = (surface[t][a], t)
        return best

    if tigs < 6:
        tig = tigs - 1
    elif not fit[5][0]:
        tig = 4
    else:
        tig = best_from(0)[1]
        if tig < 4:
            tig = best_from(4)[1]
        elif tig == 4:
            (p6, t6), (p8, t8) = best_from(4), best_from(5)
            loss = (p8 - p6) / p8 if rms else (p6 - p8) / (1 - p8)
            tig = t8 if loss < 0.007 else t6
    alpha = next((a for a in range(alphas) if not fit[tig][a]), alphas) - 1
    alpha = max(alpha, 0)
    return tig, alpha, fit[tig][alpha]


def recommendation(best: dict, curves: dict[tuple[int, int], list[float]], train: dict, rms: bool = True, fits: bool = True) -> dict:
    """What to do next.  best: perf, alpha, n, tig_no, alpha_no; curves: by (tig_no, alpha_no); train: min_alpha, max_n, bags, mode, rows.
    Either {"action": "save", alpha, n} or {"action": "expand"} with those of alpha, n, bags that should change."""
    tigs, alphas = 1 + max(t for t, _ in curves), 1 + max(a for _, a in curves)
    beyond = (min(best["tig_no"] + 1, tigs - 1), min(best["alpha_no"] + 1, alphas - 1))
    bagging = curve_needs_more(curves[best["tig_no"], best["alpha_no"]]) or curve_needs_more(curves[beyond])
    edge_alpha = best["alpha"] == train["min_alpha"] and fits and train["min_alpha"] != 0
    thin = train["mode"] == "layered" and train["max_n"] < 6
    edge_n = best["n"] == train["max_n"] and fits
    if best["perf"] == (0 if rms else 1) or not (edge_alpha or edge_n or bagging or thin):
        return {"action": "save", "alpha": best["alpha"], "n": best["n"]}
    out: dict = {"action": "expand"}
    if edge_alpha:
        alpha = train["min_alpha"] * 0.1
        out["alpha"] = 0.0 if 1.0 / train["rows"] >= alpha else alpha
    if edge_n or thin:
        out["n"] = tree_count(tree_count_steps(train["max_n"]))
    if bagging:
        out["bags"] = next_bags(train["bags"])
    return out


def below_baseline(perf: DataFrame, std: DataFrame, by: list[str], rms: bool = True) -> DataFrame:
    """(by…, perf, std, below): groups that predict worse than their targets' mean does, or than chance."""
    below = F.col("perf") > F.col("std") if rms else F.col("perf") < 0.5
    return perf.join(std, list(by)).select(*by, "perf", "std", below.alias("below"))


def worse_than_baseline(perf: float, std: float, rms: bool = True) -> bool:
    return perf > std if rms else perf < 0.5
