"""Regression trees grown level by level, all bags at once.

A level is one plan: statistics of the open nodes, best splits, routing.  The state is a row for each training row, with its features once and a list of
its items, one for each bag and node that holds it: (slot, coef, resp), a slot being the number of a node on its level.  Routing rewrites the lists
within their rows; neither rows nor features move, and what is written a level grows with rows x (features + bags), not with their product.

Nodes, state and splits stay tables, written once a level, so that plans don't grow with depth and a lost executor costs one level.  A level's cuts
(CUTS at most) come to the driver and go to the rows as constant arrays; with more of them, items meet their cuts in a join and are gathered by row
again.

Node table: bag, node_id (the path as text: the root is 1, the children of i are i with 0 or 1 behind it, which is heap order in
binary at any depth), depth, n, v, s, attr, border, missing_l, entropy (of attr in the
node), value.  Inner nodes have an attr, leaves a value.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import leaf_share
from ..plans.storage import discard, numbered, stored
from ..sources.tables import long_form
from . import splits
from .predict import left_share, literal_array

KEYS = ["bag", "node_id"]
#: Nodes that are split on a level and come to the driver for it.
CUTS = 50_000
ITEM = "array<struct<slot:long,coef:double,resp:double>>"


def grow(rows: DataFrame, items: DataFrame, features: list[str], alpha: float = 0.0, booleans: list[str] | None = None, max_depth: int | None = None, with_entropy: bool = False, without: dict[int, str] | None = None) -> DataFrame:
    """Node table.  rows: row_no and features; items: (bag, row_no, coef, resp), the bag's items and their weights; bag is a whole number.  without: a feature that a bag's
    tree may not split by."""
    lists = items.groupBy("row_no").agg(F.collect_list(F.struct(F.col("bag").cast("long").alias("slot"), F.col("coef").cast("double").alias("coef"), F.col("resp").cast("double").alias("resp"))).alias("items"))
    state = stored(rows.select("row_no", *[F.col(f).cast("double").alias(f) for f in features]).join(lists, "row_no"))
    sizes = state.select(F.explode("items.slot").alias("slot")).groupBy("slot").count().collect()  # one number a bag
    nodes = grow_state(state, {r["slot"]: r["count"] for r in sizes}, features, state.count(), alpha, booleans, max_depth, with_entropy, without=without)
    discard(state)
    return nodes


def grow_state(state: DataFrame, sizes: dict[int, int], features: list[str], rows: int, alpha: float = 0.0, booleans: list[str] | None = None, max_depth: int | None = None, with_entropy: bool = False, cuts: int = CUTS, without: dict[int, str] | None = None) -> DataFrame:
    """grow from (row_no, features, items), whose slots are bags of the given sizes; ``rows`` bounds its rows."""
    features, first, done, spark = list(features), state, [], state.sparkSession
    names = spark.createDataFrame([(b, b, "1") for b in sorted(sizes)], "slot long, bag long, node_id string")
    for depth in count():
        ends = max_depth is not None and depth >= max_depth
        each = state.select(F.inline("items"), *features)
        stats = splits.node_stats(each, ["slot"]).join(names, "slot")
        by_bag = lambda values: F.get(literal_array([values.get(b) for b in range(max(sizes, default=0) + 1)], "double"), F.col("bag").cast("int"))
        shares = {b: leaf_share(alpha, n, depth) for b, n in sizes.items()}
        small = F.coalesce(F.col("n") / by_bag(sizes) < by_bag(shares), F.lit(False)) if alpha > 0 else F.lit(False)
        level = stats.withColumn("open", ~small & ~F.col("pure") & F.lit(not ends))
        if not ends:
            block = splits.blocks(long_form(each, ["slot", "coef", "resp"], features), ["slot"])
            if without:
                barred = names.join(spark.createDataFrame(sorted(without.items()), "bag long, attr string"), "bag").select("slot", "attr")
                block = block.join(barred, ["slot", "attr"], "left_anti")
            best = splits.best_splits(splits.candidates(block, ["slot"], booleans, rows), ["slot"])
            best = best.join(splits.block_entropy(block, ["slot"]), ["slot", "attr"], "left") if with_entropy else best.withColumn("entropy", F.lit(None).cast("double"))
            level = level.join(best.withColumn("open", F.lit(True)), ["slot", "open"], "left")
        else:
            level = level.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("attr", "string"), ("border", "double"), ("missing_l", "double"), ("entropy", "double"))])
        level = stored(level.select("slot", *KEYS, F.lit(depth).alias("depth"), "n", "v", "s", "attr", "border", "missing_l", "entropy", F.when(F.col("attr").isNull(), F.coalesce(F.try_divide("s", "v"), F.lit(0.0))).alias("value")))
        done.append(level.drop("slot"))
        if ends:
            break
        cut = level.filter("attr IS NOT NULL").select("slot", *KEYS, "attr", "border", "missing_l")
        few = cut.limit(cuts + 1).collect()
        if not few:
            break
        if len(few) <= cuts:
            few.sort(key=lambda r: (r["bag"], r["node_id"]))
            names = spark.createDataFrame([(2 * k + side, r["bag"], f"{r['node_id']}{side}") for k, r in enumerate(few) for side in (0, 1)], names.schema)
            moved = _routed(state, few, features)
        else:
            cut = stored(numbered(cut, *KEYS, name="k"))
            names = cut.select("k", *KEYS, F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select((2 * F.col("k") + F.col("side")).alias("slot"), "bag", F.concat("node_id", F.col("side").cast("string")).alias("node_id"))
            moved = _joined(state, cut, features)
        last = max_depth is not None and depth + 1 == max_depth  # its statistics alone are read, once
        later = moved if last else stored(moved)
        if state is not first and not last:
            discard(state)
        state = later
    return reduce(DataFrame.unionByName, done)


def _routed(state: DataFrame, cuts: list, features: list[str]) -> DataFrame:
    """state with its items in the children's slots, 2 k and 2 k + 1 for the k-th cut; items of other nodes leave."""
    number, by = {f: k for k, f in enumerate(features)}, {r["slot"]: (k, r) for k, r in enumerate(cuts)}
    at = [by.get(slot) for slot in range(max(by) + 1)]
    column = lambda f: [None if x is None else f(*x) for x in at]
    place, attr = literal_array(column(lambda k, _: 2 * k), "long"), literal_array(column(lambda _, r: number[r["attr"]]), "int")
    border, missing_l = literal_array(column(lambda _, r: r["border"]), "double"), literal_array(column(lambda _, r: r["missing_l"]), "double")
    x = F.array(*[F.col(f) for f in features])

    def ways(item):
        slot = item["slot"].cast("int")
        left = left_share(F.get(x, F.get(attr, slot)), F.get(border, slot), F.get(missing_l, slot))
        way = lambda side, part: F.struct((F.get(place, slot) + side).alias("slot"), (item["coef"] * part).alias("coef"), item["resp"].alias("resp"))
        return F.filter(F.array(way(0, left), way(1, 1.0 - left)), lambda w: w["slot"].isNotNull() & (w["coef"] > 1e-12))

    return state.withColumn("items", F.flatten(F.transform("items", ways)).cast(ITEM)).filter(F.size("items") > 0)


def _joined(state: DataFrame, cut: DataFrame, features: list[str]) -> DataFrame:
    """_routed with cuts as a table (slot, k, attr, border, missing_l): items go to their cuts and come back to their rows."""
    each = state.select("row_no", *features, F.inline("items")).join(cut.select("slot", "k", "attr", "border", "missing_l"), "slot")
    value = F.coalesce(*[F.when(F.col("attr") == f, F.col(f)) for f in features])
    moved = splits.route(each, value, F.col("border"), F.col("missing_l")).select("row_no", F.struct((2 * F.col("k") + F.col("side")).alias("slot"), "coef", "resp").alias("item"))
    return state.drop("items").join(moved.groupBy("row_no").agg(F.collect_list("item").alias("items")), "row_no")
