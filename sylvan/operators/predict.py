"""Scoring rows with node tables: by joins, by one column, or by a recursive query."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import stored

TREE = ["bag", "tree"]


def with_tree(nodes: DataFrame) -> DataFrame:
    return nodes if "tree" in nodes.columns else nodes.withColumn("tree", F.lit(0))


#: Nodes of a model that is shipped to workers (about 100 bytes each); larger ones stay a table.
SHIPPED_NODES = 200_000
SCORED = 50_000


def tree_predictions(rows: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """(row_no, bag, tree, pred): the answer of every tree.  A model of at most SHIPPED_NODES nodes goes to the rows, in one pass over them;
    of a larger one the tops of the trees do, and the rows meet the parts below in a join."""
    nodes = with_tree(nodes).select(F.col("bag").cast("long").alias("bag"), F.col("tree").cast("int").alias("tree"), "node_id", "attr", "border", "missing_l", "value")
    if nodes.count() > SHIPPED_NODES:
        return cut_predictions(rows, nodes, features)
    from .kernel import Tree

    names, groups = list(features), {}
    for r in nodes.collect():  # SHIPPED_NODES at most
        groups.setdefault((r["bag"], r["tree"]), []).append((r["node_id"], r["attr"], r["border"], r["missing_l"], r["value"]))
    model = rows.sparkSession.sparkContext.broadcast([(*key, Tree.of_nodes(groups[key], names)) for key in sorted(groups)])
    fields = [("row_no", pa.int64()), ("bag", pa.int64()), ("tree", pa.int32()), ("pred", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, SCORED // max(1, len(model.value)))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(names))], 1) if names else np.zeros((batch.num_rows, 0))
                for bag, tree, t in model.value:
                    n = batch.num_rows
                    columns = [batch.column(0).cast(pa.int64()), pa.array(np.full(n, bag)), pa.array(np.full(n, tree, np.int32)), pa.array(t.predict(x))]
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    x = rows.select("row_no", *[F.col(f).cast("double").alias(f) for f in names])
    return x.mapInArrow(run, "row_no long, bag long, tree int, pred double")


def walked_predictions(rows: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """tree_predictions by joins: each row goes down every tree at once, a level a join, with its share on every path that a
    missing value opens."""
    nodes = with_tree(nodes).select(*TREE, "node_id", "attr", "border", "missing_l", "value")
    x = rows.select("row_no", *[F.col(f).cast("double").alias(f) for f in features])
    trees = sorted(tuple(r) for r in nodes.select(*TREE).distinct().collect())  # the model's list of trees
    which = F.array(*[F.struct(F.lit(b).cast(nodes.schema["bag"].dataType).alias("bag"), F.lit(t).cast(nodes.schema["tree"].dataType).alias("tree")) for b, t in trees])
    paths = x.select("row_no", F.explode(which).alias("of")).select("row_no", "of.*", F.lit("1").alias("node_id"), F.lit(1.0).alias("share"))
    out = []
    while True:
        met = stored(paths.join(nodes, [*TREE, "node_id"]))
        out.append(met.filter("attr IS NULL").select("row_no", *TREE, (F.col("share") * F.col("value")).alias("part")))
        inner = met.filter("attr IS NOT NULL")
        if inner.isEmpty():
            break
        moving = inner.join(x, "row_no")
        value = F.coalesce(*[F.when(F.col("attr") == f, F.col(f)) for f in features])
        left = F.when(F.col("border").isNull(), F.when(value.isNull(), 0.0).otherwise(1.0)).when(value.isNull(), F.col("missing_l")).when(value <= F.col("border"), 1.0).otherwise(0.0)
        ways = F.array(F.struct(F.lit(0).alias("side"), left.alias("part")), F.struct(F.lit(1).alias("side"), (1.0 - left).alias("part")))
        paths = moving.select("row_no", *TREE, "node_id", "share", F.explode(ways).alias("way")).filter("way.part > 0").select("row_no", *TREE, F.concat("node_id", F.col("way.side").cast("string")).alias("node_id"), (F.col("share") * F.col("way.part")).alias("share"))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.groupBy("row_no", *TREE).agg(F.sum("part").alias("pred"))


def grove_predictions(per_tree: DataFrame) -> DataFrame:
    """(row_no, pred): trees of a bag add up, bags are averaged."""
    return per_tree.groupBy("row_no", "bag").agg(F.sum("pred").alias("pred")).groupBy("row_no").agg(F.avg("pred").alias("pred"))


def literal_array(values: Iterable, kind: str) -> Column:
    """A constant array of numbers (None: null): one text, that Spark splits once, when it plans."""
    return F.split(F.lit(",".join("" if v is None else repr(v) for v in values)), ",").try_cast(f"array<{kind}>")


def node_arrays(nodes: Iterable[dict], number: dict[str, int]) -> tuple[list[int], dict[str, list]]:
    """(places of roots, columns) of the nodes of several trees (``of`` tells them apart): attr as its number (leaves: -1), border (missing apart: null), missing_l, value, and
    the place of the left child; the right one is next to it.  Children stand together, and parents before them."""
    trees: dict = {}
    for n in nodes:
        trees.setdefault(n["of"], {})[n["node_id"]] = n
    order = [(of, "1") for of in sorted(trees)]
    roots = list(range(len(order)))
    columns: dict[str, list] = {"attr": [], "border": [], "missing_l": [], "value": [], "left": []}
    for of, i in order:  # grows as it goes
        n = trees[of][i]
        leaf = n["attr"] is None
        columns["attr"].append(-1 if leaf else number[n["attr"]])
        columns["border"].append(None if leaf or n["border"] is None else float(n["border"]))
        columns["missing_l"].append(0.0 if leaf else float(n["missing_l"]))
        columns["value"].append(float(n["value"]) if leaf else 0.0)
        columns["left"].append(-1 if leaf else len(order))
        if not leaf:
            order += [(of, i + "0"), (of, i + "1")]
    return roots, columns


def left_share(value: Column, border: Column, missing_l: Column) -> Column:
    """The share of an item that goes left: all or nothing, or missing_l of one whose value is missing; without a border, what is present."""
    return F.when(border.isNull(), value.isNotNull().cast("double")).when(value.isNull(), missing_l).otherwise((value <= border).cast("double"))


def walked(start: Column, depth: Column, x: Column, attr: Column, border: Column, missing_l: Column, left: Column) -> Column:
    """Where an item (array of (node, share)) ends up, ``depth`` levels further down at most, in trees given as node_arrays."""

    def step(at: Column) -> Column:
        k = at["node"]
        share = left_share(F.get(x, F.get(attr, k)), F.get(border, k), F.get(missing_l, k))
        way = lambda shift, part: F.struct((F.get(left, k) + shift).alias("node"), (at["share"] * part).alias("share"))
        both = F.filter(F.array(way(0, share), way(1, 1.0 - share)), lambda w: w["share"] > 0)
        return F.when(F.get(attr, k) < 0, F.array(at)).otherwise(both)

    levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, start, lambda now, _: F.flatten(F.transform(now, step)))


def cut_predictions(rows: DataFrame, nodes: DataFrame, features: list[str], shipped: int = SHIPPED_NODES) -> DataFrame:
    """tree_predictions of a model that is too large to ship: trees are cut at the depth to which their tops have ``shipped`` nodes together.  Tops go to the rows as constant arrays; what a
    row leaves them by is joined once with the parts below, a row each with its nodes in arrays, and walked there.  Two exchanges at any depth."""
    nodes = with_tree(nodes).select(F.col("bag").cast("long").alias("bag"), F.col("tree").cast("int").alias("tree"), "node_id", "attr", "border", "missing_l", "value")
    top, depth = 0, 0
    for r in nodes.groupBy(F.length("node_id").alias("n")).count().orderBy("n").collect():  # a number a level
        top, deepest = top + r["count"], r["n"]
        if top <= shipped:
            depth = deepest
    if not depth:  # more trees than that
        return walked_predictions(rows, nodes, features)
    number, above = {f: k for k, f in enumerate(features)}, []
    for r in nodes.filter(F.length("node_id") <= depth).collect():
        above.append(r.asDict() | {"of": (r["bag"], r["tree"])})
        if r["attr"] is not None and len(r["node_id"]) == depth:
            above += [{"of": (r["bag"], r["tree"]), "node_id": r["node_id"] + side, "attr": None, "value": 0.0, "below": True} for side in "01"]
    order = sorted({n["of"] for n in above})
    roots, columns = node_arrays(above, number)
    place: dict[tuple, int] = {(of, "1"): k for k, of in enumerate(order)}
    for of, i in list(place):
        todo = [(of, i)]
        while todo:
            t, j = todo.pop()
            if (k := columns["left"][place[t, j]]) >= 0:
                place[t, j + "0"], place[t, j + "1"] = k, k + 1
                todo += [(t, j + "0"), (t, j + "1")]
    spark = rows.sparkSession
    where = spark.createDataFrame([(k, *t, i if (below := len(i) > depth) else None, None if below else columns["value"][k]) for (t, i), k in place.items() if columns["attr"][k] < 0], "node int, bag long, tree int, part string, value double")
    x = F.array(*[F.col(f).cast("double") for f in features])
    start = F.transform(F.lit(roots).cast("array<int>"), lambda k: F.struct(k.alias("node"), F.lit(1.0).alias("share")))
    arrays = [literal_array(columns[c], "int" if c in ("attr", "left") else "double") for c in ("attr", "border", "missing_l", "left")]
    ends = rows.select("row_no", x.alias("x")).select("row_no", "x", F.inline(walked(start, F.lit(depth), F.col("x"), *arrays))).join(where, "node")
    done = ends.filter("part IS NULL").select("row_no", "bag", "tree", (F.col("share") * F.col("value")).alias("pred"))

    kinds = {"attr": pa.list_(pa.int32()), "border": pa.list_(pa.float64()), "missing_l": pa.list_(pa.float64()), "left": pa.list_(pa.int32()), "value": pa.list_(pa.float64())}

    def arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bag, tree, part, lists = (c.to_pylist() for c in b.columns)
            found = [node_arrays([n | {"of": 0, "node_id": "1" + n["node_id"][depth + 1 :]} for n in own], number)[1] for own in lists]
            deep = [max(len(n["node_id"]) for n in own) - depth - 1 for own in lists]
            yield pa.RecordBatch.from_arrays([pa.array(bag, pa.int64()), pa.array(tree, pa.int32()), pa.array(part, pa.string()), pa.array(deep, pa.int32()), *(pa.array([f[c] for f in found], k) for c, k in kinds.items())], ["bag", "tree", "part", "depth", *kinds])

    lower = nodes.filter(F.length("node_id") > depth).groupBy("bag", "tree", F.substring("node_id", 1, depth + 1).alias("part"))
    parts = lower.agg(F.collect_list(F.struct("node_id", "attr", "border", "missing_l", "value")).alias("nodes")).mapInArrow(arranged, "bag long, tree int, part string, depth int, attr array<int>, border array<double>, missing_l array<double>, left array<int>, value array<double>")
    met = ends.filter("part IS NOT NULL").select("row_no", "x", "bag", "tree", "part", "share").join(parts, ["bag", "tree", "part"])
    begin = F.array(F.struct(F.lit(0).alias("node"), F.col("share").alias("share")))
    at = walked(begin, F.col("depth"), F.col("x"), F.col("attr"), F.col("border"), F.col("missing_l"), F.col("left"))
    below = met.select("row_no", "bag", "tree", F.aggregate(at, F.lit(0.0), lambda s, e: s + e["share"] * F.get("value", e["node"])).alias("pred"))
    return done.unionByName(below).groupBy("row_no", "bag", "tree").agg(F.sum("pred").alias("pred"))


def ensemble_expression(nodes: DataFrame) -> Column:
    """The whole model as one column: the sum of a bag's trees, averaged over bags.  Its size is that of the nodes: they are constant arrays, and a row walks
    down all trees at once, with its share on every path that a missing value opens.  The model (SHIPPED_NODES at most), not the data, comes to the driver."""
    rows = [r.asDict() for r in with_tree(nodes).select(*TREE, "node_id", "attr", "border", "missing_l", "value").limit(SHIPPED_NODES + 1).collect()]
    if len(rows) > SHIPPED_NODES:
        raise ValueError(f"a model of more than {SHIPPED_NODES} nodes is no column; tree_predictions takes any")
    if not rows:
        return F.lit(0.0)
    for r in rows:
        r["of"] = r["bag"], r["tree"]
    names = sorted({r["attr"] for r in rows if r["attr"] is not None})
    roots, columns = node_arrays(rows, {a: k for k, a in enumerate(names)})
    attr, left = (literal_array(columns[c], "int") for c in ("attr", "left"))
    border, missing_l, value = (literal_array(columns[c], "double") for c in ("border", "missing_l", "value"))
    x = F.array(*[F.col(f"`{a}`").cast("double") for a in names]) if names else F.array(F.lit(None).cast("double"))
    start = F.transform(F.sequence(F.lit(0), F.lit(len(roots) - 1)), lambda k: F.struct(k.alias("node"), F.lit(1.0).alias("share")))
    ends = walked(start, F.lit(max(len(r["node_id"]) for r in rows) - 1), x, attr, border, missing_l, left)
    bags = len({r["bag"] for r in rows})
    return F.aggregate(ends, F.lit(0.0), lambda s, at: s + at["share"] * F.get(value, at["node"])) / F.lit(float(bags))


def tree_code(nodes: Iterable[dict], name: str = "predict") -> str:
    """A tree as Python functions of a dict of values, one a node; a missing value goes both ways in the node's proportion."""
    lines: list[str] = []
    for n in sorted(nodes, key=lambda n: (-len(n["node_id"]), n["node_id"])):
        i = n["node_id"]
        of = f"{name}_{i}" if i != "1" else name
        if n["attr"] is None:
            lines += [f"def {of}(x):", f"    return {float(n['value'])!r}"]
            continue
        left, right = f"{name}_{i}0(x)", f"{name}_{i}1(x)"
        lines += [f"def {of}(x):", f"    v = x.get({n['attr']!r})"]
        if n["border"] is None:
            lines.append(f"    return {right} if v is None else {left}")
        else:
            p = float(n["missing_l"])
            lines += ["    if v is None:", f"        return {p!r} * {left} + {1 - p!r} * {right}", f"    return {left} if v <= {float(n['border'])!r} else {right}"]
    return "\n".join(lines) + "\n"


RECURSIVE = """
WITH RECURSIVE walk(row_no, x, node_id, share) AS (
  SELECT row_no, x, '1', CAST(1.0 AS DOUBLE) FROM {rows}
  UNION ALL
  SELECT row_no, x, concat(node_id, way.side), share * way.part FROM (
    SELECT row_no, x, node_id, share, explode(filter(array(named_struct('side', '0', 'part', to_left), named_struct('side', '1', 'part', CAST(1.0 AS DOUBLE) - to_left)), e -> e.part > 0)) AS way FROM (
      SELECT w.row_no, w.x, w.node_id, w.share,
             CASE WHEN n.border IS NULL THEN CASE WHEN get(w.x, n.place) IS NULL THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END
                  WHEN get(w.x, n.place) IS NULL THEN n.missing_l
                  WHEN get(w.x, n.place) <= n.border THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS to_left
      FROM walk w JOIN {nodes} n ON n.node_id = w.node_id AND n.attr IS NOT NULL))
)
SELECT w.row_no, sum(w.share * n.value) AS pred
FROM walk w JOIN {nodes} n ON n.node_id = w.node_id AND n.attr IS NULL GROUP BY w.row_no
"""


def recursive_predictions(spark: SparkSession, long_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """recursive_walk of long rows: row_no, attr, val."""
    attrs = sorted(r["attr"] for r in nodes.select("attr").filter("attr IS NOT NULL").distinct().collect())  # the model's features
    wide = long_rows.groupBy("row_no").agg(*[F.max(F.when(F.col("attr") == a, F.col("val"))).alias(f"x{k}") for k, a in enumerate(attrs)])
    named = nodes.withColumn("attr", F.concat(F.lit("x"), (F.array_position(F.lit(attrs), F.col("attr")) - 1).cast("string"))) if attrs else nodes
    return recursive_walk(wide, named, [f"x{k}" for k in range(len(attrs))])


def recursive_walk(rows: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """(row_no, pred) of one tree by a recursive query; rows: row_no and features, which go along as an array, so that a level is a join with the nodes alone.  Lifts
    the session's limits on recursion, which count rows and levels of all queries."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    x = F.array(*[F.col(f).cast("double") for f in features]) if features else F.array(F.lit(None).cast("double"))
    place = (F.array_position(F.lit(list(features)), F.col("attr")) - 1).cast("int") if features else F.lit(None).cast("int")
    return spark.sql(RECURSIVE, rows=rows.select("row_no", x.alias("x")), nodes=nodes.select("node_id", "attr", place.alias("place"), "border", "missing_l", "value"))


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A file on any file system that Spark knows."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_model(nodes: DataFrame, path: str, alpha: float, trees: int, mode: int = 0, directions: list[bool] | None = None, attrs: list[str] = ()) -> None:
    """One file: int32 mode, in mode 1 int32 count and that many bytes of directions, int32 trees, double alpha, then all trees in
    preorder: a byte 1 and a double for a leaf; a byte 0, int32 attribute, double border (NaN: missing apart), double missing_l for an inner node."""
    number = {a: k for k, a in enumerate(attrs)}
    groups: dict[tuple, dict] = {}
    for r in with_tree(nodes).collect():
        groups.setdefault((r["bag"], r["tree"]), {})[r["node_id"]] = r
    out = [struct.pack("<i", mode)]
    if mode == 1:
        flags = directions or []
        out.append(struct.pack("<i", len(flags)) + bytes(flags))
    out.append(struct.pack("<id", trees, alpha))
    for key in sorted(groups):
        stack = ["1"]
        while stack:
            i = stack.pop()
            n = groups[key][i]
            if n["attr"] is None:
                out.append(struct.pack("<?d", True, n["value"]))
            else:
                out.append(struct.pack("<?idd", False, number[n["attr"]], float("nan") if n["border"] is None else n["border"], n["missing_l"]))
                stack += [i + "1", i + "0"]
    _put(nodes.sparkSession, path, b"".join(out))


def read_model(spark: SparkSession, path: str, attrs: list[str]) -> tuple[dict, DataFrame]:
    """(header, node table) of a file of write_model."""
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    (mode,), at = struct.unpack_from("<i", data), 4
    header: dict = {"mode": mode, "directions": []}
    if mode == 1:
        (n,) = struct.unpack_from("<i", data, at)
        header["directions"], at = [bool(b) for b in data[at + 4 : at + 4 + n]], at + 4 + n
    header["trees"], header["alpha"] = struct.unpack_from("<id", data, at)
    at += 12
    rows, k = [], 0
    while at < len(data):
        stack = ["1"]
        while stack:
            i = stack.pop()
            if data[at]:
                rows.append((k // header["trees"], k % header["trees"], i, None, None, None, struct.unpack_from("<d", data, at + 1)[0]))
                at += 9
            else:
                a, border, p = struct.unpack_from("<idd", data, at + 1)
                rows.append((k // header["trees"], k % header["trees"], i, attrs[a], None if border != border else border, p, None))
                at += 21
                stack += [i + "1", i + "0"]
        k += 1
    return header, spark.createDataFrame(rows, "bag long, tree int, node_id string, attr string, border double, missing_l double, value double")
