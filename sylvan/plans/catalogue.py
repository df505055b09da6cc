"""Named queries over the driver's tables and their SQL for DuckDB."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import effects, ensemble, features, grid, kernel, metrics, predict, sampling, splits, tree
from ..sources import tables
from ..sources.schema import parse_schema
from . import oracles as sql
from .storage import new_path, numbered, stored
from .views import BOOLEANS, FEATURES, embeddings, oracle_view, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BAGS = 3


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- sources and metrics


@query(f"WITH {oracle_view('ord')}, m AS (SELECT sum(w * y) / sum(w) AS m FROM ord) SELECT round(sqrt(sum(w * (y - m) ** 2) / sum(w)), 6) AS std FROM ord, m")
def target_std_weighted(spark, d):
    return metrics.weighted_std(view(spark, d, "ord")).select(*r6("std"))


@query(f"WITH {oracle_view('doc')}, l AS ({sql.long_sql('doc', FEATURES['doc'], 'key')}) SELECT attr, count(*) AS n_missing FROM l WHERE val IS NULL GROUP BY attr")
def missing_profile(spark, d):
    return tables.missing_profile(view(spark, d, "doc"), FEATURES["doc"])


@query(f"WITH {oracle_view('evt')}, l AS ({sql.long_sql('evt', [*BOOLEANS['evt'], 'minute'], 'key')}) SELECT attr, count(*) FILTER (val NOT IN (0, 1)) AS n_bad FROM l GROUP BY attr")
def bool_domain_violations(spark, d):
    return tables.domain_violations(view(spark, d, "evt"), [*BOOLEANS["evt"], "minute"])


@query(f"WITH {oracle_view('doc')} SELECT key, n_chars, row_number() OVER (ORDER BY n_chars ASC NULLS LAST, key) - 1 AS row_no FROM doc")
def sorted_missing_last(spark, d):
    return numbered(view(spark, d, "doc").select("key", "n_chars"), F.col("n_chars").asc_nulls_last(), F.col("key"))


RMSE = "round(sqrt(sum(w * power(CASE WHEN greatest(abs(p), abs(y)) = 0 OR abs(p - y) < 1e-10 * greatest(abs(p), abs(y)) THEN 0 ELSE p - y END, 2)) / sum(w)), 6) AS rmse"


@query(f"WITH {oracle_view('ord')}, x AS (SELECT *, 8 * sum_qty AS p FROM ord) SELECT {RMSE} FROM x")
def rmse_weighted(spark, d):
    return metrics.rmse(view(spark, d, "ord").withColumn("pred", 8 * F.col("sum_qty"))).select(*r6("rmse"))


@query(f"WITH {oracle_view('ord')}, x AS (SELECT *, 8 * sum_qty AS p FROM ord) SELECT priority, {RMSE} FROM x GROUP BY priority")
def rmse_by_group(spark, d):
    return metrics.rmse(view(spark, d, "ord").withColumn("pred", 8 * F.col("sum_qty")), ["priority"]).select("priority", *r6("rmse"))


def _auc(weight: str) -> str:
    return f"""WITH {oracle_view('doc')}, x AS (SELECT floor(coalesce(n_chars, 0) / 500) AS p, y, {weight} AS w FROM doc WHERE y IS NOT NULL),
t AS (SELECT p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM x GROUP BY p),
u AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT round(sum(neg * (before + pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM u"""


def _scored_docs(spark, d, weight):
    x = view(spark, d, "doc").filter("y IS NOT NULL").withColumn("pred", F.floor(F.coalesce("n_chars", F.lit(0.0)) / 500))
    return metrics.roc_auc(x.withColumn("w", weight)).select(*r6("auc"))


@query(_auc("1.0"))
def roc_auc_ties(spark, d):
    return _scored_docs(spark, d, F.lit(1.0))


@query(_auc("w"))
def roc_auc_weighted(spark, d):
    return _scored_docs(spark, d, F.col("w"))


# --- splits


def _items(spark, d, name, weight=None, key=None):
    df = view(spark, d, name)
    return df.select((key if key is not None else F.lit(1)).alias("node"), (weight if weight is not None else F.col("w")).alias("coef"), F.col("y").alias("resp"), *FEATURES[name]).filter("resp IS NOT NULL")


def _found(items, name, attrs=None):
    long = tables.long_form(items, ["node", "coef", "resp"], attrs or FEATURES[name])
    return splits.candidates(splits.blocks(long, ["node"]), ["node"], BOOLEANS[name])


def _shown(best: DataFrame) -> DataFrame:
    return best.select("node", "attr", *r6("border", "missing_l"), F.round("eval", 3).alias("eval"))


@query(sql.split_query("ord", "1.0::DOUBLE"))
def split_root_plain(spark, d):
    return _shown(splits.best_splits(_found(_items(spark, d, "ord", F.lit(1.0)), "ord"), ["node"]))


@query(sql.split_query("ord"))
def split_root_weighted(spark, d):
    return _shown(splits.best_splits(_found(_items(spark, d, "ord"), "ord"), ["node"]))


@query(sql.split_query("doc", where="WHERE y IS NOT NULL"))
def split_root_missing(spark, d):
    return _shown(splits.best_splits(_found(_items(spark, d, "doc"), "doc"), ["node"]))


@query(sql.split_query("evt", attrs=BOOLEANS["evt"], table="cand"))
def split_root_bool(spark, d):
    return _shown(_found(_items(spark, d, "evt"), "evt", BOOLEANS["evt"]))


@query(sql.split_query("doc", where="WHERE y IS NOT NULL", table="cand"))
def split_candidates_missing(spark, d):
    return _shown(_found(_items(spark, d, "doc"), "doc"))


@query(f"""WITH {oracle_view('li')}, items AS (SELECT 1 AS node, w AS coef, floor(y / 20000) AS resp, {', '.join(FEATURES['li'])} FROM li), {sql.split_ctes('', 'items', FEATURES['li'], 'node', [])}
SELECT attr, count(*) AS n_borders FROM cand GROUP BY attr""")
def split_candidates_suppressed(spark, d):
    items = _items(spark, d, "li").withColumn("resp", F.floor(F.col("resp") / 20000).cast("double"))
    return _found(items, "li").groupBy("attr").agg(F.count("*").alias("n_borders"))


@query(sql.split_query("ord", key_sql="priority"))
def split_best_per_group(spark, d):
    return _shown(splits.best_splits(_found(_items(spark, d, "ord", key=F.col("priority")), "ord"), ["node"]))


@query(f"WITH {oracle_view('evt')} SELECT minute AS node, count(*) AS n, sum(w) AS v, sum(w * y) AS s, min(y) = max(y) AS pure FROM evt GROUP BY minute")
def node_stats(spark, d):
    return splits.node_stats(_items(spark, d, "evt", key=F.col("minute")).select("node", "coef", "resp"), ["node"])


@query(f"""WITH {oracle_view('evt')}, l AS ({sql.long_sql('evt', FEATURES['evt'], 'w')}), b AS (SELECT attr, val, sum(w) AS v FROM l GROUP BY attr, val),
p AS (SELECT attr, v / sum(v) OVER (PARTITION BY attr) AS p FROM b) SELECT 1 AS node, attr, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY attr""")
def node_entropy(spark, d):
    long = tables.long_form(_items(spark, d, "evt"), ["node", "coef", "resp"], FEATURES["evt"])
    return splits.entropy(long, ["node"]).select("node", "attr", *r6("entropy"))


@query(f"""WITH {oracle_view('doc')}, x AS (SELECT key, w, CASE WHEN n_chars IS NULL THEN 0.25 WHEN n_chars <= 1000 THEN 1 ELSE 0 END AS l FROM doc)
SELECT key, 0 AS side, w * l AS coef FROM x WHERE w * l > 1e-12 UNION ALL SELECT key, 1, w * (1 - l) FROM x WHERE w * (1 - l) > 1e-12""")
def route_rows_missing(spark, d):
    items = view(spark, d, "doc").select("key", F.col("w").alias("coef"), "n_chars")
    return splits.route(items, F.col("n_chars"), F.lit(1000.0), F.lit(0.25)).select("key", "side", "coef")


# --- trees and ensembles

ORD = FEATURES["ord"]
NUMBERED = "rows AS (SELECT row_number() OVER (ORDER BY key) - 1 AS row_no, * FROM ord)"
WHOLE = f"SELECT 0 AS bag, row_no, w AS coef, y AS resp, {', '.join(ORD)} FROM rows"
BAGGED = f"SELECT bag, row_no, times * w AS coef, y AS resp, {', '.join(ORD)} FROM (SELECT bag, row_no, count(*) AS times FROM draws GROUP BY bag, row_no) JOIN rows USING (row_no)"
ROWS = f"SELECT row_no, {', '.join(ORD)} FROM rows"


def _whole_tree(spark, d, depth=2):
    rows = stored(numbered(view(spark, d, "ord").select("key", "y", "w", *ORD), "key"))
    items = rows.select(F.lit(0).cast("long").alias("bag"), "row_no", F.col("w").alias("coef"), F.col("y").alias("resp"))
    return rows, tree.grow(rows, items, ORD, 0.0, BOOLEANS["ord"], depth)


@query(f"WITH {oracle_view('ord')}, {NUMBERED}, {sql.tree_ctes('ord', WHOLE, 2)} SELECT node_id, depth, n, v, s, attr, round(border, 6) AS border, round(missing_l, 6) AS missing_l, round(value, 6) AS value FROM nodes")
def tree_depth2_nodes(spark, d):
    return _whole_tree(spark, d)[1].select(F.conv("node_id", 2, 10).cast("long").alias("node_id"), "depth", "n", "v", "s", "attr", *r6("border", "missing_l", "value"))


TREE_PRED = f"WITH {oracle_view('ord')}, {NUMBERED}, {sql.tree_ctes('ord', WHOLE, 2)}, {sql.scored('ord', 2, ROWS)} SELECT row_no, round(pred, 6) AS pred FROM pred"


@query(TREE_PRED)
def tree_predict_depth2(spark, d):
    rows, nodes = _whole_tree(spark, d)
    return predict.tree_predictions(rows, nodes, ORD).select("row_no", *r6("pred"))


@query(TREE_PRED)
def tree_predict_case(spark, d):
    rows, nodes = _whole_tree(spark, d)
    return rows.select("row_no", F.round(predict.ensemble_expression(nodes), 6).alias("pred"))


@query(TREE_PRED)
def tree_predict_recursive(spark, d):
    rows, nodes = _whole_tree(spark, d)
    return predict.recursive_walk(rows, nodes, ORD).select("row_no", *r6("pred"))


@query(f"WITH {oracle_view('ord')}, {sql.draws_cte('ord', BAGS)} SELECT bag, count(*) AS n, count(DISTINCT row_no) AS n_distinct, CAST(sum(row_no) AS BIGINT) AS total FROM draws GROUP BY bag")
def bag_draw_counts(spark, d):
    draws = sampling.bootstrap_draws(spark, spark.read.parquet(f"{d}/orders.parquet").count(), BAGS)
    return sampling.in_bag(draws).groupBy("bag").agg(F.sum("times").alias("n"), F.count("*").alias("n_distinct"), F.sum(F.col("times") * F.col("row_no")).alias("total"))


@query(f"WITH {oracle_view('ord')}, {NUMBERED}, {sql.draws_cte('ord', BAGS)} SELECT b.range AS bag, row_no FROM range({BAGS}) b, rows WHERE NOT EXISTS (FROM draws x WHERE x.bag = b.range AND x.row_no = rows.row_no)")
def bag_oob_rows(spark, d):
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    return sampling.out_of_bag(spark.range(n).select(F.col("id").alias("row_no")), sampling.bootstrap_draws(spark, n, BAGS), BAGS)


@query("WITH h AS (SELECT event_id, CAST('0x' || substr(md5('1-' || 0 || '-' || event_id), 1, 8) AS BIGINT) AS h FROM events) SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY h, event_id) AS k FROM h) WHERE k <= 500")
def subsample_norepl(spark, d):
    return sampling.subsample(spark.read.parquet(f"{d}/events.parquet").select("event_id"), "event_id", 500).select("event_id")


def _bagged(spark, d, depth=1):
    rows, draws = _bag_rows(spark, d)
    nodes = tree.grow(rows, ensemble.bag_items(rows, draws), ORD, 0.0, BOOLEANS["ord"], depth, with_entropy=True)
    return rows, draws, stored(nodes)


def _bag_rows(spark, d):
    rows = stored(numbered(view(spark, d, "ord").select("key", "y", "w", *ORD), "key"))
    return rows, sampling.bootstrap_draws(spark, rows.count(), BAGS)


BAG_CTES = f"WITH {oracle_view('ord')}, {NUMBERED}, {sql.draws_cte('ord', BAGS)}, {sql.tree_ctes('ord', BAGGED, 1)}, {sql.scored('ord', 1, ROWS)}"


@query(f"{BAG_CTES} SELECT row_no, round(avg(pred), 6) AS pred FROM pred GROUP BY row_no")
def bagged_stumps_predict(spark, d):
    rows, _, nodes = _bagged(spark, d)
    return ensemble.bagged_predictions(rows, nodes, ORD).select("row_no", *r6("pred"))


@query(f"""{BAG_CTES}, m AS (SELECT row_no, bag, avg(pred) OVER (PARTITION BY row_no ORDER BY bag) AS p FROM pred)
SELECT bag, {RMSE} FROM m JOIN rows USING (row_no) GROUP BY bag""")
def bagging_curve(spark, d):
    rows, _, nodes = _bagged(spark, d)
    per = predict.tree_predictions(rows, nodes, ORD)
    return metrics.bagging_curve(per, rows.select("row_no", "y", "w")).select("bag", *r6("rmse"))


@query(f"{BAG_CTES}, o AS (SELECT row_no, pred FROM pred p WHERE NOT EXISTS (FROM draws x WHERE x.bag = p.bag AND x.row_no = p.row_no)) SELECT row_no, round(avg(pred), 6) AS pred FROM o GROUP BY row_no")
def oob_predictions(spark, d):
    rows, draws, nodes = _bagged(spark, d)
    return ensemble.out_of_bag_predictions(rows, nodes, draws, ORD, BAGS).select("row_no", *r6("pred"))


def _more_oracle(table: str, key: str) -> str:
    return f"""SELECT '{table}' AS curve, n <= 20 OR NOT ((worst <= best OR worst > 500 * (worst - best)) AND (past <= now OR past > 1000 * (past - now))) AS more FROM (
SELECT count(*) AS n, min(v) FILTER (k <= 20) AS best, max(v) FILTER (k <= 20) AS worst, max(v) FILTER (k = 21) AS past, max(v) FILTER (k = 1) AS now
FROM (SELECT 10 + 1.0::DOUBLE / (row_number() OVER (ORDER BY {key})) AS v, row_number() OVER (ORDER BY {key} DESC) AS k FROM {table}))"""


CURVE_TABLES = {"region": "r_regionkey", "nation": "n_nationkey", "orders": "o_orderkey"}


@query(" UNION ALL ".join(_more_oracle(t, k) for t, k in CURVE_TABLES.items()))
def bag_convergence_flag(spark, d):
    """Curves that fall as 1 / k, with as many bags as a table has rows."""
    out = None
    for table, key in CURVE_TABLES.items():
        curve = numbered(spark.read.parquet(f"{d}/{table}.parquet").select(key), key, name="bag").select("bag", (10 + F.lit(1.0) / (F.col("bag") + 1)).alias("rmse"))
        part = metrics.needs_more_bags(curve).select(F.lit(table).alias("curve"), "more")
        out = part if out is None else out.unionByName(part)
    return out


def _gbt_oracle(rounds: int, rate: float) -> str:
    ctes, state = [oracle_view("ord"), NUMBERED], "SELECT row_no, 0.0::DOUBLE AS pred FROM rows"
    for k in range(rounds):
        ctes.append(f"state{k} AS ({state})")
        items = f"SELECT 0 AS bag, row_no, w AS coef, y - pred AS resp, {', '.join(ORD)} FROM rows JOIN state{k} USING (row_no)"
        inner = f"WITH {sql.tree_ctes('ord', items, 1)}, {sql.scored('ord', 1, ROWS)} SELECT row_no, pred FROM pred"
        ctes.append(f"step{k} AS ({inner})")
        state = f"SELECT row_no, s.pred + {rate} * t.pred AS pred FROM state{k} s JOIN step{k} t USING (row_no)"
    return f"WITH {', '.join(ctes)} SELECT row_no, round(pred, 4) AS pred FROM ({state})"


@query(_gbt_oracle(3, 0.5))
def gbt_stumps_3rounds(spark, d):
    _, preds = ensemble.boosted_trees(view(spark, d, "ord"), "key", ORD, 3, 0.5, booleans=BOOLEANS["ord"], max_depth=1, bootstrap=False)
    return preds.select("row_no", F.round("pred", 4).alias("pred"))


SCORES = f"""{BAG_CTES}, used AS (SELECT n.bag, n.attr, n.v FROM nodes n WHERE attr IS NOT NULL),
b AS (SELECT bag, attr, val, sum(coef) AS v FROM long0 GROUP BY bag, attr, val), p AS (SELECT bag, attr, v / sum(v) OVER (PARTITION BY bag, attr) AS p FROM b),
e AS (SELECT bag, attr, sum(-p * log2(p)) AS entropy FROM p GROUP BY bag, attr),
scores AS (SELECT attr, round(sum(v / greatest(1.0::DOUBLE, entropy)) / ((SELECT sum(w) FROM rows) * {BAGS}), 6) AS score FROM used JOIN e USING (bag, attr) GROUP BY attr)"""


@query(f"{SCORES} SELECT attr, score FROM scores")
def feature_scores(spark, d):
    rows, _, nodes = _bagged(spark, d)
    return ensemble.feature_scores(nodes, rows.agg(F.sum("w")).first()[0]).select("attr", *r6("score"))


PART_SCORES = "SELECT CAST(p_partkey AS VARCHAR) AS attr, CAST(floor(p_retailprice) AS DOUBLE) AS score, p_partkey % 7 = 3 AS marked FROM part"


@query(f"""WITH p AS ({PART_SCORES}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, attr) AS place FROM p),
m AS (SELECT *, sum(CASE WHEN marked THEN 1 ELSE 0 END) OVER (ORDER BY place) AS marks FROM r)
SELECT attr, score, CAST(place AS INTEGER) AS place FROM m WHERE place <= 20 OR marked AND marks <= 12""")
def feature_topk_split(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("attr"), F.floor("p_retailprice").cast("double").alias("score"), (F.col("p_partkey") % 7 == 3).alias("marked"))
    return features.top_features(part.select("attr", "score"), 20, part.filter("marked"), 12)


# --- rank correlation, quantiles, effects, densities

CORR = ["acctbal", "avg_disc", "sum_qty"]
RHO = f"""WITH {oracle_view('ord')}, l AS ({sql.long_sql('ord', CORR, 'key')}), r AS (SELECT key, attr, rank() OVER (PARTITION BY attr ORDER BY val) + (count(*) OVER (PARTITION BY attr, val) - 1) / 2.0::DOUBLE AS r FROM l),
p AS (SELECT a.attr AS attr1, b.attr AS attr2, round(1 - 6 * sum((a.r - b.r) ** 2) / (count(*)::DOUBLE * (count(*)::DOUBLE ** 2 - 1)), 6) AS rho FROM r a JOIN r b ON a.key = b.key AND a.attr < b.attr GROUP BY 1, 2)"""


@query(f"{RHO} SELECT * FROM p")
def spearman_pairs(spark, d):
    return features.spearman(view(spark, d, "ord"), "key", CORR).select("attr1", "attr2", *r6("rho"))


@query(f"{RHO}, q AS (SELECT * FROM p UNION ALL SELECT attr2, attr1, rho FROM p UNION ALL SELECT DISTINCT attr, attr, 1 FROM l) SELECT attr1, {', '.join(f'max(rho) FILTER (attr2 = {chr(39)}{a}{chr(39)}) AS {a}' for a in CORR)} FROM q GROUP BY attr1")
def spearman_matrix(spark, d):
    return features.correlation_matrix(features.spearman(view(spark, d, "ord"), "key", CORR)).select("attr1", *r6(*CORR))


def _points(view_name: str, attr: str, q: int) -> str:
    return f"""(SELECT val, count(*) AS n FROM (SELECT {attr} AS val, row_number() OVER (ORDER BY {attr} ASC NULLS LAST) - 1 AS i FROM {view_name}) JOIN
(SELECT CAST(floor((SELECT count(*) - 1 FROM {view_name})::DOUBLE * (range / {q + 1}.0::DOUBLE)) AS BIGINT) AS i FROM range(1, {q + 1})) USING (i) GROUP BY val)"""


@query(f"WITH {oracle_view('ord')} SELECT * FROM {_points('ord', 'acctbal', 10)}")
def quantile_points(spark, d):
    return effects.quantile_points(view(spark, d, "ord"), "acctbal", 10)


def _doubling_oracle() -> str:
    tries = "(VALUES (2), (4), (8), (16), (32), (64)) t(q)"
    return f"""WITH {oracle_view('li')}, x AS (SELECT CASE WHEN linenumber < 7 THEN 1 ELSE linenumber END AS v FROM li),
s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () - 1 AS top FROM x),
q AS (SELECT min(q) AS q FROM {tries} WHERE (SELECT v FROM s WHERE i = top // (q + 1)) <> (SELECT v FROM s WHERE i = CAST(floor(top * (q / (q + 1.0::DOUBLE))) AS BIGINT))),
p AS (SELECT CAST(floor((SELECT max(top) FROM s) * (k / (q + 1.0::DOUBLE))) AS BIGINT) AS i FROM q, LATERAL (SELECT unnest(range(1, q + 1)) AS k))
SELECT CAST(v AS DOUBLE) AS val, count(*) AS n FROM s JOIN p USING (i) GROUP BY v"""


@query(_doubling_oracle())
def quantile_autodouble(spark, d):
    x = view(spark, d, "li").select(F.when(F.col("linenumber") < 7, F.lit(1.0)).otherwise(F.col("linenumber")).alias("v"))
    return effects.quantile_points(x, "v", 2)


EFFECT = f"WITH {oracle_view('ord')}, {NUMBERED}, {sql.tree_ctes('ord', WHOLE, 1)}, one AS (SELECT attr, border, missing_l FROM nodes WHERE node_id = 1), l AS (SELECT value FROM nodes WHERE node_id = 2), r AS (SELECT value FROM nodes WHERE node_id = 3)"


@query(f"""{EFFECT} SELECT q.val, q.n, round(CASE WHEN one.attr <> 'sum_qty' THEN one.missing_l * l.value + (1 - one.missing_l) * r.value WHEN q.val <= one.border THEN l.value ELSE r.value END, 6) AS pred
FROM {_points('ord', 'sum_qty', 8)} q, one, l, r""")
def effect_stump(spark, d):
    _, nodes = _whole_tree(spark, d, 1)
    points = effects.quantile_points(view(spark, d, "ord"), "sum_qty", 8)
    return effects.effect(points, "sum_qty", ORD, predict.ensemble_expression(nodes)).select("val", "n", *r6("pred"))


def _iplot_oracle() -> str:
    p = lambda n: f"CASE {n}.attr WHEN 'sum_qty' THEN CASE WHEN a.val <= {n}.border THEN 1.0 ELSE 0.0 END WHEN 'acctbal' THEN CASE WHEN b.val <= {n}.border THEN 1.0 ELSE 0.0 END ELSE {n}.missing_l END"
    side = lambda n, l, r: f"coalesce({n}.value, ({p(n)}) * {l}.value + (1 - ({p(n)})) * {r}.value)"
    joins = " ".join(f"LEFT JOIN nodes n{i} ON n{i}.node_id = {i}" for i in range(1, 8))
    return f"""WITH {oracle_view('ord')}, {NUMBERED}, {sql.tree_ctes('ord', WHOLE, 2)}
SELECT a.val AS val1, b.val AS val2, round(({p('n1')}) * {side('n2', 'n4', 'n5')} + (1 - ({p('n1')})) * {side('n3', 'n6', 'n7')}, 6) AS pred
FROM {_points('ord', 'sum_qty', 5)} a CROSS JOIN {_points('ord', 'acctbal', 5)} b {joins}"""


@query(_iplot_oracle())
def iplot_depth2(spark, d):
    _, nodes = _whole_tree(spark, d)
    ord_ = view(spark, d, "ord")
    a, b = (effects.quantile_points(ord_, x, 5) for x in ("sum_qty", "acctbal"))
    return effects.joint_effect(a, b, "sum_qty", "acctbal", ORD, predict.ensemble_expression(nodes)).select("val1", "val2", *r6("pred"))


def _density_oracle() -> str:
    def borders(attr):
        return f"(SELECT (val + lead(val) OVER (ORDER BY val)) / 2 AS b FROM {_points('li', attr, 4)})"

    return f"""WITH {oracle_view('li')}, bq AS {borders('quantity')}, bd AS {borders('discount')},
x AS (SELECT CAST((SELECT count(*) FROM bq WHERE quantity > b) AS INTEGER) AS b1, CAST((SELECT count(*) FROM bd WHERE discount > b) AS INTEGER) AS b2 FROM (SELECT quantity, discount FROM li)),
g AS (SELECT b1, b2, count(*) AS n FROM x GROUP BY b1, b2), dens AS (SELECT b1, b2, n / sum(n) OVER () AS share FROM g)"""


def _density(spark, d):
    li = view(spark, d, "li")
    return effects.density(li, "quantity", "discount", effects.quantile_points(li, "quantity", 4), effects.quantile_points(li, "discount", 4))


@query(f"{_density_oracle()} SELECT b1, b2, round(share, 6) AS share FROM dens")
def density_grid(spark, d):
    return _density(spark, d).select("b1", "b2", *r6("share"))


@query(f"{_density_oracle()} SELECT b1, b2, CASE WHEN share > 10.0 / 160 THEN 'dense' WHEN share < 0.1 / 160 THEN 'sparse' ELSE 'even' END AS mark FROM dens")
def density_markers(spark, d):
    return effects.density_markers(_density(spark, d), 160).select("b1", "b2", "mark")


# --- grids

@query("SELECT n_nationkey AS k, round([5, 2, 1][CAST(n_nationkey % 3 AS INTEGER) + 1] / power(10.0::DOUBLE, n_nationkey // 3 + 1), 12) AS alpha FROM nation")
def alpha_grid(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.round(scalars.alpha_column(F.col("n_nationkey")), 12).alias("alpha"))


@query("SELECT n_nationkey AS k, CAST(floor(sqrt(power(2.0::DOUBLE, n_nationkey + 1)) + 0.5) AS INTEGER) AS n FROM nation")
def tig_grid(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), scalars.tree_count_column(F.col("n_nationkey")).alias("n"))


@query("""SELECT s_suppkey, round(power(2.0::DOUBLE, least(-log2(1000.0), log2(alpha)) - (least(-log2(1000.0), log2(alpha)) - log2(alpha)) * h / -log2(alpha)), 9) AS share
FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.01 ELSE 0.5 END AS alpha, s_suppkey % 5 AS h FROM supplier)""")
def cur_alpha_schedule(spark, d):
    key = F.col("s_suppkey")
    alpha = F.when(key % 3 == 0, 0.1).when(key % 3 == 1, 0.01).otherwise(0.5)
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.round(scalars.leaf_share_column(alpha, F.lit(1000.0), key % 5), 9).alias("share"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def repeat_mean_std(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("value").alias("perf"))
    return metrics.repeat_stats(e, ["event_type"]).select("event_type", *r6("mean", "std"))


@query("SELECT n_nationkey AS id, CAST(n_nationkey AS DOUBLE) AS perf, (n_nationkey - 5) / 2.0::DOUBLE AS z, CASE WHEN (n_nationkey - 5) / 2.0 > 7 THEN 'strong' WHEN (n_nationkey - 5) / 2.0 > 3 THEN 'weak' ELSE 'none' END AS present FROM nation")
def interaction_z(spark, d):
    tests = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("double").alias("perf"))
    return features.interaction_scores(tests, 5.0, 2.0)


@query("SELECT s AS step, o_orderkey AS key, round(CASE s WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN (floor(o_totalprice) * 3 + o_custkey * 5) / 8 END, 6) AS pred FROM orders, (VALUES (0), (1)) t(s)")
def grid_merge_running_mean(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    a = o.select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").cast("double").alias("pred"))
    b = o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("double").alias("pred"))
    return grid.merge_predictions([(a, 3), (b, 5)]).select("step", "key", *r6("pred"))


# --- scans, checks, draws

DOC_ATTRIBUTES = "y: cont (class).\nw: cont (weight).\nkey: nom.\nn_chars: cont (split).\ntoxic: 0,1.\nlang_en: 0,1.\ncontexts:\nkey never.\n"


def _doc_file(spark, d, ignored: str | None = None):
    """The documents' view as a headerless file and the rows that a scan of it gives."""
    schema = parse_schema(DOC_ATTRIBUTES)
    for name in [ignored] if ignored else []:
        schema = schema.without(name)
    path = new_path(spark)
    lines = view(spark, d, "doc").select(F.concat_ws("\t", *[scalars.missing_text(F.col(a.name)) for a in schema.columns]).alias("value"))
    lines.write.text(path)
    return schema, tables.read_table(spark, path, schema)


@query(f"WITH {oracle_view('doc')} SELECT CAST(key AS VARCHAR) AS key, y, w, n_chars, toxic, lang_en FROM doc")
def scan_headerless_table(spark, d):
    return _doc_file(spark, d)[1]


@query(f"WITH {oracle_view('doc')} SELECT y, w, n_chars, lang_en FROM doc WHERE y IS NOT NULL")
def scan_reduced_schema(spark, d):
    schema, rows = _doc_file(spark, d, "toxic")
    return tables.checked(rows.filter("y IS NOT NULL"), schema, "valid").select("y", "w", *schema.active)


@query(f"WITH {oracle_view('doc')} SELECT n_chars, toxic, row_number() OVER (ORDER BY n_chars ASC NULLS LAST, toxic ASC NULLS LAST) - 1 AS row_no FROM doc")
def sorted_pair_missing_last(spark, d):
    return numbered(view(spark, d, "doc").select("n_chars", "toxic"), F.col("n_chars").asc_nulls_last(), F.col("toxic").asc_nulls_last())


@query(f"WITH {oracle_view('ord')} SELECT val AS sum_qty, n, NULL::DOUBLE AS acctbal, NULL::DOUBLE AS avg_disc FROM {_points('ord', 'sum_qty', 12)}")
def probe_points(spark, d):
    points = effects.quantile_points(view(spark, d, "ord"), "sum_qty", 12).withColumnRenamed("val", "sum_qty")
    return tables.probe_points(spark, CORR, points)


@query("SELECT event_type, min(value) < 0 OR max(value) > 1 AS outside, min(value) = max(value) AND min(value) IN (0, 1) AS single FROM (SELECT event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 0 WHEN 'purchase' THEN event_id % 2 ELSE event_id % 3 END AS value FROM events) GROUP BY event_type")
def label_faults(spark, d):
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", F.col("event_id") % 2).otherwise(F.col("event_id") % 3)
    return metrics.label_faults(spark.read.parquet(f"{d}/events.parquet").select("event_type", kind.alias("y")), ["event_type"])


def _redraw_oracle(bags: int) -> str:
    name = "CASE WHEN k = 0 THEN CAST(bag AS VARCHAR) ELSE bag || '.' || k END"
    return f"""WITH n AS (SELECT count(*) AS n FROM region),
tried AS (SELECT b.range AS bag, k.range AS k, x.range AS draw, CAST(floor(CAST(n AS DOUBLE) * (CAST('0x' || substr(md5('1-' || {name.replace('bag', 'b.range').replace('k = 0', 'k.range = 0').replace(" || k END", " || k.range END")} || '-' || x.range), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)) AS BIGINT) AS row_no
  FROM n, range({bags}) b, range(6) k, range(5) x),
ok AS (SELECT bag, min(k) AS k FROM (SELECT bag, k FROM tried GROUP BY bag, k HAVING count(DISTINCT row_no) < 5) GROUP BY bag)
SELECT bag, draw, row_no FROM tried JOIN ok USING (bag, k)"""


@query(_redraw_oracle(200))
def bag_redraws(spark, d):
    """Of so few rows, some bags draw all, and are drawn anew."""
    return sampling.bootstrap_draws(spark, spark.read.parquet(f"{d}/region.parquet").count(), 200)


@query(sql.split_query("ord", attrs=[a for a in ORD if a != "sum_qty"]))
def split_root_barred(spark, d):
    """The best split that a feature may not take part in."""
    attrs = [a for a in ORD if a != "sum_qty"]
    return _shown(splits.best_splits(_found(_items(spark, d, "ord"), "ord", attrs), ["node"]))


@query(f"""{RHO.rsplit('p AS (SELECT', 1)[0]}p AS (SELECT a.attr AS attr1, b.attr AS attr2, round(corr(a.r, b.r), 6) AS rho FROM r a JOIN r b ON a.key = b.key AND a.attr < b.attr GROUP BY 1, 2) SELECT * FROM p""")
def spearman_exact_ties(spark, d):
    return features.spearman(view(spark, d, "ord"), "key", CORR, exact=True).select("attr1", "attr2", *r6("rho"))


@query(f"""WITH {oracle_view('ord')}, x AS (SELECT *, 8 * sum_qty AS p FROM ord), m AS (SELECT priority, sum(w * y) / sum(w) AS m FROM ord GROUP BY priority),
s AS (SELECT priority, round(sqrt(sum(w * (y - m) ** 2) / sum(w)), 6) AS std FROM ord JOIN m USING (priority) GROUP BY priority), e AS (SELECT priority, {RMSE} FROM x GROUP BY priority)
SELECT priority, rmse AS perf, std, rmse > std AS below FROM e JOIN s USING (priority)""")
def baseline_by_group(spark, d):
    o = view(spark, d, "ord")
    perf = metrics.rmse(o.withColumn("pred", 8 * F.col("sum_qty")), ["priority"]).select("priority", F.round("rmse", 6).alias("perf"))
    mean = o.groupBy("priority").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("pred"))
    std = metrics.rmse(o.join(mean, "priority"), ["priority"]).select("priority", F.round("rmse", 6).alias("std"))
    return metrics.below_baseline(perf, std, ["priority"])


def _iplot_fixed_oracle() -> str:
    p = lambda n: f"CASE {n}.attr WHEN 'sum_qty' THEN CASE WHEN a.val <= {n}.border THEN 1.0 ELSE 0.0 END WHEN 'acctbal' THEN CASE WHEN b.val <= {n}.border THEN 1.0 ELSE 0.0 END WHEN 'avg_disc' THEN CASE WHEN 5 <= {n}.border THEN 1.0 ELSE 0.0 END ELSE {n}.missing_l END"
    side = lambda n, l, r: f"coalesce({n}.value, ({p(n)}) * {l}.value + (1 - ({p(n)})) * {r}.value)"
    joins = " ".join(f"LEFT JOIN nodes n{i} ON n{i}.node_id = {i}" for i in range(1, 8))
    return f"""WITH {oracle_view('ord')}, {NUMBERED}, {sql.tree_ctes('ord', WHOLE, 2)}
SELECT a.val AS val1, b.val AS val2, round(({p('n1')}) * {side('n2', 'n4', 'n5')} + (1 - ({p('n1')})) * {side('n3', 'n6', 'n7')}, 6) AS pred
FROM {_points('ord', 'sum_qty', 4)} a CROSS JOIN {_points('ord', 'acctbal', 3)} b {joins}"""


@query(_iplot_fixed_oracle())
def iplot_fixed_feature(spark, d):
    _, nodes = _whole_tree(spark, d)
    ord_ = view(spark, d, "ord")
    a, b = effects.quantile_points(ord_, "sum_qty", 4), effects.quantile_points(ord_, "acctbal", 3)
    return effects.joint_effect(a, b, "sum_qty", "acctbal", ORD, predict.ensemble_expression(nodes), effects.read_fixed("avg_disc 5")).select("val1", "val2", *r6("pred"))


# --- boosting on bags and samples, curves


def _one_round(draws: str, items: str) -> str:
    return f"WITH {oracle_view('ord')}, {NUMBERED}, {draws}{sql.tree_ctes('ord', items, 1)}, {sql.scored('ord', 1, ROWS)} SELECT row_no, round(0.5 * pred, 6) AS pred FROM pred"


@query(_one_round(sql.draws_cte("ord", 1) + ", ", BAGGED))
def gbt_bootstrap_stump(spark, d):
    _, preds = ensemble.boosted_trees(view(spark, d, "ord"), "key", ORD, 1, 0.5, booleans=BOOLEANS["ord"], max_depth=1)
    return preds.select("row_no", *r6("pred"))


SAMPLED = "half AS (SELECT row_no FROM (SELECT row_no, row_number() OVER (ORDER BY CAST('0x' || substr(md5('1-0-' || row_no), 1, 8) AS BIGINT), row_no) AS k FROM rows) WHERE k <= (SELECT count(*) // 2 FROM rows)), "


@query(_one_round(SAMPLED, WHOLE + " JOIN half USING (row_no)"))
def gbt_subsample_stump(spark, d):
    _, preds = ensemble.boosted_trees(view(spark, d, "ord"), "key", ORD, 1, 0.5, subsample=0.5, booleans=BOOLEANS["ord"], max_depth=1)
    return preds.select("row_no", *r6("pred"))


def _grove_ctes(sweeps: int) -> tuple[list[str], list[str]]:
    """CTEs of a grove of two stumps on all rows, and SQL of (row_no, pred) after each sweep."""
    ctes, after, first, second = [oracle_view("ord"), NUMBERED, "zero AS (SELECT row_no, 0.0::DOUBLE AS pred FROM rows)"], [], "zero", "zero"
    for k in range(sweeps):
        for name, other in ((f"b{k}", "first"), (f"a{k}", "second")):
            left = first if other == "first" else second
            items = f"SELECT 0 AS bag, row_no, w AS coef, y - pred AS resp, {', '.join(ORD)} FROM rows JOIN {left} USING (row_no)"
            ctes.append(f"{name} AS (WITH {sql.tree_ctes('ord', items, 1)}, {sql.scored('ord', 1, ROWS)} SELECT row_no, pred FROM pred)")
            first, second = (first, name) if other == "first" else (name, second)
        after.append(f"SELECT {k + 1} AS sweep, row_no, a{k}.pred + b{k}.pred AS pred FROM a{k} JOIN b{k} USING (row_no)")
    return ctes, after


def _sweeps(spark, d, n: int):
    """(sweep, key, pred, y, w) of a grove of two stumps, fitted to all rows in n sweeps."""
    after = ensemble.back_fitted(view(spark, d, "ord"), "key", ORD, 2, n, booleans=BOOLEANS["ord"], max_depth=1)
    return reduce(DataFrame.unionByName, [df.select(F.lit(k + 1).alias("sweep"), "key", "pred", "y", "w") for k, df in enumerate(after)])


@query(f"WITH {', '.join(_grove_ctes(2)[0])}, p AS ({' UNION ALL '.join(_grove_ctes(2)[1])}) SELECT sweep, key, round(pred, 4) AS pred FROM p JOIN rows USING (row_no)")
def grove_stump_sweeps(spark, d):
    """Back-fitting: the second stump first, then the first one, on what the other leaves; two sweeps."""
    return _sweeps(spark, d, 2).select("sweep", "key", F.round("pred", 4).alias("pred"))


@query(f"WITH {', '.join(_grove_ctes(2)[0])}, x AS (SELECT sweep, y, w, pred AS p FROM ({' UNION ALL '.join(_grove_ctes(2)[1])}) JOIN rows USING (row_no)) SELECT sweep, {RMSE.replace(', 6)', ', 4)')} FROM x GROUP BY sweep")
def grove_sweep_errors(spark, d):
    return metrics.rmse(_sweeps(spark, d, 2), ["sweep"]).select("sweep", F.round("rmse", 4).alias("rmse"))


BAG_SWEEP = f"""WITH {oracle_view('ord')}, {NUMBERED}, {sql.draws_cte('rows', 1).replace("|| bag || '-'", "|| bag || '.0-'")},
zero AS (SELECT row_no, 0.0::DOUBLE AS pred FROM rows),
b AS (WITH {sql.tree_ctes('ord', f"SELECT 0 AS bag, row_no, w AS coef, y - pred AS resp, {', '.join(ORD)} FROM draws JOIN rows USING (row_no) JOIN zero USING (row_no)", 1)}, {sql.scored('ord', 1, ROWS)} SELECT row_no, pred FROM pred),
a AS (WITH {sql.tree_ctes('ord', f"SELECT 0 AS bag, row_no, w AS coef, y - pred AS resp, {', '.join(ORD)} FROM draws JOIN rows USING (row_no) JOIN b USING (row_no)", 1)}, {sql.scored('ord', 1, ROWS)} SELECT row_no, pred FROM pred),
x AS (SELECT row_no, y, a.pred + b.pred AS p, w FROM a JOIN b USING (row_no) JOIN rows USING (row_no)),
s AS (SELECT true AS inside, y, p, w FROM x JOIN draws USING (row_no) UNION ALL SELECT false, y, p, w FROM x WHERE row_no NOT IN (SELECT row_no FROM draws))"""


@query(f"{BAG_SWEEP} SELECT inside, {RMSE.replace(', 6)', ', 4)')} FROM s GROUP BY inside")
def grove_bag_errors(spark, d):
    """A sweep over two stumps on a bag of draws: errors in the bag and out of it."""
    rows = ensemble.back_fitted(view(spark, d, "ord"), "key", ORD, 2, 1, booleans=BOOLEANS["ord"], max_depth=1, bag=0)[0]
    both = rows.withColumn("inside", F.col("times") > 0).withColumn("w", F.col("w") * F.greatest("times", F.lit(1)))
    return metrics.rmse(both, ["inside"]).select("inside", F.round("rmse", 4).alias("rmse"))


# --- state of grid runs, over made-up cells of real rows

CELL_SQL = """cells AS (SELECT b.range AS bag, t.range AS tig_no, a.range AS alpha_no, o_orderkey AS key, (b.range + t.range) % 2 = 0 AS from_below,
  floor(o_totalprice / 1000) + (o_orderkey * (b.range + 3) + t.range * 5 + a.range * 7) % 11 AS pred, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS y FROM orders, range(3) b, range(2) t, range(2) a)"""


def _run(spark, d, seed=1):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.floor(F.col("o_totalprice") / 1000).alias("base"))
    ways = F.array(*[F.struct(F.lit(b).cast("long").alias("bag"), F.lit(t).alias("tig_no"), F.lit(a).alias("alpha_no"), F.lit(scalars.tree_count(t)).alias("n"), F.lit(scalars.alpha_value(a)).alias("alpha"), F.lit((b + t) % 2 == 0).alias("from_below")) for b in range(3) for t in range(2) for a in range(2)])
    rows = o.select("key", "base", F.explode(ways).alias("x")).select("x.*", "key", "base")
    cells = rows.withColumn("pred", (F.col("base") + (F.col("key") * (F.col("bag") + 3) + F.col("tig_no") * 5 + F.col("alpha_no") * 7) % 11).cast("double"))
    nodes = cells.filter("key % 97 = 1").select("bag", "tig_no", "alpha_no", F.lit(0).alias("tree"), F.col("key").cast("string").alias("node_id"), F.lit(None).cast("string").alias("attr"), F.lit(None).cast("double").alias("border"), F.lit(None).cast("double").alias("missing_l"), F.col("pred").alias("value"))
    return grid.GridRun(cells.drop("base"), nodes, seed, 0.2, 2, 3, "slow"), o.select("key", F.col("base").cast("double").alias("y"), F.lit(1.0).alias("w"))


CURVES = f"""WITH {CELL_SQL}, m AS (SELECT tig_no, alpha_no, bag, y, 1 AS w, avg(pred) OVER (PARTITION BY tig_no, alpha_no, key ORDER BY bag) AS p FROM cells),
curves AS (SELECT CAST(tig_no AS INTEGER) AS tig_no, CAST(alpha_no AS INTEGER) AS alpha_no, bag, {RMSE.replace('AS rmse', 'AS perf')} FROM m GROUP BY ALL)"""


@query(f"{CURVES} SELECT * FROM curves")
def grid_curves(spark, d):
    return grid.curves(*_run(spark, d)).select("tig_no", "alpha_no", "bag", *r6("perf"))


@query(f"{CURVES} SELECT tig_no, alpha_no, tig_no + 1 AS n, CASE alpha_no WHEN 0 THEN 0.5::DOUBLE ELSE 0.2 END AS alpha, perf FROM curves WHERE bag = 2")
def grid_surface(spark, d):
    return grid.surface(*_run(spark, d)).select("tig_no", "alpha_no", "n", "alpha", *r6("perf"))


@query(f"{CURVES} SELECT tig_no, {', '.join(f'max(perf) FILTER (alpha_no = {a}) AS a{a}' for a in range(2))} FROM curves WHERE bag = 2 GROUP BY tig_no")
def surface_pivot(spark, d):
    return metrics.surface_pivot(grid.surface(*_run(spark, d))).select("tig_no", *r6("a0", "a1"))


@query(f"{CURVES} SELECT tig_no, alpha_no, tig_no + 1 AS n, perf FROM curves WHERE bag = 2 ORDER BY perf, power(2, alpha_no) * (tig_no + 1) LIMIT 1")
def best_cell(spark, d):
    return metrics.best_cell(grid.surface(*_run(spark, d))).select("tig_no", "alpha_no", "n", *r6("perf"))


@query(f"WITH {CELL_SQL} SELECT CAST(tig_no AS INTEGER) AS tig_no, CAST(alpha_no AS INTEGER) AS alpha_no, round(avg(CASE WHEN from_below THEN 1 ELSE 0 END), 6) AS share FROM cells GROUP BY ALL")
def grid_directions(spark, d):
    return metrics.direction_table(_run(spark, d)[0].cells).select("tig_no", "alpha_no", *r6("share"))


@query(f"WITH {CELL_SQL}, m AS (SELECT bag, key, pred FROM cells WHERE tig_no = 1 AND alpha_no = 1 UNION ALL SELECT bag + 3, key, pred + 1 FROM cells WHERE tig_no = 1 AND alpha_no = 1) SELECT key, count(DISTINCT bag) AS bags, round(avg(pred), 6) AS pred FROM m GROUP BY key")
def grid_merge_bags(spark, d):
    first, _ = _run(spark, d)
    second, _ = _run(spark, d, 2)
    second = replace(second, cells=second.cells.withColumn("pred", F.col("pred") + 1))
    cells = grid.merge_runs([first, second]).cells.filter("tig_no = 1 AND alpha_no = 1")
    return cells.groupBy("key").agg(F.countDistinct("bag").alias("bags"), F.round(F.avg("pred"), 6).alias("pred"))


@query(f"WITH {CELL_SQL}, c AS (SELECT bag, key, pred FROM cells WHERE tig_no = 1 AND alpha_no = 0 AND key % 97 = 1) SELECT bag, CAST(key AS VARCHAR) AS node_id, pred AS value FROM c UNION ALL SELECT bag + 3, CAST(key AS VARCHAR), pred FROM c WHERE bag < 1")
def grid_save_cell(spark, d):
    runs = [_run(spark, d)[0], _run(spark, d, 2)[0]]
    return grid.save_cell(runs, 1, 0, 4).select("bag", "node_id", "value")


@query(f"WITH {oracle_view('ord')}, {NUMBERED}, {sql.tree_ctes('ord', WHOLE, 1)}, {sql.scored('ord', 1, ROWS)} SELECT row_no, round((pred + 2 * pred) / 2 + pred / 2, 6) AS pred FROM pred")
def score_groves(spark, d):
    """Trees of a bag add up and bags are averaged: a bag of two trees and one of a single tree."""
    rows, nodes = _whole_tree(spark, d, 1)
    tree_of = lambda bag, k, times: nodes.withColumns({"bag": F.lit(bag).cast("long"), "tree": F.lit(k), "value": F.col("value") * times})
    every = tree_of(0, 0, 1.0).unionByName(tree_of(0, 1, 2.0)).unionByName(tree_of(1, 0, 1.0))
    return predict.grove_predictions(predict.tree_predictions(rows, every, ORD)).select("row_no", *r6("pred"))


EMB = [f"e{k}" for k in range(64)]


@query()
def grove_layered_preds(spark, d):
    """Layered groves: mean prediction of each validation row."""
    import numpy as np
    import pandas as pd

    def work(data, scored):
        g = kernel.layered(data, 0.1, 3)
        yield pd.DataFrame({"key": scored.key, "pred": np.sum([t.predict(scored.x) for t in g.trees], axis=0)})

    return kernel.per_bag(embeddings(spark, d), 60, EMB, "key long, pred double", work).groupBy("key").agg(F.avg("pred").alias("pred"))


@query()
def grove_grid(spark, d):
    """A fast-mode grid: validation error of each cell."""
    rows = embeddings(spark, d)
    run = grid.train_grid(rows, EMB, 0.1, 3)
    return grid.surface(run, rows.filter("set = 'valid'").select("key", "y", "w"))


@query()
def backward_elimination(spark, d):
    """Of all components, with the operator's bags and repeats."""
    return features.backward_elimination(embeddings(spark, d), EMB, 0.2, 2)


@query()
def interaction_scan(spark, d):
    """All pairs of all components, with the operator's bags and repeats."""
    return features.interaction_scan(embeddings(spark, d), EMB, 0.2, 2)
