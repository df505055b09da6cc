"""SQL for DuckDB of the analytical core, written from the formulas."""

from __future__ import annotations

from .views import BOOLEANS, FEATURES, oracle_view


def long_sql(source: str, attrs: list[str], columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{a}' AS attr, CAST({a} AS DOUBLE) AS val FROM {source}" for a in attrs)


def split_ctes(tag: str, source: str, attrs: list[str], keys: str, booleans: list[str]) -> str:
    """CTEs long, cand and best of ``source`` (keys, coef, resp, attrs)."""
    flags = ", ".join(f"'{b}'" for b in booleans) or "''"
    return f"""
long{tag} AS ({long_sql(source, attrs, f'{keys}, coef, resp')}),
blk{tag} AS (
  SELECT {keys}, attr, val, sum(coef) AS v, sum(coef * resp) AS s, min(resp) AS lo, max(resp) AS hi FROM long{tag} GROUP BY {keys}, attr, val
), tot{tag} AS (
  SELECT {keys}, attr, coalesce(sum(v) FILTER (val IS NULL), 0.0::DOUBLE) AS vm, coalesce(sum(s) FILTER (val IS NULL), 0.0::DOUBLE) AS sm,
         coalesce(sum(v) FILTER (val IS NOT NULL), 0.0::DOUBLE) AS vp, coalesce(sum(s) FILTER (val IS NOT NULL), 0.0::DOUBLE) AS sp
  FROM blk{tag} GROUP BY {keys}, attr
), run{tag} AS (
  SELECT {keys}, attr, val, lo, hi, lag(val) OVER w AS val0, lag(lo) OVER w AS lo0, lag(hi) OVER w AS hi0,
         sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v1, sum(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s1
  FROM blk{tag} WHERE val IS NOT NULL WINDOW w AS (PARTITION BY {keys}, attr ORDER BY val)
), cut{tag} AS (
  SELECT r.*, t.vm, t.sm, t.vp, t.vp - v1 AS v2, t.sp - s1 AS s2, v1 / (v1 + (t.vp - v1)) AS p, vp + vm AS v
  FROM run{tag} r JOIN tot{tag} t USING ({keys}, attr)
  WHERE val0 IS NOT NULL AND NOT (lo = hi AND lo0 = hi0 AND lo = lo0 AND attr NOT IN ({flags})) AND v1 > 1e-10 AND t.vp - v1 > 1e-10
), mu{tag} AS (
  SELECT *, (s1 / p + sm) / v AS m1, (s2 / (1 - p) + sm) / v AS m2, p * ((s1 / p + sm) / v) + (1 - p) * ((s2 / (1 - p) + sm) / v) AS mm FROM cut{tag}
), cand{tag} AS (
  SELECT {keys}, attr, (val0 + val) / 2 AS border, v1 / vp AS missing_l,
         CASE WHEN vm > 1e-10 THEN -2 * m1 * s1 + v1 * m1 * m1 - 2 * m2 * s2 + v2 * m2 * m2 - 2 * mm * sm + vm * mm * mm
              ELSE -s1 * s1 / v1 - s2 * s2 / v2 END AS eval
  FROM mu{tag}
  UNION ALL
  SELECT {keys}, attr, NULL, 0.0::DOUBLE, -sp * sp / vp - sm * sm / vm FROM tot{tag} WHERE vm > 1e-10 AND vp > 1e-10
), best{tag} AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(eval, 6), attr, border ASC NULLS LAST) AS k FROM cand{tag}) WHERE k = 1
)"""


def split_query(view: str, weight: str = "w", where: str = "", keys: str = "node", key_sql: str = "1", attrs: list[str] | None = None, table: str = "best") -> str:
    return f"""WITH {oracle_view(view)},
items AS (SELECT {key_sql} AS {keys}, {weight} AS coef, y AS resp, {', '.join(attrs or FEATURES[view])} FROM {view} {where}),
{split_ctes('', 'items', attrs or FEATURES[view], keys, BOOLEANS[view])}
SELECT {keys}, attr, round(border, 6) AS border, round(missing_l, 6) AS missing_l, round(eval, 3) AS eval FROM {table}"""


def _routed(attrs: list[str]) -> str:
    value = "CASE " + " ".join(f"WHEN b.attr = '{a}' THEN i.{a}" for a in attrs) + " END"
    return f"CASE WHEN {value} <= b.border THEN 0 ELSE 1 END"


def tree_ctes(view: str, items: str, depth: int, attrs: list[str] | None = None, keys: str = "bag, node_id") -> str:
    """CTEs items0 … itemsD (routed rows) and nodes of a tree without missing values; ``items``: SQL of bag, row_no, coef, resp, attrs."""
    attrs = attrs or FEATURES[view]
    out, nodes = [f"items0 AS (SELECT *, CAST(1 AS BIGINT) AS node_id FROM ({items}))"], []
    for d in range(depth + 1):
        out.append(f"stat{d} AS (SELECT bag, node_id, count(*) AS n, sum(coef) AS v, sum(coef * resp) AS s, min(resp) = max(resp) AS pure FROM items{d} GROUP BY bag, node_id)")
        if d < depth:
            out.append(split_ctes(str(d), f"(SELECT i.* FROM items{d} i JOIN stat{d} USING (bag, node_id) WHERE NOT pure)", attrs, keys, BOOLEANS[view]).strip())
            out.append(f"items{d + 1} AS (SELECT i.bag, i.row_no, i.coef, i.resp, {', '.join('i.' + a for a in attrs)}, i.node_id * 2 + {_routed(attrs)} AS node_id FROM items{d} i JOIN best{d} b USING (bag, node_id))")
            nodes.append(f"SELECT s.bag, s.node_id, {d} AS depth, n, v, s, attr, border, missing_l, CASE WHEN attr IS NULL THEN s / v END AS value FROM stat{d} s LEFT JOIN best{d} b USING (bag, node_id)")
        else:
            nodes.append(f"SELECT bag, node_id, {d} AS depth, n, v, s, NULL AS attr, NULL AS border, NULL AS missing_l, s / v AS value FROM stat{d}")
    return ",\n".join(out) + ",\nnodes AS (" + " UNION ALL ".join(nodes) + ")"


def scored(view: str, depth: int, rows: str, attrs: list[str] | None = None) -> str:
    """CTE pred (bag, row_no, pred): ``rows`` (row_no, attrs) sent down ``nodes``."""
    attrs = attrs or FEATURES[view]
    out = [f"down0 AS (SELECT bag, r.*, CAST(1 AS BIGINT) AS node_id FROM ({rows}) r, (SELECT DISTINCT bag FROM nodes))"]
    for d in range(depth):
        out.append(f"down{d + 1} AS (SELECT i.bag, i.row_no, {', '.join('i.' + a for a in attrs)}, CASE WHEN b.attr IS NULL THEN i.node_id ELSE i.node_id * 2 + {_routed(attrs)} END AS node_id FROM down{d} i JOIN nodes b USING (bag, node_id))")
    return ",\n".join(out) + f",\npred AS (SELECT bag, row_no, value AS pred FROM down{depth} JOIN nodes USING (bag, node_id))"


def draws_cte(rows: str, bags: int, seed: int = 1) -> str:
    """CTE draws (bag, draw, row_no) for ``rows`` (a CTE) numbered from 0."""
    return f"""size AS (SELECT count(*) AS n FROM {rows}),
draws AS (
  SELECT bag, draw, CAST(floor(CAST(n AS DOUBLE) * (CAST('0x' || substr(md5('{seed}-' || bag || '-' || draw), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)) AS BIGINT) AS row_no
  FROM size, (SELECT range AS bag FROM range({bags})), LATERAL (SELECT unnest(range(n)) AS draw)
)"""
