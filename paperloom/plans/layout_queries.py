"""Layout scores: a page's odd parts are its source, its even ones its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout_score as L
from ..operators import segment as S
from ..registry import query, table
from .segment_queries import _SQL_PARTS, boxes

#: Of two lists x and y of a relation: the similarity of the profiles.
_SIMILAR = """CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN list_sum(u) <= 1e-6 AND list_sum(v) <= 1e-6 THEN 1.0 WHEN list_sum(u) <= 1e-6 OR list_sum(v) <= 1e-6 THEN 0.0
  ELSE greatest(0, least(1, 0.65 * greatest(0, 1 - list_sum(list_transform(range(1, len(u) + 1), lambda i: abs(u[i] / list_sum(u) - v[i] / list_sum(v)))) / 2) + 0.35 * list_sum(list_transform(range(1, len(u) + 1), lambda i: least(u[i] / list_max(u), v[i] / list_max(v)))) / list_sum(list_transform(range(1, len(u) + 1), lambda i: greatest(u[i] / list_max(u), v[i] / list_max(v)))))) END"""


@query("AGG_26_profiles", f"WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS x, list(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE floor(l_discount * 100) END ORDER BY l_linenumber, floor(l_discount * 100)) FILTER (l_linenumber < 6 AND l_orderkey % 7 > 0) AS y FROM lineitem GROUP BY l_orderkey), p AS (SELECT l_orderkey, x, coalesce(y, []) AS y FROM o) SELECT l_orderkey AS id, round({_SIMILAR}, 9) AS score FROM (SELECT *, x[1:least(len(x), len(y))] AS u, y[1:least(len(x), len(y))] AS v FROM p)")
def profiles(spark, d):
    """Quantities of an order's lines against their discounts, which some orders don't have."""
    line = lambda c: F.struct("l_linenumber", c.alias("v"))
    other = F.when((F.col("l_linenumber") < 6) & (F.col("l_orderkey") % 7 > 0), line(F.when(F.col("l_orderkey") % 5 == 0, F.lit(0.0)).otherwise(F.floor(F.col("l_discount") * 100).cast("double"))))
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line(F.col("l_quantity")))).alias("x"), F.sort_array(F.collect_list(other)).alias("y"))
    return listed.select(F.col("l_orderkey").alias("id"), F.round(L.profile_similarity(F.col("x")["v"], F.col("y")["v"]), 9).alias("score"))


_SCORES = f"""
WITH b AS (SELECT page, id % 2 AS side, l, t, l + w AS r, t + h AS e FROM ({_SQL_PARTS})),
s AS (SELECT page, side, greatest(0, least(64, CAST(floor(l * 64 / 600) AS BIGINT))) AS c0, greatest(0, least(64, CAST(ceil(r * 64 / 600) AS BIGINT))) AS c1, greatest(0, least(64, CAST(floor(t * 64 / 800) AS BIGINT))) AS r0, greatest(0, least(64, CAST(ceil(e * 64 / 800) AS BIGINT))) AS r1 FROM b),
k AS (SELECT page, side, c0, c1, unnest(range(r0, r1)) AS row FROM s), i AS (SELECT DISTINCT page, side, row, unnest(range(c0, c1)) AS col FROM k),
g AS (SELECT pages.page, r.range AS row, c.range AS col, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 0) AS y FROM (SELECT DISTINCT page FROM b) AS pages CROSS JOIN range(64) r CROSS JOIN range(64) c LEFT JOIN i ON i.page = pages.page AND i.row = r.range AND i.col = c.range GROUP BY ALL),
o AS (SELECT page, sum(least(x, y)) / sum(greatest(x, y)) AS occupancy_score, least(sum(x), sum(y)) / greatest(sum(x), sum(y)) AS density_score FROM (SELECT page, row // 4 AS row, col // 4 AS col, sum(x) / 16 AS x, sum(y) / 16 AS y FROM g GROUP BY ALL) GROUP BY page),
rp AS (SELECT page, list(x ORDER BY row) AS x, list(y ORDER BY row) AS y FROM (SELECT page, row, sum(x) OVER w / 7 AS x, sum(y) OVER w / 7 AS y FROM (SELECT page, row, sum(x) AS x, sum(y) AS y FROM g GROUP BY ALL) WINDOW w AS (PARTITION BY page ORDER BY row ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) GROUP BY page),
cp AS (SELECT page, list(x ORDER BY col) AS x, list(y ORDER BY col) AS y FROM (SELECT page, col, sum(x) OVER w / 7 AS x, sum(y) OVER w / 7 AS y FROM (SELECT page, col, sum(x) AS x, sum(y) AS y FROM g GROUP BY ALL) WINDOW w AS (PARTITION BY page ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) GROUP BY page),
rs AS (SELECT page, {_SIMILAR} AS row_score FROM (SELECT *, x AS u, y AS v FROM rp)), cs AS (SELECT page, {_SIMILAR} AS column_score FROM (SELECT *, x AS u, y AS v FROM cp)),
bb AS (SELECT page, min(l) FILTER (side = 1) - min(l) FILTER (side = 0) AS a, min(t) FILTER (side = 1) - min(t) FILTER (side = 0) AS b, max(r) FILTER (side = 1) - max(r) FILTER (side = 0) AS c, max(e) FILTER (side = 1) - max(e) FILTER (side = 0) AS d FROM b GROUP BY page),
z AS (SELECT page, row_score, occupancy_score, column_score, greatest(0, 1 - (abs(a) / 600 + abs(b) / 800 + abs(c) / 600 + abs(d) / 800) / 4 * 5) AS bbox_score, density_score FROM o JOIN rs USING (page) JOIN cs USING (page) JOIN bb USING (page))
SELECT page, round(row_score, 9) AS row_score, round(occupancy_score, 9) AS occupancy_score, round(column_score, 9) AS column_score, round(bbox_score, 9) AS bbox_score, round(density_score, 9) AS density_score, round((row_score * 0.25 + occupancy_score * 0.2 + column_score * 0.1 + bbox_score * 0.05 + density_score * 0.05) / 0.65, 9) AS score FROM z
"""


@query("AGG_26_layout_scores", _SCORES)
def layout_scores(spark, d):
    b = F.col("box")
    rows = boxes(spark, d).select("page", F.when(F.col("id") % 2 == 1, "source").otherwise("output").alias("side"), b["left"].alias("left"), b["top"].alias("top"), S.right(b).alias("right"), S.bottom(b).alias("bottom"))
    out = L.layout_scores(rows, ["page"], 600.0, 800.0)
    return out.select("page", *[F.round(c, 9).alias(c) for c in (*L.WEIGHTS, "score")])
