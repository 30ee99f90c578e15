"""Queries of one-use matching: donors below places on pages, tables of conversations, fractions in choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..registry import query, table
from .segment_queries import _SQL_PARTS, boxes


@query("JOIN_11_nearest_donors", f"WITH RECURSIVE p AS ({_SQL_PARTS}), w AS (SELECT page, id, l AS x, t AS y, row_number() OVER (PARTITION BY page ORDER BY t, l, id) AS i FROM p WHERE id % 2 = 1), g AS (SELECT page, list({{'x': l, 'y': t, 'id': id}}) FILTER (id % 2 = 0) AS given FROM p GROUP BY page), m AS (SELECT page, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS donor FROM g UNION ALL SELECT page, i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, id, best FROM (SELECT w.page, w.i, m.used, w.id, list_sort(list_transform(list_filter(given, lambda d: NOT list_contains(used, d.id) AND d.y > y AND d.y - y <= 60 AND abs(d.x - x) <= 90), lambda d: {{'dy': d.y - y, 'dx': abs(d.x - x), 'x': d.x, 'id': d.id}}))[1].id AS best FROM m JOIN w ON w.page = m.page AND w.i = m.i + 1 JOIN g ON g.page = m.page)) SELECT page, id, donor FROM m WHERE i > 0")
def donors(spark, d):
    places = boxes(spark, d).select("page", "id", F.col("box.left").alias("x"), F.col("box.top").alias("y"))
    wanted, given = places.where("id % 2 = 1").withColumnRenamed("id", "wanted"), places.where("id % 2 = 0").withColumnRenamed("id", "donor")
    return M.nearest_donors(wanted, given, ["page"], 90.0, 60.0).withColumnRenamed("wanted", "id")


#: Each turn's table has one row of three counts, and of every third text's length one more of two; its box goes by turn and length.
_TABLES = "SELECT conv_id, turn, role, CASE WHEN length(text) % 3 = 0 THEN [[length(text) % 3, (length(text) - length(replace(text, ' ', ''))) % 4, (length(text) - length(replace(text, 'e', ''))) % 3], [length(text) % 5, turn % 2]] ELSE [[length(text) % 3, (length(text) - length(replace(text, ' ', ''))) % 4, (length(text) - length(replace(text, 'e', ''))) % 3]] END AS cells, CAST(length(text) % 40 AS DOUBLE) AS l, CAST(turn * 7 % 60 AS DOUBLE) AS t FROM conversations"
_MATCHED = f"""
WITH RECURSIVE t AS ({_TABLES}), s AS (SELECT conv_id, turn, cells, turn % 3 * 10.0 AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t WHERE role = 'user'),
o AS (SELECT conv_id, coalesce(list({{'turn': turn, 'cells': cells, 'l': l, 't': t}}) FILTER (role IS DISTINCT FROM 'user'), []) AS given FROM t GROUP BY conv_id),
m AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS partner, CAST(NULL AS BIGINT) AS different FROM o
  UNION ALL SELECT conv_id, i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.turn) END, turn, best.turn, coalesce(best.n, len(flatten(cells)))
  FROM (SELECT s.conv_id, s.i, m.used, s.turn, s.cells, list_sort(list_transform(list_filter(given, lambda d: NOT list_contains(used, d.turn) AND list_transform(d.cells, lambda r: len(r)) = list_transform(s.cells, lambda r: len(r))
    AND greatest(0, least(d.l + 50, x + 90) - greatest(d.l, x)) * greatest(0, least(d.t + 40, 100) - greatest(d.t, 0)) >= 0.9 * 50 * 40),
    lambda d: {{'n': CAST(len(list_filter(range(1, len(flatten(d.cells)) + 1), lambda k: flatten(d.cells)[k] <> flatten(s.cells)[k])) AS BIGINT), 'turn': CAST(d.turn AS BIGINT)}}))[1] AS best
    FROM m JOIN s ON s.conv_id = m.conv_id AND s.i = m.i + 1 JOIN o ON o.conv_id = m.conv_id) AS q)
SELECT conv_id, turn, partner, different FROM m WHERE i > 0
"""


@query("JOIN_17_table_matches", _MATCHED)
def table_matches(spark, d):
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    words = lambda *cells: F.array(*[c.cast("string") for c in cells])
    first, second = words(F.length("text") % 3, count(" ") % 4, count("e") % 3), words(F.length("text") % 5, F.col("turn") % 2)
    cells = F.when(F.length("text") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    box = lambda left, top, width, height: F.struct(*[c.cast("double").alias(n) for c, n in ((left, "left"), (top, "top"), (F.lit(width), "width"), (F.lit(height), "height"))])
    t = table(spark, d, "conversations").withColumn("cells", cells).withColumn("place", F.col("turn"))
    source = t.where("role = 'user'").select("conv_id", F.col("turn").alias("wanted"), "place", "cells", box(F.col("turn") % 3 * 10, F.lit(0), 90, 100).alias("region"))
    output = t.where("role <> 'user' OR role IS NULL").select("conv_id", F.col("turn").alias("donor"), "place", "cells", box(F.length("text") % 40, F.col("turn") * 7 % 60, 50, 40).alias("box"))
    return M.table_matches(source, output, ["conv_id"]).select("conv_id", F.col("wanted").alias("turn"), F.col("donor").alias("partner"), "different")


#: Twenty parts are a question's lines: five labels in a row, five numerators above, five denominators below, and others; they
#: stand near their columns, which a part's size moves.
_LINES = """SELECT id, q, slot, k, size, CASE WHEN slot < 5 THEN substr('①②③④⑤', k + 1, 1) || CASE (q + k * 7) % 11 WHEN 0 THEN '□' WHEN 1 THEN '8' WHEN 2 THEN '-□' WHEN 3 THEN '2□' WHEN 4 THEN '' WHEN 5 THEN ' -' WHEN 6 THEN '□' || size WHEN 7 THEN '-x' WHEN 8 THEN '가 나' WHEN 9 THEN ' □' ELSE '+□4' END
  WHEN slot < 10 THEN CASE WHEN size % 9 = 0 THEN 'a b' ELSE CAST(size AS VARCHAR(9)) || CASE WHEN size % 4 = 0 THEN 'π' ELSE '' END END WHEN slot < 15 THEN CASE WHEN size % 8 = 0 THEN '다음' ELSE CAST(size % 7 + 2 AS VARCHAR(9)) END WHEN slot = 15 THEN '15. ' || p_name WHEN slot = 16 THEN 'x+1' ELSE p_name END AS said,
  CASE WHEN slot < 15 THEN 220 + k * (60 + q % 3 * 30) + size % 5 * CASE WHEN q % 2 = 0 THEN 0 ELSE 11 END ELSE slot * 30 END AS l, CASE WHEN slot < 5 THEN 120 + q % 4 WHEN slot < 10 THEN 100 - size % 3 * 9 WHEN slot < 15 THEN 145 + size % 4 * 9 ELSE slot * 10 END AS t, CASE WHEN slot < 5 THEN 66 ELSE 48 END AS w
  FROM (SELECT p_partkey AS id, p_partkey {div} 20 AS q, p_partkey % 20 AS slot, p_partkey % 5 AS k, p_size AS size, p_name FROM part)"""
_PART = r"^[A-Za-z0-9α-ωΑ-Ωπ∞√∑∫+\-./*(){}\[\]\\_=^]+$"
_WORD = r"[A-Za-z0-9α-ωΑ-Ωπ∞+\-.]+"
_FRACTIONS = rf"""
WITH RECURSIVE n AS (SELECT id, q, trim(said) AS said, l + w / 2.0 AS x, CAST(t AS DOUBLE) AS y, regexp_extract(trim(said), '^([①②③④⑤])', 1) AS label, trim(regexp_replace(trim(said), '^[①②③④⑤]', '')) AS body FROM ({_LINES.format(div="//")})),
lb AS (SELECT *, strpos('①②③④⑤', label) AS r, body IN ('-', '−', '+') AS sign, regexp_matches(body, '[□▢]') AS boxed FROM n WHERE label <> '' AND (SELECT count(*) FROM n m WHERE m.q = n.q AND m.label <> '') >= 2),
w AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r, id, side) AS i FROM (SELECT *, unnest(CASE WHEN boxed OR body = '' OR sign THEN [0, 1] WHEN NOT sign AND regexp_matches(regexp_replace(body, '^[-−+]+', ''), '{_PART}') THEN [0] ELSE [] END) AS side FROM lb)),
g AS (SELECT q, coalesce(list({{'id': id, 'x': x, 'y': y}}) FILTER (label = '' AND regexp_matches(said, '{_PART}') AND length(said) <= 80), []) AS given FROM n GROUP BY q),
m AS (SELECT q, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS label_id, 0 AS side, CAST(NULL AS BIGINT) AS part FROM g
  UNION ALL SELECT q, i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, id, side, best FROM (SELECT w.q, w.i, m.used, w.id, w.side, list_sort(list_transform(list_filter(given, lambda d: NOT list_contains(used, d.id) AND abs(d.x - w.x) <= 90 AND (d.y - w.y) * (w.side * 2 - 1) > 0 AND (d.y - w.y) * (w.side * 2 - 1) <= 60), lambda d: {{'dy': abs(d.y - w.y), 'dx': abs(d.x - w.x), 'id': d.id}}))[1].id AS best FROM m JOIN w ON w.q = m.q AND w.i = m.i + 1 JOIN g ON g.q = m.q)),
s AS (SELECT lb.q, lb.r, lb.id, lb.body, max(a.said) AS top, max(b.said) AS below FROM lb LEFT JOIN m ma ON ma.label_id = lb.id AND ma.side = 0 LEFT JOIN n a ON a.id = ma.part LEFT JOIN m mb ON mb.label_id = lb.id AND mb.side = 1 LEFT JOIN n b ON b.id = mb.part GROUP BY ALL),
c AS (SELECT q, r, id, CASE WHEN regexp_matches(body, '[□▢]') THEN
    CASE WHEN regexp_matches(body, '^{_WORD}\s*[□▢]({_WORD})?$') AND top IS NOT NULL AND below IS NOT NULL AND regexp_matches(regexp_extract(body, '^({_WORD})\s*[□▢]', 1), '[A-Za-z0-9α-ωΑ-Ωπ∞]') THEN regexp_extract(body, '^({_WORD})\s*[□▢]', 1) || '^{{\frac{{' || top || '}}{{' || below || '}}}}'
      WHEN regexp_matches(body, '^-?\s*[□▢]({_WORD})?$') AND coalesce(below, nullif(regexp_extract(body, '[□▢]({_WORD})?$', 1), '')) IS NOT NULL THEN regexp_extract(body, '^(-?)', 1) || '\frac{{' || coalesce(top, '1') || '}}{{' || coalesce(below, regexp_extract(body, '[□▢]({_WORD})?$', 1)) || '}}' ELSE body END
    WHEN top IS NOT NULL AND regexp_matches(regexp_replace(body, '^[-−]\s*', ''), '{_PART}') THEN CASE WHEN regexp_matches(body, '^[-−]') THEN '-' ELSE '' END || '\frac{{' || top || '}}{{' || regexp_replace(body, '^[-−]\s*', '') || '}}'
    WHEN top IS NOT NULL AND below IS NOT NULL AND body IN ('', '-', '−', '+') THEN CASE WHEN body IN ('-', '−') THEN '-' ELSE '' END || '\frac{{' || top || '}}{{' || below || '}}' ELSE body END AS choice FROM s),
e AS (SELECT q, list(CASE WHEN regexp_matches(choice, '^-?\s*[□▢][0-9]{{1,3}}$') THEN regexp_extract(choice, '^(-?)', 1) || '\frac{{1}}{{' || regexp_extract(choice, '([0-9]{{1,3}})$', 1) || '}}' ELSE choice END ORDER BY r) AS choices FROM c GROUP BY q),
st AS (SELECT q, string_agg(said, chr(10) ORDER BY id) AS stem FROM n WHERE label = '' AND id NOT IN (SELECT part FROM m WHERE part IS NOT NULL) GROUP BY q)
SELECT q AS question, coalesce(stem, '') AS stem, choices FROM e LEFT JOIN st USING (q) WHERE len(choices) >= 2
"""


@query("STR_10_choice_fractions", _FRACTIONS)
def choice_fractions(spark, d):
    rows = spark.sql(_LINES.format(div="DIV").replace("FROM part", "FROM {t}"), t=table(spark, d, "part"))
    box = F.struct(*[F.col(c).cast("double").alias(n) for c, n in (("l", "left"), ("t", "top"), ("w", "width"))], F.lit(24.0).alias("height"))
    lines = rows.select(F.col("q").alias("question"), F.col("id").alias("place"), F.col("said").alias("text"), box.alias("box"))
    return M.choice_fractions(lines, ["question"])
