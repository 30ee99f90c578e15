"""Object streams: a conversation is a document of one of three forms, a turn one of its objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import object_stream
from ..registry import query, table

_BASE = "trim(regexp_replace(substr(text, 1, 30), '[^A-Za-z ]', ''{g}))"
_SAID = f"""CASE conv_id % 3
  WHEN 0 THEN CASE WHEN turn % 8 = 4 THEN '[출제의도] 셈하기' WHEN turn % 4 = 0 THEN concat({_BASE}, '? [3점]') WHEN turn % 4 = 1 THEN '① a ② b ③ c ④ d ⑤ e ⑥ f' WHEN turn % 4 = 3 THEN concat('[2024년 고3 수능 ', turn {{div}} 4 + 1, '번]') END
  WHEN 1 THEN CASE turn % 4 WHEN 0 THEN {_BASE} WHEN 1 THEN CASE WHEN turn % 8 = 5 THEN 'more' END WHEN 2 THEN concat('[3점][시험 0', turn {{div}} 4 + 1, ']') ELSE CASE WHEN turn % 8 = 3 THEN '① a ② b ③ c ④ d ⑤ e' ELSE '① a ② b ③ c ④ d ⑤ e ⑥ f' END END
  ELSE CASE WHEN turn % 3 = 2 THEN concat('[', turn - turn {{div}} 3 + 1, '~', turn - turn {{div}} 3 + 2, '] 다음 글을 읽고', chr(10), {_BASE}) ELSE concat(turn - turn {{div}} 3 + 1, '. ', {_BASE}, chr(10), '① 가 ② 나') END END"""
_SQL = f"""
WITH s AS (SELECT conv_id, turn, {_SAID.format(div="//", g=", 'g'")} AS said, {_BASE.format(g=", 'g'")} AS base FROM conversations WHERE text IS NOT NULL),
t AS (SELECT conv_id, turn // 4 AS place0, coalesce(max(CASE WHEN turn % 4 = 0 AND turn % 8 <> 4 THEN base || '?' END), '') AS stem, bool_or(turn % 4 = 0 AND turn % 8 <> 4) AS scored, bool_or(turn % 4 = 1) AS chosen, list('img' || turn) FILTER (turn % 4 = 2) AS images, bool_or(turn % 8 = 4) AS told, max(turn) AS last FROM s WHERE conv_id % 3 = 0 GROUP BY ALL),
a AS (SELECT conv_id, 'trailing' AS mode, place0, CAST(place0 + 1 AS VARCHAR) AS number, CASE WHEN scored THEN '[3점]' ELSE '' END || '[2024년 고3 수능 ' || (place0 + 1) || '번]' AS unit, CASE WHEN scored THEN '3' ELSE '' END AS score, CASE WHEN lead(told) OVER (PARTITION BY conv_id ORDER BY place0) THEN '셈하기' ELSE '' END AS intent,
  stem, CASE WHEN chosen THEN ['a', 'b', 'c', 'd', 'e'] ELSE [] END AS choices, coalesce(images, []) AS images, CAST(0 AS BIGINT) AS tables, false AS is_passage, last % 4 = 3 AS closed FROM t),
m AS (SELECT conv_id, 'markers' AS mode, turn // 4 AS place0, CASE WHEN bool_or(turn % 4 = 2) THEN CAST(turn // 4 + 1 AS VARCHAR) ELSE '' END AS number, coalesce(max(CASE WHEN turn % 4 = 2 THEN said END), '') AS unit, CASE WHEN bool_or(turn % 4 = 2) THEN '3' ELSE '' END AS score, '' AS intent,
  coalesce(trim(string_agg(nullif(said, ''), chr(10) ORDER BY turn) FILTER (turn % 4 < 2 AND said IS NOT NULL), chr(10) || ' '), '') AS stem, CASE WHEN bool_or(turn % 4 = 3) THEN ['a', 'b', 'c', 'd', 'e'] ELSE [] END AS choices, CAST([] AS VARCHAR[]) AS images, count(*) FILTER (turn % 8 = 1) AS tables, false AS is_passage, max(bool_or(turn % 4 = 2)) OVER (PARTITION BY conv_id) AS closed FROM s WHERE conv_id % 3 = 1 GROUP BY conv_id, turn // 4),
p AS (SELECT conv_id, 'paragraphs' AS mode, turn AS place0, CASE WHEN turn % 3 = 2 THEN regexp_extract(said, '^(.*?\\])', 1) ELSE regexp_extract(said, '^([0-9]+)', 1) END AS number, '' AS unit, '' AS score, '' AS intent, trim(CASE WHEN turn % 3 = 2 THEN said ELSE string_split(said, chr(10))[1] END, chr(10) || ' ') AS stem, CASE WHEN turn % 3 = 2 THEN [] ELSE ['가', '나'] END AS choices, CAST([] AS VARCHAR[]) AS images, CAST(0 AS BIGINT) AS tables, turn % 3 = 2 AS is_passage,
  (turn % 3 <> 2 OR turn < max(turn) OVER (PARTITION BY conv_id)) AND count(*) FILTER (turn % 3 <> 2) OVER (PARTITION BY conv_id) > 1 AS closed FROM s WHERE conv_id % 3 = 2),
u AS (SELECT * FROM a UNION ALL SELECT * FROM m UNION ALL SELECT * FROM p)
SELECT conv_id, mode, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place0) AS INTEGER) AS place, number, unit, score, intent, stem, choices, images, tables, is_passage FROM u WHERE closed AND (stem <> '' OR len(choices) > 0 OR len(images) > 0 OR tables > 0)
"""


@query("SRC_9_object_streams", _SQL)
def object_streams(spark, d):
    said = F.expr(_SAID.format(div="DIV", g="").replace("chr(10)", "char(10)"))
    image, cells = (F.col("conv_id") % 3 == 0) & (F.col("turn") % 4 == 2), (F.col("conv_id") % 3 == 1) & (F.col("turn") % 8 == 1)
    kind = F.when(image, "image").when(cells, "table").otherwise("text")
    value = F.when(image, F.concat(F.lit("img"), F.col("turn"))).otherwise(said)
    grid = F.when(cells, F.array(F.array(F.lit("x"), F.col("role")), F.array(F.lit("1"))))
    rows = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", F.col("turn").alias("pos"), kind.alias("kind"), value.alias("value"), grid.alias("cells"))
    return object_stream.questions(rows, ["conv_id"])
