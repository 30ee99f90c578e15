"""Automatic numbers: a conversation is a document, a turn a paragraph of one of two numberings (or of none), at a level by its length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import numbering
from ..registry import query, table

HEADS = (("a", 1, "DIGIT", "제^1장", 1), ("a", 2, "LATIN_SMALL", "^1.^2)", 1), ("a", 3, "CIRCLED_DIGIT", " ^3^ ", 3), ("b", 1, "ROMAN_CAPITAL", "^1.", 4), ("b", 3, "DIGIT", "(^1-^2-^3)", 1))
_ROMAN = "CASE WHEN {v} > 3999 THEN CAST({v} AS VARCHAR) ELSE ['', 'M', 'MM', 'MMM'][{v} // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][{v} // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][{v} // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][{v} % 10 + 1] END"
_ROWS = "SELECT conv_id, turn, length(text) % 3 + 1 AS level, CASE length(text) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'b' WHEN 2 THEN 'b' ELSE 'a' END AS numbering FROM conversations"
_LABELS = f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, numbering ORDER BY turn) AS i FROM ({_ROWS}) WHERE numbering IS NOT NULL),
n AS (SELECT DISTINCT conv_id, numbering, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS level, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS z FROM p
  UNION ALL SELECT p.conv_id, p.numbering, p.i, p.turn, p.level, CASE WHEN p.level = 1 THEN x + 1 ELSE x END, CASE WHEN p.level = 1 THEN 0 WHEN p.level = 2 THEN y + 1 ELSE y END, CASE WHEN p.level < 3 THEN 0 ELSE z + 1 END FROM n JOIN p ON p.conv_id = n.conv_id AND p.numbering = n.numbering AND p.i = n.i + 1),
v AS (SELECT *, greatest(x, 1) AS vx, greatest(y, 1) AS vy, greatest(z, 1) AS vz FROM n WHERE i > 0)
SELECT conv_id, turn, CASE WHEN numbering = 'a' THEN CASE level WHEN 1 THEN '제' || vx || '장' WHEN 2 THEN vx || '.' || chr(97 + CAST((vy - 1) % 26 AS INTEGER)) || ')' ELSE CASE WHEN vz + 2 <= 20 THEN chr(CAST(9311 + vz + 2 AS INTEGER)) WHEN vz + 2 <= 35 THEN chr(CAST(12881 + vz + 2 - 21 AS INTEGER)) ELSE '(' || (vz + 2) || ')' END END
  ELSE CASE level WHEN 1 THEN {_ROMAN.format(v="(vx + 3)")} || '.' WHEN 2 THEN vy || '.' ELSE '(' || {_ROMAN.format(v="(vx + 3)")} || '-' || vy || '-' || vz || ')' END END AS label FROM v
UNION ALL SELECT conv_id, turn, '' FROM ({_ROWS}) WHERE numbering IS NULL
"""


@query("WIN_10_automatic_numbers", _LABELS)
def automatic_numbers(spark, d):
    n = F.length("text")
    kind = F.when(n % 7 == 0, None).when((n % 7).isin(1, 2), "b").otherwise("a")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("pos"), (n % 3 + 1).cast("int").alias("level"), kind.alias("numbering"))
    heads = spark.createDataFrame(HEADS, "numbering string, level int, kind string, template string, start int")
    return numbering.numbered(rows, heads, ["conv_id"]).select("conv_id", "turn", "label")
