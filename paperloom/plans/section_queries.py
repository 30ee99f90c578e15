"""Answer sections: a conversation is a document, its turns are questions that count on between sections of two kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections
from ..registry import query, table

_SAID = """CASE WHEN conv_id % 3 = 0 AND turn % 5 = 3 THEN '빠른 정답' WHEN conv_id % 3 = 0 AND turn % 5 = 4 THEN (turn {div} 5 * 3 + 4) || '. ③' WHEN conv_id % 3 = 0 THEN (turn {div} 5 * 3 + turn % 5 + 1) || '. ' || text
  WHEN conv_id % 3 = 1 AND turn % 4 = 2 THEN '2025학년도 모의고사 정답 및 해설' WHEN conv_id % 3 = 1 AND turn % 4 = 3 THEN CASE WHEN conv_id % 2 = 0 THEN '1. ③ 2. ⑤' ELSE '1. ③' END WHEN conv_id % 3 = 1 THEN (turn {div} 4 * 2 + turn % 4 + 1) || ') ' || text
  WHEN turn = 0 THEN '정답 및 해설' WHEN turn % 3 = 2 THEN '[정답] ③' ELSE turn || '. ' || text END"""
_ROWS = f"SELECT conv_id, turn, {_SAID} AS said FROM conversations WHERE text IS NOT NULL"
_NUMBER = "regexp_extract(said, '^[ \t]*(?:문제[ \t]*)?([0-9]{1,3})[ \t]*[.)]([^0-9]|$)', 1)"
_HEADING = "빠른[ \t]*정답|정답[ \t]*및[ \t]*해설|정답[ \t]*과[ \t]*해설|정답[ \t]*표"
_SECTIONS = f"""
WITH RECURSIVE p AS (SELECT conv_id, turn, said, CAST(nullif({_NUMBER}, '') AS INTEGER) AS number, regexp_matches(said, '^[ \t]*[0-9]{{1,3}}[ \t]*[.)][ \t]*[①-⑨]') AS answer, row_number() OVER w AS i, string_split(said, chr(10))[1] AS first,
  array_to_string(list_concat(string_split(said, chr(10))[2:], list(said) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)), chr(10)) AS rest FROM ({_ROWS.format(div="//")}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT *, number IS NULL AND (regexp_matches(first, '^({_HEADING})') OR (length(first) <= 60 AND NOT contains(first, '?') AND regexp_matches(first, '({_HEADING})$') AND NOT regexp_matches(trim(rest), '^[①-⑨]')
  AND len(list_distinct(list_transform(regexp_extract_all(' ' || rest, '[^0-9.]([0-9]{{1,3}})\\s*[.):]?\\s*[①-⑨]', 1), lambda n: CAST(n AS INTEGER)))) >= 2)) AS opens FROM p),
s AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS turn, 0 AS top, CAST(NULL AS BIGINT) AS section FROM q
  UNION ALL SELECT conv_id, i, turn, CASE WHEN section IS NULL THEN greatest(top, coalesce(number, 0)) ELSE top END, section
  FROM (SELECT q.conv_id, q.i, q.turn, q.number, s.top, CASE WHEN s.section IS NOT NULL THEN CASE WHEN coalesce(q.number, 0) = s.top + 1 AND NOT q.answer THEN NULL ELSE s.section END WHEN s.top > 0 AND q.opens THEN q.turn END AS section FROM s JOIN q ON q.conv_id = s.conv_id AND q.i = s.i + 1))
SELECT conv_id, turn, section FROM s WHERE i > 0
"""


@query("WIN_4_answer_sections", _SECTIONS)
def answer_sections(spark, d):
    said = F.expr(_SAID.format(div="DIV"))
    rows = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.col("turn").alias("pos"), said.alias("text"))
    return sections.answer_sections(rows, ["conv_id"]).select("conv_id", "turn", "section")
