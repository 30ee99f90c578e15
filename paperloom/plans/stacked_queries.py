"""Rows of torn formulas: ten parts are a document's rows, of four kinds around their sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stacked
from ..registry import query, table

_KINDS = (
    ("값 √", "@", "3□2×5□4", "log2□x+@", "lim", "h→0□", "f(@+h)의", "h", "~", "P(A)=□@"),
    ("@", "x=t3-□2", "b=□2", "@", "@", "2□3", "x□2", "@", " × a", "y=□@+1"),
    ("f(x)={x", "□", "@", "□", "확률은 □p", "서로소인 p+q", "q√@ 와 □p", "@", "=□p", "~"),
    ("√", "@", "@", "lim", "x -> ∞", "x+@의 값은?", "x-1", r"x\to @□", "@", "=□2"),
)
_ROWS = "SELECT p_partkey {div} 10 AS doc, p_partkey % 10 AS pos, replace(replace(CASE " + " ".join(f"WHEN p_partkey {{div}} 10 % 4 = {d} AND p_partkey % 10 = {k} THEN '{t}'" for d, kind in enumerate(_KINDS) for k, t in enumerate(kind)) + " END, '@', CAST(p_size AS VARCHAR(9))), '~', p_name) AS text FROM part"
_W = "[A-Za-z0-9α-ωΑ-Ω∞+\\-.]+"
_PART = "^[A-Za-z0-9α-ωΑ-Ω∞+\\-*/^_(){}\\[\\].]+$"


def _scan(name: str, source: str, width: int) -> str:
    """Relations ``name``: the rows of ``source`` (doc, i, pos, text, back, ahead, gone) after a scan from top to bottom."""
    return rf"""
{name}_s AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(pos BIGINT, text VARCHAR)[]) AS o, 0 AS skip, false AS free FROM {source}
  UNION ALL SELECT s.doc, m.i, CASE WHEN skip > 0 OR gone THEN o WHEN free AND back IS NOT NULL THEN list_append(o[1:len(o) - 1], {{'pos': o[len(o)].pos, 'text': back}}) ELSE list_append(o, {{'pos': m.pos, 'text': coalesce(ahead, m.text)}}) END,
    CASE WHEN skip > 0 THEN skip - 1 WHEN gone OR (free AND back IS NOT NULL) OR ahead IS NULL THEN 0 ELSE {width - 1} END, CASE WHEN skip > 0 THEN false WHEN gone THEN free ELSE NOT (free AND back IS NOT NULL) AND ahead IS NULL END
  FROM {name}_s AS s JOIN {source} AS m ON m.doc = s.doc AND m.i = s.i + 1),
{name} AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY x.pos) AS i, x.pos, x.text, regexp_replace(x.text, '\s+$', '') AS now FROM (SELECT doc, unnest(o) AS x FROM {name}_s QUALIFY i = max(i) OVER (PARTITION BY doc)))"""


def _is_part(c: str) -> str:
    return f"(length({c}) <= 80 AND regexp_matches({c}, '{_PART}'))"


def _open(c: str) -> str:
    return rf"regexp_matches({c}, '^\s*$|[=+\-−*/×÷(<\[{{,:]\s*$')"


def _base(c: str) -> str:
    return rf"(NOT regexp_matches({c}, '[가-힣]|^[①-⑤]') AND NOT {_open(c)} AND regexp_matches({c}, '[A-Za-z0-9α-ωΑ-Ω)\]}}]\s*$'))"


_NEAR = "lead(text) OVER w AS n1r, trim(lead(text) OVER w) AS n1, trim(lead(text, 2) OVER w) AS n2, trim(lead(text, 3) OVER w) AS n3, trim(lag(text) OVER w) AS p1"
_REPAIRED = rf"""
WITH RECURSIVE r0 AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i, CAST(pos AS BIGINT) AS pos, text, regexp_replace(text, '\s+$', '') AS now FROM ({_ROWS.replace("{div}", "//")})),
a1 AS (SELECT *, {_NEAR} FROM r0 WINDOW w AS (PARTITION BY doc ORDER BY i)),
a2 AS (SELECT *, CAST(NULL AS VARCHAR) AS back, false AS gone, regexp_replace(regexp_replace(now, '√$', ''), '\s+$', '') AS head, regexp_extract(n2, '^([0-9]{{1,2}})[□▢]([A-Za-z0-9α-ωΑ-Ω]+)(.*?)([0-9]{{1,4}})[□▢]([0-9]{{1,3}})$', ['a', 'b', 'c', 'd', 'e']) AS g FROM a1),
a3 AS (SELECT * EXCLUDE (g), CASE WHEN ends_with(now, '√') AND regexp_matches(n1, '^[0-9]+$') AND g.a <> '' AND NOT regexp_matches(g.c, '[가-힣]') THEN head || CASE WHEN head <> '' THEN ' ' ELSE '' END || '\sqrt[' || g.a || ']{{' || g.b || '}}' || g.c || g.d || '^{{\frac{{' || n1 || '}}{{' || g.e || '}}}}' END AS ahead FROM a2),
{_scan("r1", "a3", 3)},
l0 AS (SELECT doc, i, pos, regexp_replace(text, '(^|[^A-Za-z\\])log([0-9A-Za-zα-ωΑ-Ω]{{1,4}})[□▢]([A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω]*)', '\1\\log_{{\2}}\3', 'g') AS text FROM r1),
b1 AS (SELECT *, regexp_replace(text, '\s+$', '') AS now, {_NEAR} FROM l0 WINDOW w AS (PARTITION BY doc ORDER BY i)),
b2 AS (SELECT *, CAST(NULL AS VARCHAR) AS back, false AS gone, CASE WHEN strpos(n2, '의 값은?') > 1 THEN strpos(n2, '의 값은?') WHEN strpos(n2, '의 값을') > 1 THEN strpos(n2, '의 값을') WHEN strpos(n2, '의') > 1 THEN strpos(n2, '의') END AS cut FROM b1),
b3 AS (SELECT *, CASE WHEN cut IS NULL THEN n2 ELSE trim(substr(n2, 1, cut - 1)) END AS top, CASE WHEN cut IS NULL THEN '' ELSE trim(substr(n2, cut)) END AS rest FROM b2),
b4 AS (SELECT *, CASE WHEN ends_with(now, 'lim') AND regexp_matches(n1, '^[A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω]*\s*(→|->|\\to)\s*[-+∞A-Za-z0-9α-ωΑ-Ω]+[□▢]*$') AND {_is_part("n3")} AND top <> '' AND NOT regexp_matches(top, '[가-힣]')
  THEN trim(regexp_replace(now, 'lim$', '') || ' \lim_{{' || regexp_replace(replace(regexp_replace(n1, '^[□▢]+|[□▢]+$', '', 'g'), '→', '\to'), '\s+', '', 'g') || '}}\frac{{' || top || '}}{{' || n3 || '}}' || rest) END AS ahead FROM b3),
{_scan("r2", "b4", 4)},
c1 AS (SELECT *, {_NEAR}, regexp_extract(now, '^(.*?)[□▢]({_W})(.*)$', ['a', 'b', 'c']) AS u, regexp_extract(now, '^(.*?)[□▢]({_W})$', ['a', 'b']) AS v, regexp_extract(trim(lead(text) OVER w), '^({_W})(.*)$', ['a', 'b']) AS o, regexp_extract(regexp_replace(lead(text) OVER w, '\s+$', ''), '^(\s*[×*]\s*)([A-Za-z0-9α-ωΑ-Ω]+)$', ['a', 'b']) AS f FROM r2 WINDOW w AS (PARTITION BY doc ORDER BY i)),
c2 AS (SELECT doc, i, pos, text, false AS gone, CASE WHEN u.b <> '' AND trim(u.c) = '' AND {_base("u.a")} AND regexp_matches(u.b, '^[0-9]{{1,3}}$') AND {_is_part("p1")} THEN u.a || '^{{\frac{{' || p1 || '}}{{' || u.b || '}}}}' END AS back,
  CASE WHEN v.b <> '' AND o.a <> '' AND trim(o.b) = '' AND {_base("v.a")} AND regexp_matches(v.b, '^[0-9]{{1,3}}$') AND {_is_part("o.a")} THEN v.a || '^{{\frac{{' || o.a || '}}{{' || v.b || '}}}}'
    WHEN regexp_matches(trim(text), '^[+\-]?[0-9]+$|^[+\-]?\\frac\{{[^{{}}]{{1,40}}\}}\{{[^{{}}]{{1,40}}\}}$') AND f.b <> '' THEN f.a || f.b || '^{{' || trim(text) || '}}' END AS ahead FROM c1),
{_scan("r3", "c2", 2)},
d0 AS (SELECT *, bool_or(regexp_matches(text, 'p\s*\+\s*q|\bp\s*,\s*q\b|p\s*와\s*q')) OVER (PARTITION BY doc) AS pq, coalesce(regexp_matches(trim(text), '^[□▢]+$') AND contains(string_agg(text, chr(10)) OVER c, '{{') AND regexp_matches(string_agg(text, chr(10)) OVER c, '[A-Za-z]\(x\)\s*='), false) AS gone FROM r3 WINDOW c AS (PARTITION BY doc ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
d1 AS (SELECT *, trim(last_value(CASE WHEN NOT gone THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS p1, regexp_extract(now, '^(.*?)[□▢]({_W})(.*)$', ['a', 'b', 'c']) AS u, regexp_extract(now, '^(.*?)[□▢]({_W})$', ['a', 'b']) AS v, regexp_extract(trim(lead(text) OVER w), '^({_W})(.*)$', ['a', 'b']) AS o FROM d0 WINDOW w AS (PARTITION BY doc ORDER BY i)),
d2 AS (SELECT doc, i, pos, text, gone, CASE WHEN NOT gone AND u.b <> '' AND {_open("u.a")} AND NOT regexp_matches(u.a, '[가-힣]') AND {_is_part("p1")} AND (trim(u.c) = '' OR NOT regexp_matches(trim(u.c), '^[(\[{{]|[□▢]')) AND NOT (pq AND u.b = 'p') THEN regexp_replace(u.a || '\frac{{' || p1 || '}}{{' || u.b || '}}' || u.c, '\s+$', '') END AS back,
  CASE WHEN NOT gone AND v.b <> '' AND o.a <> '' AND {_open("v.a")} AND (trim(o.b) = '' OR NOT regexp_matches(trim(o.b), '^[(\[{{]|[□▢]')) AND NOT (pq AND v.b = 'p') THEN regexp_replace(v.a || '\frac{{' || o.a || '}}{{' || v.b || '}}' || o.b, '\s+$', '') END AS ahead FROM d1),
{_scan("r4", "d2", 2)},
e AS (SELECT doc, pos, CASE WHEN bool_or(contains(text, '서로소')) OVER (PARTITION BY doc) AND bool_or(regexp_matches(text, 'p\s*\+\s*q|\bp\s*,\s*q\b|p\s*와\s*q')) OVER (PARTITION BY doc) AND NOT regexp_matches(text, '(q√|q\\sqrt|qπ|q\\pi).{{0,78}}[□▢]p') THEN regexp_replace(text, '[□▢]p($|[^A-Za-z0-9α-ωΑ-Ω])', '\\frac{{p}}{{q}}\1', 'g') ELSE text END AS text FROM r4)
SELECT doc, pos, regexp_replace(regexp_replace(text, '([A-Za-z0-9α-ωΑ-Ω]+\s*(?:→|->|\\to)\s*[-+∞A-Za-z0-9α-ωΑ-Ω]+)[□▢]+', '\1', 'g'), '(^|[=(:,+\-*/<>≤≥]\s*)[□▢]([0-9]{{1,3}})($|[^0-9])', '\1\\frac{{1}}{{\2}}\3', 'g') AS text FROM e
"""


@query("STR_2_layout_rows", _REPAIRED)
def layout_rows(spark, d):
    sql = _ROWS.replace("{div}", "DIV").replace("={x", "={{x").replace("x\\to", "x\\\\to").replace("FROM part", "FROM {t}")
    return stacked.repaired(spark.sql(sql, t=table(spark, d, "part")), ["doc"])
