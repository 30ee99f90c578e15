"""Queries over recognised pages: page files that Spark derives from the parts, read by the page source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.choices import split_choices
from ..operators import pages as P
from ..operators import segment as S
from ..registry import query, table
from ..session import scratch_dir
from ..sources.pages import register

#: A part is a line: twenty a page, on two of three pages in two columns; what it says goes by its place.
_PLACED = "SELECT p_partkey AS id, p_partkey {div} 20 AS page, p_partkey % 20 AS slot, p_partkey % 10 AS k, CASE WHEN p_partkey {div} 20 % 3 > 0 THEN 1 ELSE 0 END AS two, 1 + p_partkey {div} 20 % 7 * 2 + p_partkey % 20 {div} 10 * 3 AS q, p_name, p_brand FROM part"
_SAID = """CASE k WHEN 0 THEN q || '. ' || p_name || '?' WHEN 1 THEN '1) ' || p_brand WHEN 2 THEN '2) ' || p_brand WHEN 3 THEN '3) ' || p_brand
  WHEN 4 THEN CASE page % 4 WHEN 0 THEN (q + 1) || '. ' || p_name WHEN 1 THEN p_name WHEN 2 THEN '① ' || p_brand || ' ② x' ELSE '1. ' || p_name END
  WHEN 5 THEN CASE WHEN page % 2 = 0 THEN '① a ② b  ③' ELSE '1 one 2 two 3 three' END WHEN 6 THEN CASE WHEN page % 5 = 2 THEN '2024. 3. 5. ' || p_name ELSE p_name END WHEN 7 THEN CASE WHEN page % 2 = 0 THEN (q + 2) || ') ' || p_name ELSE '4) ' || p_brand END
  WHEN 8 THEN CASE WHEN page % 5 = 0 THEN '1. small ' || p_brand ELSE '2. ' || p_brand END ELSE CASE WHEN two = 0 THEN CAST(page % 500 AS VARCHAR(9)) WHEN page % 6 = 1 THEN '저작권 ' || p_name ELSE p_name END END"""
_DRAWN = f"SELECT *, {_SAID} AS said, 40 + two * (slot {{div}} 10) * 280 + CASE WHEN k BETWEEN 1 AND 3 THEN 18 WHEN k = 8 THEN id % 5 ELSE 0 END AS l, CASE two WHEN 1 THEN 60 + k * 72 ELSE 60 + slot * 37 END AS t, CASE k WHEN 8 THEN 7 ELSE 11 END AS h FROM ({_PLACED})"


def page_files(spark, d) -> str:
    """Write the pages as JSON lines to the shared folder, and return the folder."""
    drawn = spark.sql(_DRAWN.format(div="DIV").replace("FROM part", "FROM {t}"), t=table(spark, d, "part"))
    bbox = F.array(*[F.col(c).cast("double") for c in ("l", "t")], (F.col("l") + 5 * F.length("said")).cast("double"), (F.col("t") + F.col("h")).cast("double"))
    line = F.struct(bbox.alias("bbox"), F.array(F.struct(F.col("said").alias("text"), F.lit("F").alias("font"), F.col("h").cast("double").alias("size"), bbox.alias("bbox"))).alias("spans"))
    around = lambda k, *edges: F.when(F.col("k") == k, F.array(*[(F.col(c) + by).cast("double") for c, by in edges]))
    small = F.when(F.col("page") % 5 == 0, around(8, ("l", -10), ("t", -20), ("l", 250), ("t", 20)))
    tall = F.when(F.col("page") % 4 == 1, around(6, ("l", 20), ("t", 15), ("l", 160), ("t", 60)))
    rows = drawn.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("lines"), F.sort_array(F.collect_list(F.coalesce(small, tall))).alias("drawings"))
    page = F.struct(F.concat(F.lit("d"), (F.col("page") % 3).cast("string")).alias("doc_id"), "page", F.lit(595).alias("width"), F.lit(842).alias("height"), F.array(F.struct(F.transform("lines", lambda x: x["line"]).alias("lines"))).alias("blocks"), "drawings")
    folder = scratch_dir(spark, "pages")
    rows.select(F.to_json(page).alias("value")).write.text(folder)
    return folder


def read_pages(spark, d) -> DataFrame:
    register(spark)
    fields = "doc_id string, page int, page_width double, page_height double, lines array<struct<line_no:int,text:string,box:struct<left:double,top:double,width:double,height:double>>>, figures array<struct<left:double,top:double,width:double,height:double>>, reason string"
    return spark.read.format("pages").schema(fields).option("dpi", "72").load(page_files(spark, d)).where("reason IS NULL")


#: Lines (key, i, raw) of texts in a relation ``x`` to stem and choices by key.
_SPLIT = rf"""
x1 AS (SELECT key, i, rtrim(raw, ' ' || chr(9)) AS raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, i = 1 AND regexp_extract(raw, '^[ \t]*(?:문제[ \t]*)?([0-9]{{1,3}})[ \t]*[.)]([0-9]?)', 1) <> '' AND regexp_extract(raw, '^[ \t]*(?:문제[ \t]*)?([0-9]{{1,3}})[ \t]*[.)]([0-9]?)', 2) = '' AS own FROM x),
x2 AS (SELECT *, regexp_extract(line, '^([①-⑨❶-❾➀-➈])\s*\S', 1) AS g1, regexp_extract(line, '^\(?([1-9])[.)]\s*\S', 1) AS g2, regexp_extract(line, '^([a-eA-E])[.)]\s*\S', 1) AS g3, regexp_extract(line, '^([1-5])[ \t]\s*\S', 1) AS g4,
  regexp_replace(line, '^(?:[①-⑨❶-❾➀-➈]|\(?[1-9][.)]|[a-eA-E][.)]|[1-5][ \t])\s*', '') AS rest, string_split_regex(line, '\s+') AS toks, regexp_extract_all(line, '[①-⑨❶-❾➀-➈][^①-⑨❶-❾➀-➈]*') AS marked FROM x1),
x3 AS (SELECT *, CASE WHEN own THEN NULL WHEN g1 <> '' THEN 'circled' WHEN g2 <> '' THEN 'dotted' WHEN g3 <> '' THEN 'letter' WHEN g4 <> '' THEN 'bare' END AS kind, CAST(CASE WHEN g2 <> '' THEN g2 WHEN g4 <> '' THEN g4 ELSE '0' END AS INTEGER) AS number,
  list_filter(range(1, len(toks) + 1), lambda j: regexp_full_match(toks[j], '\([1-5]\)|\([1-5]|[1-5][.)]|[1-5]\.\)|[1-5]')) AS ats FROM x2),
x4 AS (SELECT *, list_transform(ats, lambda j: regexp_extract(toks[j], '[1-5]')) AS nums FROM x3),
x5 AS (SELECT key, i, raw, kind, number, rest, CASE WHEN len(marked) > 1 THEN list_transform(marked, lambda c: CASE WHEN trim(substr(c, 2)) <> '' THEN trim(substr(c, 2)) ELSE c[1] END)
  WHEN nums[1:3] = ['1', '2', '3'] AND list_sort(list_distinct(nums)) = nums THEN list_transform(range(1, len(ats) + 1), lambda j: CASE WHEN coalesce(ats[j + 1], len(toks) + 1) > ats[j] + 1 THEN array_to_string(toks[ats[j] + 1:coalesce(ats[j + 1] - 1, len(toks))], ' ') ELSE nums[j] END) ELSE [] END AS inline,
  CASE WHEN len(marked) > 1 THEN trim(regexp_extract(line, '^[^①-⑨❶-❾➀-➈]*')) WHEN nums[1:3] = ['1', '2', '3'] AND list_sort(list_distinct(nums)) = nums THEN array_to_string(toks[1:ats[1] - 1], ' ') ELSE '' END AS before,
  coalesce(kind || number, '') AS one, coalesce(lead(kind || number) OVER w, '') AS two, coalesce(lead(kind || number, 2) OVER w, '') AS three FROM x4 WINDOW w AS (PARTITION BY key ORDER BY i)),
x6 AS (SELECT *, coalesce(one = kind || '1' AND two = kind || '2' AND three = kind || '3', false) AS begins FROM x5),
y AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS stem, CAST([] AS VARCHAR[]) AS choices FROM x
  UNION ALL SELECT key, i, CASE WHEN len(inline) > 0 THEN CASE WHEN before <> '' THEN list_append(stem, before) ELSE stem END WHEN taken THEN stem ELSE list_append(stem, raw) END, CASE WHEN len(inline) > 0 THEN list_concat(choices, inline) WHEN taken THEN list_append(choices, rest) ELSE choices END
  FROM (SELECT x6.*, y.stem, y.choices, coalesce(kind IN ('circled', 'letter') OR (kind = 'dotted' AND len(choices) > 0 AND number = len(choices) + 1) OR (kind = 'bare' AND len(choices) > 0) OR (begins AND len(choices) = 0), false) AS taken FROM y JOIN x6 ON x6.key = y.key AND x6.i = y.i + 1)),
z AS (SELECT key, regexp_replace(regexp_replace(regexp_replace(array_to_string(stem, chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS stem, choices FROM y QUALIFY i = max(i) OVER (PARTITION BY key))
"""


#: Choices by circled digits, letters, numbers, within lines and as lines, by turn.
_CHOSEN = """CASE turn % 6 WHEN 0 THEN text || chr(10) || '① 가 ② 나 ③ 다' WHEN 1 THEN '7. ' || text || chr(10) || '1) x' || chr(10) || '2) y' || chr(10) || '3) z' || chr(10) || '5) no' || chr(10) || '4) w'
  WHEN 2 THEN text || chr(10) || 'a) one' || chr(10) || '  B. two  ' WHEN 3 THEN 'pick 1 red 2 green 3 blue' || chr(10) || text WHEN 4 THEN '1. only' || chr(10) || text || chr(10) || '2. two' || chr(10) || '① q' ELSE text || chr(10) || '1 p' || chr(10) || '2 q' || chr(10) || '3 r' || chr(10) || '5 s' END"""
_CHOICES = f"""
WITH RECURSIVE t AS (SELECT conv_id * 100000 + turn AS key, {_CHOSEN} AS said FROM conversations WHERE text IS NOT NULL),
x AS (SELECT key, unnest(string_split(said, chr(10))) AS raw, generate_subscripts(string_split(said, chr(10)), 1) AS i FROM t),
{_SPLIT} SELECT key // 100000 AS conv_id, key % 100000 AS turn, stem, choices FROM z
"""


@query("STR_9_choices", _CHOICES)
def choices(spark, d):
    parts = split_choices(F.expr(_CHOSEN.replace("chr(10)", "char(10)")))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", parts.alias("parts")).select("conv_id", "turn", "parts.*")


_PAGES = f"""
WITH RECURSIVE a AS (SELECT id, page, said, CAST(l AS DOUBLE) AS l, CAST(t AS DOUBLE) AS t, CAST(5 * length(said) AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM ({_DRAWN.format(div="//")})),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY t, l, id) AS line_no FROM a),
fig AS (SELECT page, l - 10 AS l, t - 20 AS t, 260.0::DOUBLE AS w, 40.0::DOUBLE AS h FROM ({_DRAWN.format(div="//")}) WHERE k = 8 AND page % 5 = 0 UNION ALL SELECT page, l + 20, t + 15, 140.0::DOUBLE, 45.0::DOUBLE FROM ({_DRAWN.format(div="//")}) WHERE k = 6 AND page % 4 = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY l, t) - 1 AS ord FROM fig),
b AS (SELECT * FROM n WHERE NOT (regexp_matches(said, '저작권|한국교육과정평가원') OR (t >= 842 * 0.9 AND regexp_matches(said, '^[0-9]{{1,3}}$')))),
m0 AS (SELECT *, CAST(regexp_extract(said, '^([1-9][0-9]?)[.)](\\s|$)', 1) AS INTEGER) AS number, regexp_matches(said, '^[1-5][.)](\\s|$)') AS choice FROM b WHERE regexp_matches(said, '^([1-9][0-9]?)[.)](\\s|$)') AND NOT regexp_matches(said, '{S.DATE}')),
m1 AS (SELECT *, EXISTS (SELECT 1 FROM f WHERE f.page = m0.page AND f.w * f.h <= 0.2 * 595 * 842 AND m0.l >= f.l - 2 AND m0.l + m0.w <= f.l + f.w + 2 AND m0.t >= f.t - 2 AND m0.t + m0.h <= f.t + f.h + 2) AS inside FROM m0),
m2 AS (SELECT m1.* FROM m1 LEFT JOIN (SELECT page, quantile_cont(h, 0.5) AS med FROM m1 WHERE NOT inside GROUP BY page) q USING (page) WHERE NOT (inside AND coalesce(h <= 0.92 * med, false))),
m3 AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY t, l, line_no) AS i FROM m2),
al AS (SELECT page, list({{'t': t, 'l': l, 'b': t + h, 'n': number, 'c': choice}} ORDER BY i) AS ms FROM m3 GROUP BY page),
ah AS (SELECT page, i AS start, i AS pos, number AS n, t + h AS b, CAST(1 AS BIGINT) AS found, l AS x FROM m3 WHERE number = 1 AND choice
  UNION ALL SELECT page, start, pos + 1, CASE WHEN near AND goes THEN n + 1 ELSE n END, CASE WHEN near AND goes THEN m.b ELSE b END, CASE WHEN near AND goes THEN found + 1 WHEN near THEN -9 ELSE found END, x
  FROM (SELECT ah.*, ms[pos + 1] AS m, abs(ms[pos + 1].l - x) <= 42 AS near, ms[pos + 1].t - b <= 70 AND ms[pos + 1].c AND ms[pos + 1].n = n + 1 AS goes FROM ah JOIN al USING (page) WHERE pos < len(ms) AND found BETWEEN 0 AND 2) AS s),
hd AS (SELECT page, start AS i FROM ah GROUP BY page, start HAVING max(found) >= 3),
m4 AS (SELECT m3.*, hd.i IS NOT NULL AS ahead FROM m3 LEFT JOIN hd USING (page, i)),
ln AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x DOUBLE, n INTEGER, b DOUBLE, nx INTEGER, cb DOUBLE)[]) AS lanes, CAST(NULL AS BIGINT) AS kept FROM m3
  UNION ALL SELECT page, i, CASE WHEN place IS NULL THEN list_append(lanes, new) ELSE list_transform(lanes, lambda o, j: CASE WHEN j = place THEN new ELSE o END) END, CASE WHEN rejected THEN NULL ELSE line_no END
  FROM (SELECT *, CASE WHEN rejected THEN {{'x': x, 'n': old.n, 'b': old.b, 'nx': CASE WHEN number < 5 THEN number + 1 END, 'cb': t + h}} ELSE {{'x': x, 'n': number, 'b': t + h, 'nx': CAST(NULL AS INTEGER), 'cb': CAST(NULL AS DOUBLE)}} END AS new
    FROM (SELECT *, CASE WHEN place IS NULL THEN l ELSE old.x * 0.8 + l * 0.2 END AS x, choice AND old.n IS NOT NULL AND ((coalesce(close, false) AND coalesce(number = old.nx, false)) OR (coalesce(close, false) AND number <= old.n) OR (number <= old.n AND ahead)) AS rejected
      FROM (SELECT *, lanes[place] AS old, t - coalesce(lanes[place].cb, lanes[place].b) <= 80 AS close
        FROM (SELECT m4.*, ln.lanes, list_max(list_filter(range(1, len(ln.lanes) + 1), lambda j: abs(ln.lanes[j].x - m4.l) <= 42 AND abs(ln.lanes[j].x - m4.l) = list_min(list_transform(ln.lanes, lambda o: abs(o.x - m4.l))))) AS place FROM ln JOIN m4 ON m4.page = ln.page AND m4.i = ln.i + 1) AS s1) AS s2) AS s3) AS s4),
m5 AS (SELECT m3.*, row_number() OVER (PARTITION BY m3.page ORDER BY t, l, line_no) AS id2, l + w / 2 AS x FROM m3 JOIN ln ON ln.page = m3.page AND ln.kept = m3.line_no),
c0 AS (SELECT *, lead(x) OVER w - x AS gap, row_number() OVER w AS place FROM m5 WINDOW w AS (PARTITION BY page ORDER BY x, id2, t)),
c1 AS (SELECT *, max(gap) OVER (PARTITION BY page) AS g, arg_max(place, gap * 1000 - place) OVER (PARTITION BY page) AS cut FROM c0),
c2 AS (SELECT *, CASE WHEN g >= greatest(80, 595 * 0.18) AND place > cut THEN 1 ELSE 0 END AS col FROM c1),
r0 AS (SELECT *, max(col) OVER (PARTITION BY page) > 0 AS two, lead(t) OVER (PARTITION BY page, col ORDER BY t, id2) AS nt, greatest(0, t - 10) AS rt FROM c2),
r AS (SELECT page, id2, number, col, line_no AS own, rt, CASE WHEN two AND col = 1 THEN 297.5 ELSE 0 END AS rl, CASE WHEN two THEN 297.5 ELSE 595 END AS rw, CASE WHEN nt IS NULL THEN 842 ELSE least(842, greatest(rt + 40, nt - 8)) END AS until FROM r0),
h AS (SELECT r.*, b.line_no, b.said, b.l, b.t, b.w, b.h, b.t + b.h AS e, regexp_matches(said, '^[①-⑨❶-❾➀-➈]') OR regexp_matches(said, '^[1-5][.)](\\s|$)') AS choice FROM b JOIN r ON b.page = r.page AND b.l + b.w / 2 BETWEEN rl - 6 AND rl + rw + 6 AND b.t + b.h >= rt - 2 AND b.t <= until + 2),
h1 AS (SELECT *, row_number() OVER (PARTITION BY page, id2 ORDER BY t, l) AS place FROM h),
u AS (SELECT page, id2, list_sort(list(h))[len(list(h)) // 2 + 1] AS u FROM h GROUP BY page, id2),
h2 AS (SELECT *, max(CASE WHEN choice THEN place END) OVER (PARTITION BY page, id2) AS last FROM h1),
h3 AS (SELECT h2.*, greatest(18, least(72, greatest(2.2 * u, 0.018 * 842))) AS most, max(e) OVER (PARTITION BY h2.page, h2.id2 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h2 JOIN u USING (page, id2) WHERE last IS NULL OR place >= last),
h4 AS (SELECT *, max(CASE WHEN last IS NOT NULL AND coalesce(t - before > most, false) THEN 1 ELSE 0 END) OVER (PARTITION BY page, id2 ORDER BY place ROWS UNBOUNDED PRECEDING) AS broken FROM h3),
ce AS (SELECT page, id2, max(e) AS content FROM h4 WHERE broken = 0 GROUP BY page, id2),
fs AS (SELECT r.page, r.id2, list({{'t': f.t, 'e': f.t + f.h, 'at': 0.0::DOUBLE}} ORDER BY f.ord) AS figures FROM r JOIN f ON f.page = r.page AND f.l + f.w / 2 BETWEEN rl - 6 AND rl + rw + 6 AND f.w <= greatest(1, rw) * 1.4 GROUP BY r.page, r.id2),
e0 AS (SELECT r.*, list_reduce(list_prepend({{'t': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'at': content}}, coalesce(figures, [])), lambda a, y: {{'t': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'at': CASE WHEN y.t >= a.at - 4 AND y.t <= until + 2 AND y.t - a.at <= 120 THEN greatest(a.at, least(until, y.e)) ELSE a.at END}}).at AS content FROM r LEFT JOIN ce USING (page, id2) LEFT JOIN fs USING (page, id2)),
e AS (SELECT *, CASE WHEN coalesce(least(until, content + 8) - rt >= 40, false) THEN least(until, content + 8) ELSE until END AS bottom FROM e0),
k AS (SELECT h.page, h.id2, h.number, h.col, h.rl, h.rt, h.rw, least(842, e.bottom) - h.rt AS rh, h.said, h.line_no, h.own, h.l, h.t, h.w, h.h FROM h JOIN e ON e.page = h.page AND e.id2 = h.id2 WHERE h.t <= e.bottom + 2),
v AS (SELECT * FROM k WHERE line_no = own OR NOT EXISTS (SELECT 1 FROM f WHERE f.page = k.page AND f.w * f.h >= 900 AND greatest(0, least(f.l + f.w, rl + rw) - greatest(f.l, rl)) * greatest(0, least(f.t + f.h, rt + rh) - greatest(f.t, rt)) >= 0.6 * f.w * f.h AND k.l + k.w / 2 BETWEEN f.l - 2 AND f.l + f.w + 2 AND k.t + k.h / 2 BETWEEN f.t - 2 AND f.t + f.h + 2)),
x AS (SELECT page * 1000 + id2 AS key, row_number() OVER (PARTITION BY page, id2 ORDER BY line_no <> own, t, l, line_no) AS i, trim(said) AS raw FROM v),
{_SPLIT},
q AS (SELECT DISTINCT page, id2, number, col, rt, rh FROM v)
SELECT 'd' || page % 3 AS doc_id, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY page ORDER BY col, rt, id2) AS INTEGER) AS position, CAST(col AS INTEGER) AS "column", number, CAST(rt AS DOUBLE) AS top, CAST(rh AS DOUBLE) AS height, stem, choices FROM q JOIN z ON z.key = q.page * 1000 + q.id2
"""


@query("SRC_10_recognised", _PAGES)
def recognised(spark, d):
    """Every question of every page, from the page files to stem and choices."""
    items = P.recognised(read_pages(spark, d))
    return items.select("doc_id", "page", "position", "column", "number", F.col("box.top").alias("top"), F.col("box.height").alias("height"), "stem", "choices")
