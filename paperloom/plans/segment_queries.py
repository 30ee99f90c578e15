"""Geometry and window queries. Parts stand for boxes and markers on pages, conversations for ordered paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import segment as S
from ..registry import query, table

PAGE_W, PAGE_H = 600.0, 800.0


def box(left, top, width, height) -> Column:
    return F.struct(*[F.expr(e).cast("double").alias(n) for e, n in ((left, "left"), (top, "top"), (width, "width"), (height, "height"))])


#: page, left, top, width and height of part p by modular arithmetic.
_PAGE, _LEFT, _TOP, _W, _H = "p_partkey DIV 20", "p_partkey * 37 % 560", "p_partkey * 53 % 760", "10 + p_size", "8 + p_partkey % 30"
_SQL_PARTS = "SELECT p_partkey AS id, p_partkey // 20 AS page, CAST(p_partkey * 37 % 560 AS DOUBLE) AS l, CAST(p_partkey * 53 % 760 AS DOUBLE) AS t, CAST(10 + p_size AS DOUBLE) AS w, CAST(8 + p_partkey % 30 AS DOUBLE) AS h FROM part"


def boxes(spark, d, kind: str = "box") -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_PAGE).alias("page"), box(_LEFT, _TOP, _W, _H).alias(kind), "p_size", "p_name")


#: Regions: four a page, by part keys that end the page's twenty.
_SQL_REGIONS = "SELECT p_partkey AS region_id, p_partkey // 20 AS page, CAST(p_partkey % 20 % 2 * 300 AS DOUBLE) AS l, CAST(p_partkey % 20 // 2 * 400 AS DOUBLE) AS t, 300.0::DOUBLE AS w, 400.0::DOUBLE AS h FROM part WHERE p_partkey % 20 < 4"


def regions(spark, d) -> DataFrame:
    p = table(spark, d, "part").where("p_partkey % 20 < 4")
    return p.select(F.col("p_partkey").alias("region_id"), F.expr(_PAGE).alias("page"), box("p_partkey % 20 % 2 * 300", "p_partkey % 20 DIV 2 * 400", "300", "400").alias("region"), (F.col("p_partkey") % 20).alias("ord"))


_OVER = "greatest(0, least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l)) * greatest(0, least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t))"


@query("PRJ_10_boxes", f"SELECT id, l / 600 AS left_share, least(l + w + 5, 600) - greatest(l - 5, 0) AS grown_width, w * h AS area FROM ({_SQL_PARTS})")
def box_math(spark, d):
    b = boxes(spark, d)
    w, h = F.lit(PAGE_W), F.lit(PAGE_H)
    return b.select("id", S.normalised(F.col("box"), w, h)["left"].alias("left_share"), S.expanded(F.col("box"), 5.0, w, h)["width"].alias("grown_width"), S.area(F.col("box")).alias("area"))


@query("PRJ_11_units", "SELECT p_partkey AS id, CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE round_even(p_retailprice * 7200 / (p_size % 4 * 75), 0) END AS BIGINT) AS units FROM part")
def units(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.units(F.col("p_retailprice"), F.col("p_size") % 4 * 75).alias("units"))


@query("GEO_1_box_tests", f"SELECT a.id, b.id AS other, {_OVER} AS overlap, a.l <= b.l + b.w + 20 AND b.l <= a.l + a.w + 20 AND a.t <= b.t + b.h + 20 AND b.t <= a.t + a.h + 20 AS near, a.l + a.w / 2 BETWEEN b.l AND b.l + b.w AND a.t + a.h / 2 BETWEEN b.t AND b.t + b.h AS centred FROM ({_SQL_PARTS}) a JOIN ({_SQL_PARTS}) b ON b.id = a.id + 1 - CASE WHEN a.id % 20 = 19 THEN 20 ELSE 0 END")
def box_tests(spark, d):
    a = boxes(spark, d, "a").select("id", "a")
    b = boxes(spark, d, "b").select(F.col("id").alias("other"), "b")
    pairs = a.join(b, F.col("other") == F.col("id") + 1 - F.when(F.col("id") % 20 == 19, 20).otherwise(0))
    return pairs.select("id", "other", S.overlap(F.col("a"), F.col("b")).alias("overlap"), S.near(F.col("a"), F.col("b"), 20).alias("near"), S.centre_in(F.col("a"), F.col("b")).alias("centred"))


@query("JOIN_7_lines_in_regions", f"SELECT a.id, b.region_id FROM ({_SQL_PARTS}) a JOIN ({_SQL_REGIONS}) b ON a.page = b.page AND a.l + a.w / 2 BETWEEN b.l - 6 AND b.l + b.w + 6 AND a.t + a.h >= b.t - 2 AND a.t <= b.t + b.h + 2")
def lines_in_regions(spark, d):
    return S.lines_in_regions(boxes(spark, d, "line"), regions(spark, d), ["page"]).select("id", "region_id")


@query("JOIN_8_figures", f"SELECT a.id, b.region_id FROM ({_SQL_PARTS}) a JOIN ({_SQL_REGIONS}) b ON a.page = b.page AND {_OVER} >= 0.6 * a.w * a.h")
def figures(spark, d):
    return S.figures_of(boxes(spark, d, "figure"), regions(spark, d), ["page"]).select("id", "region_id")


@query("JOIN_9_smallest_figure", f"SELECT a.page, a.id AS point_id, arg_min(b.id, b.w * b.h * 1000000 + b.id) AS figure_id FROM ({_SQL_PARTS}) a JOIN ({_SQL_PARTS}) b ON a.page = b.page AND a.l BETWEEN b.l AND b.l + b.w AND a.t BETWEEN b.t AND b.t + b.h GROUP BY a.page, a.id")
def smallest_figure(spark, d):
    points = boxes(spark, d).select("page", F.col("id").alias("point_id"), F.col("box.left").alias("x"), F.col("box.top").alias("y"))
    return S.smallest_container(points, boxes(spark, d, "figure").select("page", F.col("id").alias("figure_id"), "figure"), ["page"])


@query("JOIN_10_owner", f"SELECT page, box_id, arg_max(region_id, o * 100 - ord) AS region_id FROM (SELECT a.page, a.id AS box_id, b.region_id, b.region_id % 20 AS ord, {_OVER} AS o FROM ({_SQL_PARTS}) a JOIN ({_SQL_REGIONS}) b ON a.page = b.page) WHERE o > 0 GROUP BY page, box_id")
def owner(spark, d):
    return S.owner(boxes(spark, d).withColumnRenamed("id", "box_id"), regions(spark, d), ["page"])


@query("AGG_8_characters_inside", f"SELECT b.page, b.region_id AS figure_id, count(a.id) AS chars FROM ({_SQL_REGIONS}) b LEFT JOIN ({_SQL_PARTS}) a ON a.page = b.page AND a.l BETWEEN b.l AND b.l + b.w AND a.t BETWEEN b.t AND b.t + b.h GROUP BY b.page, b.region_id")
def chars_inside(spark, d):
    chars = boxes(spark, d).select("page", F.col("box.left").alias("x"), F.col("box.top").alias("y"))
    figs = regions(spark, d).select("page", F.col("region_id").alias("figure_id"), F.col("region").alias("figure"))
    return S.characters_inside(chars, figs, ["page"]).select("page", "figure_id", "chars")


@query("FLT_11_figure_candidates", f"SELECT b.page, b.region_id AS figure_id FROM ({_SQL_REGIONS}) b LEFT JOIN ({_SQL_PARTS}) a ON a.page = b.page AND a.l BETWEEN b.l AND b.l + b.w AND a.t BETWEEN b.t AND b.t + b.h GROUP BY b.page, b.region_id, b.w, b.h HAVING b.w * b.h >= 22000 AND b.w >= 60 AND b.h >= 60 AND count(a.id) < 24")
def candidates(spark, d):
    chars = boxes(spark, d).select("page", F.col("box.left").alias("x"), F.col("box.top").alias("y"))
    figs = regions(spark, d).select("page", F.col("region_id").alias("figure_id"), F.col("region").alias("figure"))
    return S.figure_candidates(S.characters_inside(chars, figs, ["page"])).select("page", "figure_id")


#: Texts of parts as lines, by id modulo 9, in an expression that both engines read.
_SAID = """CASE id % 9 WHEN 0 THEN p_size || '. ' || p_name WHEN 1 THEN p_size || ') ' || p_name WHEN 2 THEN '2024. 3. 5. ' || p_name WHEN 3 THEN p_size || '.5 ' || p_name
  WHEN 4 THEN p_size || '. 학년도 ' || p_name WHEN 5 THEN p_size || '시 30분 5초 오후 ' || p_name WHEN 6 THEN CAST(p_size AS VARCHAR(9)) WHEN 7 THEN '저작권 ' || p_name ELSE p_name END"""
_SQL_LINES = f"SELECT id, page, l, t, w, h, {_SAID} AS text FROM ({_SQL_PARTS}) JOIN part ON p_partkey = id"
_SQL_DATED = f"(regexp_matches(text, '{S.DATE}') OR (regexp_matches(text, '오전|오후|AM|PM') AND regexp_matches(text, '^[0-9]') AND len(regexp_extract_all(text, '[0-9]+')) >= 3))"
_SQL_HEADER = "(t < 40 AND regexp_matches(text, '年|월|교시|점\\]|학년도|모의평가'))"


def lines(spark, d) -> DataFrame:
    return boxes(spark, d).withColumn("text", F.expr(_SAID)).withColumn("page_height", F.lit(PAGE_H))


@query("FLT_9_markers", f"SELECT id, CAST(regexp_extract(text, '{S.MARKER}', 1) AS INTEGER) AS number FROM ({_SQL_LINES}) WHERE regexp_extract(text, '{S.MARKER}', 1) <> '' AND NOT {_SQL_DATED} AND NOT {_SQL_HEADER} AND h > 0.5")
def markers(spark, d):
    return S.markers(lines(spark, d)).select("id", "number")


@query("FLT_8_furniture", f"SELECT id, {_SQL_DATED} AS dated, {_SQL_HEADER} AS header FROM ({_SQL_LINES}) WHERE NOT (regexp_matches(text, '저작권|한국교육과정평가원') OR (t >= 720 AND regexp_matches(text, '^[0-9]{{1,3}}$')))")
def furniture(spark, d):
    return S.without_furniture(lines(spark, d)).select("id", "dated", "header")


@query("FLT_7_reading_order", f"SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN l < 300 THEN 0 ELSE 1 END, t, id) AS place FROM ({_SQL_PARTS})")
def reading_order(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("page").orderBy(F.when(F.col("box.left") < 300, 0).otherwise(1), "box.top", "id")
    return boxes(spark, d).select("page", "id", F.row_number().over(w).cast("long").alias("place"))


@query("FLT_10_small_print", f"WITH m AS (SELECT *, w >= 40 AS f FROM ({_SQL_PARTS})), q AS (SELECT page, quantile_cont(h, 0.5) FILTER (NOT f) AS med FROM m GROUP BY page) SELECT id FROM m JOIN q USING (page) WHERE NOT (f AND coalesce(h <= 0.92 * med, false))")
def small_print(spark, d):
    m = boxes(spark, d).select("id", "page", F.col("box.height").alias("height"), (F.col("box.width") >= 40).alias("in_figure"))
    return S.outside_small_print(m, ["page"]).select("id")


#: Markers: five a page, so that some pages have a gap wide enough for two columns.
_MARKS = f"SELECT id, id // 5 AS page, l + w / 2 AS x, t FROM ({_SQL_PARTS})"
_SPLIT = f"SELECT id, page, x, t, CASE WHEN g >= greatest(80, 600 * 0.18) AND place > cut THEN 1 ELSE 0 END AS col FROM (SELECT *, max(gap) OVER (PARTITION BY page) AS g, arg_max(place, gap * 1000 - place) OVER (PARTITION BY page) AS cut FROM (SELECT *, lead(x) OVER w - x AS gap, row_number() OVER w AS place FROM ({_MARKS}) WINDOW w AS (PARTITION BY page ORDER BY x, id)))"


def marks(spark, d) -> DataFrame:
    m = boxes(spark, d).select("id", F.expr("id DIV 5").alias("page"), (F.col("box.left") + F.col("box.width") / 2).alias("x"), F.col("box.top").alias("top"))
    return m.withColumns({"page_width": F.lit(PAGE_W), "page_height": F.lit(PAGE_H)})


@query("WIN_2_columns", f"SELECT id, col AS \"column\" FROM ({_SPLIT})")
def columns(spark, d):
    return S.column_split(marks(spark, d), ["page"]).select("id", "column")


@query("WIN_1_regions", f"SELECT id, coalesce(lead(t) OVER (PARTITION BY page, col ORDER BY t, id), 800) AS until FROM ({_SPLIT})")
def question_regions(spark, d):
    return S.regions(S.column_split(marks(spark, d), ["page"]), ["page"]).select("id", "until")


@query("WIN_3_running_groups", "SELECT conv_id, turn, greatest(1, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT)) AS \"group\" FROM conversations")
def running_groups(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return S.grouped_runs(c, F.col("role") == "user", "conv_id", "turn").select("conv_id", "turn", "group")


_VARIANTS = "SELECT conv_id, turn, n, sum(CASE WHEN n <= prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + 1 AS variant FROM (SELECT conv_id, turn, n, lag(n) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT conv_id, turn, length(text) % 9 + 1 AS n, role FROM conversations) {w})"


def numbers(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (F.length("text") % 9 + 1).alias("number"))


@query("WIN_18_variants", f"SELECT conv_id, turn, 'v' || CAST(variant AS BIGINT) || ':q' || lpad(CAST(n AS VARCHAR), 2, '0') AS variant_id FROM ({_VARIANTS.format(w='')})")
def variant_ids(spark, d):
    return S.variants(numbers(spark, d), "conv_id", "turn").select("conv_id", "turn", "variant_id")


@query("WIN_5_question_groups", f"WITH q AS (SELECT conv_id, turn, 'v' || CAST(variant AS BIGINT) || ':q' || lpad(CAST(n AS VARCHAR), 2, '0') AS v FROM ({_VARIANTS.format(w=chr(119) + 'here role = ' + chr(39) + 'user' + chr(39))})) SELECT c.conv_id, c.turn, last_value(q.v IGNORE NULLS) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS UNBOUNDED PRECEDING) AS group_id FROM conversations c LEFT JOIN q USING (conv_id, turn)")
def question_groups(spark, d):
    n = numbers(spark, d).withColumn("number", F.when(F.col("role") == "user", F.col("number")))
    return S.question_groups(n, "conv_id", "turn").select("conv_id", "turn", "group_id")


@query("WIN_9_adjacent_repeats", "SELECT conv_id, turn FROM (SELECT conv_id, turn, role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 AS same FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE NOT same")
def adjacent(spark, d):
    return S.without_adjacent_repeats(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn")


@query("WIN_8_smoothed", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS smooth FROM events")
def smooth(spark, d):
    return S.smoothed(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


#: Sections: each customer's orders, numbered from 3; of some one number is the one before it, and of some the next one is twice there.
_SQL_SECTIONS = "SELECT o_custkey AS s, o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 AND rn = 3 THEN rn + 1 WHEN o_custkey % 3 = 1 AND rn = 3 THEN rn + 3 ELSE rn + 2 END AS number FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)"


@query("WIN_11_repaired", f"WITH r AS ({_SQL_SECTIONS}), g AS (SELECT s, count(*) AS n, arg_min(number, k) AS f, list(number) AS every FROM r GROUP BY s), m AS (SELECT s, n, f, list_filter(range(f, f + n), lambda x: NOT list_contains(every, x)) AS missing, list_distinct(list_filter(every, lambda x: len(list_filter(every, lambda y: y = x)) > 1)) AS twice FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS place FROM r) SELECT s, k, CAST(CASE WHEN n >= 3 AND len(missing) = 1 AND len(twice) = 1 AND number = twice[1] AND f + place = missing[1] THEN missing[1] ELSE number END AS BIGINT) AS repaired FROM p JOIN m USING (s)")
def repaired(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").withColumn("rn", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    third, kind = F.col("rn") == 3, F.col("o_custkey") % 3
    number = F.when((kind == 0) & third, F.col("rn") + 1).when((kind == 1) & third, F.col("rn") + 3).otherwise(F.col("rn") + 2)
    return S.repaired_number(o.select(F.col("o_custkey").alias("s"), F.col("o_orderkey").alias("k"), number.alias("number")), "s", "k").select("s", "k", "repaired")


_BOTTOMS = f"""
WITH b AS (SELECT page, id, l, t, w, h, t + h AS e, id % 7 = 0 AND page % 3 > 0 AS choice FROM ({_SQL_PARTS}) WHERE id % 20 < 16),
m AS (SELECT page, list_sort(list(h))[len(list(h)) // 2 + 1] AS u FROM b GROUP BY page),
p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY t, l) AS place FROM b),
q AS (SELECT *, max(CASE WHEN choice THEN place END) OVER (PARTITION BY page) AS last FROM p),
r AS (SELECT q.*, greatest(18, least(72, greatest(2.2 * u, 0.018 * 800))) AS most, max(e) OVER (PARTITION BY page ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q JOIN m USING (page) WHERE last IS NULL OR place >= last),
k AS (SELECT *, max(CASE WHEN last IS NOT NULL AND coalesce(t - before > most, false) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY place ROWS UNBOUNDED PRECEDING) AS broken FROM r),
c AS (SELECT page, max(e) AS content FROM k WHERE broken = 0 GROUP BY page),
f AS (SELECT page, list({{'t': t, 'e': t + h, 'at': 0.0::DOUBLE}} ORDER BY id) AS figures FROM ({_SQL_PARTS}) WHERE id % 20 >= 16 AND l + w / 2 BETWEEN -6 AND 606 GROUP BY page),
g AS (SELECT DISTINCT page, 600.0 + page % 4 * 50 AS until FROM ({_SQL_PARTS})),
o AS (SELECT g.page, until, list_reduce(list_prepend({{'t': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'at': content}}, coalesce(figures, [])), lambda a, x: {{'t': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'at': CASE WHEN x.t >= a.at - 4 AND x.t <= until + 2 AND x.t - a.at <= 120 THEN greatest(a.at, least(until, x.e)) ELSE a.at END}}).at AS content FROM g LEFT JOIN c USING (page) LEFT JOIN f USING (page))
SELECT page, CAST(CASE WHEN coalesce(least(until, content + 8) - 20 >= 40, false) THEN least(until, content + 8) ELSE until END AS DOUBLE) AS bottom FROM o
"""


@query("WIN_17_refined_bottoms", _BOTTOMS)
def bottoms(spark, d):
    """Sixteen parts a page are lines, of which some begin a choice; four are figures; a page is one region."""
    b, until = boxes(spark, d), F.lit(600.0) + F.col("page") % 4 * 50
    regs = b.select("page").distinct().select("page", box("0", "20", "600", "700").alias("region"), until.alias("until"), F.lit(PAGE_H).alias("page_height"))
    lines = b.where("id % 20 < 16").select("page", F.col("box.top").alias("top"), F.col("box.left").alias("left"), F.col("box.height").alias("height"), ((F.col("id") % 7 == 0) & (F.col("page") % 3 > 0)).alias("choice"))
    figures = b.where("id % 20 >= 16").select("page", F.col("id").alias("ord"), F.col("box").alias("figure"))
    return S.refined_bottoms(regs, lines, figures, "page")


@query("GEO_3_union_area", f"WITH b AS (SELECT page, l, l + w AS r, t, t + h AS b FROM ({_SQL_PARTS})), x AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS x2 FROM (SELECT DISTINCT page, x FROM (SELECT page, l AS x FROM b UNION ALL SELECT page, r FROM b))), s AS (SELECT b.page, x.x, x.x2, b.t, b.b, max(b.b) OVER (PARTITION BY b.page, x.x ORDER BY b.t, b.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM x JOIN b ON x.page = b.page AND b.l <= x.x AND b.r >= x.x2 WHERE x2 IS NOT NULL) SELECT page, sum(greatest(0, b - greatest(t, coalesce(prev, t))) * (x2 - x)) AS area FROM s GROUP BY page")
def union_areas(spark, d):
    b = boxes(spark, d).select("page", F.col("box.left").alias("left"), S.right(F.col("box")).alias("right"), F.col("box.top").alias("top"), S.bottom(F.col("box")).alias("bottom"))
    return S.union_area(b, "page")


@query("JOIN_6_forward_match", "WITH q AS (SELECT conv_id, turn AS page, turn AS ord, length(text) % 5 AS start, turn AS qid FROM conversations WHERE role = 'user'), p AS (SELECT conv_id, turn AS passage_id, turn AS page, length(text) % 5 AS start FROM conversations WHERE role <> 'user') SELECT p.conv_id, p.passage_id, (SELECT arg_min(q.qid, q.ord) FROM q WHERE q.conv_id = p.conv_id AND q.start = p.start AND q.page >= p.page) AS question_id FROM p")
def forward(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.length("text") % 5).alias("n"))
    q = c.where("role = 'user'").select("conv_id", F.col("n").alias("number"), F.col("turn").alias("page"), F.col("turn").alias("ord"), F.col("turn").alias("question_id"))
    p = c.where("role <> 'user'").select("conv_id", F.col("turn").alias("passage_id"), F.col("turn").alias("page"), F.col("n").alias("start"))
    return S.forward_match(p, q, ["conv_id"]).select("conv_id", "passage_id", "question_id")


@query("JOIN_15_unit_texts", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def unit_texts(spark, d):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


@query("AGG_25_first_positions", "SELECT conv_id, length(text) % 5 AS number, min(turn) AS first_turn FROM conversations GROUP BY ALL")
def first_positions(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 5).alias("number"))
    return c.groupBy("conv_id", "number").agg(F.min_by("turn", "turn").alias("first_turn"))


@query("ARR_3_cells", f"WITH c AS (SELECT id, page, CAST(id % 20 // 5 AS INTEGER) AS r, CAST(id % 5 * 2 AS INTEGER) AS c, CAST(1 + CASE WHEN page % 3 = 0 THEN id % 2 ELSE 0 END AS INTEGER) AS rs, CAST(1 + id % 2 AS INTEGER) AS cs FROM ({_SQL_PARTS})), g AS (SELECT id, page, r, c, unnest(range(r, r + rs)) AS gr, cs FROM c), h AS (SELECT id, page, r, c, gr, unnest(range(c, c + cs)) AS gc FROM g), n AS (SELECT page, max(k) > 1 AS clash FROM (SELECT page, gr, gc, count(*) AS k FROM h GROUP BY ALL) GROUP BY page) SELECT h.page, CAST(gr AS INTEGER) AS grid_row, CAST(gc AS INTEGER) AS grid_col, id AS cell_id FROM h JOIN n USING (page) WHERE NOT clash OR (gr = r AND gc = c)")
def cells(spark, d):
    b = boxes(spark, d)
    c = b.select(
        F.col("id").alias("cell_id"), "page", F.expr("id % 20 DIV 5").cast("int").alias("row"), F.expr("id % 5 * 2").cast("int").alias("col"),
        (1 + F.when(F.col("page") % 3 == 0, F.col("id") % 2).otherwise(0)).cast("int").alias("row_span"), (1 + F.col("id") % 2).cast("int").alias("col_span"),
    )
    return S.placed_cells(c, "page")
