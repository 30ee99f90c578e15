"""Composition queries. An order stands for a selection, its line items for the items in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compose as C
from ..registry import query, table

_NAMES = [t[0] for t in C.TEMPLATES]
_PRESETS = ", ".join(f"('{k}', {c}, {str(a).lower()}, '{t}')" for k, c, a, *_, t in C.TEMPLATES)


def lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sel"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("id"), "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")


# Orders hold several lines of one number at times; pos is made unique by the part and price.
_POS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"


_ORDER = ("line", "id", "l_suppkey", "l_extendedprice", "l_shipdate")
#: Rows that a task of the line items sorts: more of them are more tasks, not larger ones. Up to 200 tasks, Spark writes an
#: exchange's rows at once; for more of them it holds and sorts those of a task that reads a file's split.
SORTED = 1_500_000


def ordered(spark, d) -> DataFrame:
    """Line items with the columns of their order. Keys have their final names before the exchange, so later steps need no other."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("sel"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("id"), *_ORDER[2:], F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("quantity"))
    tasks = -(-li.count() // SORTED)  # counted in the file's footers
    return rows.repartition(tasks, "sel") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows


def numbered(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("sel").orderBy(*_ORDER)).cast("long")
    return ordered(spark, d).withColumn("pos", pos).select("sel", "pos", F.col("line").alias("number"), "id", "flag", "quantity")


_NUM = f"SELECT l_orderkey AS sel, {_POS} AS pos, l_linenumber AS number, l_partkey AS id, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem"


@query("SRC_14_templates", f"WITH t(key, columns, circled_choices, default_title) AS (VALUES {_PRESETS}), d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'mock_exam' WHEN lang = 'fr' THEN 'quiz' WHEN lang = 'es' THEN 'none' END AS k FROM documents) SELECT d.doc_id, t.key AS template_key, t.columns, t.circled_choices, t.default_title FROM d JOIN t ON t.key = CASE WHEN d.k IN ({', '.join(repr(n) for n in _NAMES)}) THEN d.k ELSE 'basic' END")
def templates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "de", "mock_exam").when(F.col("lang") == "fr", "quiz").when(F.col("lang") == "es", "none").alias("template"))
    return C.with_template(rows).select("doc_id", "template_key", "columns", "circled_choices", "default_title")


@query("PRJ_8_titles", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 2 = 0) THEN '모의고사' WHEN c_custkey % 3 = 1 THEN '시험지' ELSE c_name END AS title FROM customer")
def resolved_titles(spark, d):
    c = table(spark, d, "customer")
    given = F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 1, "시험지").otherwise(F.col("c_name"))
    key = F.when(F.col("c_custkey") % 2 == 0, "mock_exam").otherwise("basic")
    return c.select(F.col("c_custkey").alias("id"), C.resolved_title(given, key, F.lit("모의고사")).alias("title"))


@query("CMP_2_unsupported", """SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'unknown_layout' WHEN doc_id % 7 = 0 THEN 'passage' WHEN source = 'src1' THEN 'group' WHEN lang = 'fr' AND doc_id % 2 = 0 THEN 'image_only' WHEN lang = 'de' THEN 'source_layout' END AS reason FROM documents""")
def unsupported(spark, d):
    doc = table(spark, d, "documents")
    s = F.lit("").cast("string")
    layout = F.when(
        F.col("doc_id") % 11 != 0,
        F.create_map(
            F.lit("group_id"), F.when(F.col("source") == "src1", "g").otherwise(s), F.lit("bbox_px"), F.when(F.col("lang") == "de", "1,2").otherwise(s),
            F.lit("block_type"), F.when((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0), "image_fallback").otherwise(s),
        ),
    )
    kind = F.when(F.col("doc_id") % 7 == 0, "passage").otherwise("question")
    empty = F.array().cast("array<string>")
    return doc.select(F.col("doc_id").alias("id"), C.unsupported_reason(layout, kind, F.col("doc_id").cast("string"), F.col("text"), empty, empty, s).alias("reason"))


@query("CMP_3_numbering_issues", f"WITH n AS ({_NUM}), t AS (SELECT *, count(*) OVER (PARTITION BY sel, number) AS times FROM n) SELECT sel, pos AS position, CASE WHEN flag = 'R' AND quantity > 40 THEN '' ELSE CAST(number AS VARCHAR) END AS original_number, CASE WHEN flag = 'A' AND quantity < 3 THEN 'group' WHEN flag = 'R' AND quantity > 40 THEN 'missing_original_number' ELSE 'duplicate_original_number' END AS issue FROM (SELECT *, count(*) OVER (PARTITION BY sel, CASE WHEN flag = 'R' AND quantity > 40 THEN '' ELSE CAST(number AS VARCHAR) END) AS k FROM t) WHERE (flag = 'A' AND quantity < 3) OR (flag = 'R' AND quantity > 40) OR k > 1")
def issues(spark, d):
    n = ordered(spark, d)
    blank = (F.col("flag") == "R") & (F.col("quantity") > 40)
    n = n.withColumns({"number": F.when(blank, "").otherwise(F.col("line").cast("string")), "reason": F.when((F.col("flag") == "A") & (F.col("quantity") < 3), "group")})
    return C.numbering_issues(n, by=("sel",), order=_ORDER).withColumn("position", F.col("position").cast("long"))


@query("AGG_4_duplicate_numbers", f"SELECT sel, number, count(*) AS times FROM ({_NUM}) GROUP BY sel, number HAVING count(*) > 1")
def duplicate_numbers(spark, d):
    return numbered(spark, d).groupBy("sel", "number").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


@query("WIN_6_renumbered", f"SELECT sel, pos, id, CAST(pos + 20 AS BIGINT) AS new_number FROM ({_NUM})")
def renumbered(spark, d):
    return C.renumbered(numbered(spark, d), 21, ("sel",)).select("sel", "pos", "id", "new_number")


@query("WIN_7_column_breaks", f"WITH n AS (SELECT *, (pos - 1) // 4 AS page, (pos - 1) // 2 % 2 AS col FROM ({_NUM})) SELECT sel, pos, coalesce(lag(page) OVER w = page AND col > lag(col) OVER w, false) AS breaks FROM n WINDOW w AS (PARTITION BY sel ORDER BY pos)")
def column_breaks(spark, d):
    n = numbered(spark, d).withColumns({"page": F.floor((F.col("pos") - 1) / 4), "col": F.floor((F.col("pos") - 1) / 2) % 2})
    return n.select("sel", "pos", C.breaks_column("page", "col", ("sel",)).alias("breaks"))


@query("AGG_9_column_count", "SELECT l_orderkey AS sel, coalesce(max(CASE WHEN l_linenumber IN (1, 2) THEN l_linenumber END), 0) AS columns FROM lineitem GROUP BY l_orderkey")
def column_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sel")).agg(C.column_count(F.col("l_linenumber")).alias("columns"))


_ANSWER = "CASE WHEN flag = 'N' THEN '－' ELSE flag END"


@query("WIN_15_quick_answers", f"WITH n AS (SELECT sel, pos, (pos - 1) // 5 AS line, number || '. ' || {_ANSWER} AS e FROM ({_NUM})) SELECT sel, line, string_agg(e, '    ' ORDER BY pos) AS entries FROM n GROUP BY sel, line")
def quick_answers(spark, d):
    n = numbered(spark, d).withColumn("answer", F.when(F.col("flag") != "N", F.col("flag")))
    return C.quick_answer_lines(n, 5, ("sel",))


@query("WIN_15_answer_rows", f"WITH n AS (SELECT sel, pos, (pos - 1) // 3 AS block, CAST(number AS VARCHAR) AS l, {_ANSWER} AS a FROM ({_NUM})), g AS (SELECT sel, block, list(l ORDER BY pos) AS labels, list(a ORDER BY pos) AS answers FROM n GROUP BY sel, block) SELECT sel, block, CASE WHEN block > 0 THEN list_resize(labels, 3, '') ELSE labels END AS labels, CASE WHEN block > 0 THEN list_resize(answers, 3, '') ELSE answers END AS answers FROM g")
def answer_rows(spark, d):
    n = numbered(spark, d).withColumn("answer", F.when(F.col("flag") != "N", F.col("flag")))
    return C.answer_rows(n, 3, ("sel",))


@query("CMP_4_wants_answer_key", f"SELECT sel, bool_or(flag = 'A' AND quantity > 20) AS appended FROM ({_NUM}) GROUP BY sel")
def wants_key(spark, d):
    """An order's lines are an exam; some have an answer, some only blanks."""
    answer = F.when(F.col("flag") != "A", None).when(F.col("quantity") > 20, "3").otherwise(" \u3000")
    return C.wants_answer_key(numbered(spark, d).withColumn("answer", answer), True, False, "sel")


_UNITS = "length(x) + length(regexp_replace(regexp_replace(x, '[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g'), '[\\x00-\\x{FF}]', '', 'g'))"


def _sql_lines(c: str) -> str:
    return f"list_sum(list_transform(string_split(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: greatest(1, CAST(ceil(({_UNITS}) / 48.0) AS BIGINT))))"


@query("CMP_5_heights", f"SELECT doc_id AS id, CAST(greatest(14, 10 + 5 * {_sql_lines('t')} + CASE WHEN doc_id % 2 = 0 THEN 5 * {_sql_lines('lang')} + 5 * {_sql_lines('source')} ELSE 6 END + CASE WHEN source <> '' THEN 6 ELSE 0 END + CASE WHEN lang <> '' THEN 5 * {_sql_lines('lang')} ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 4 + 10 ELSE 0 END) AS BIGINT) AS height FROM (SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN '문제' ELSE text END AS t FROM documents)")
def heights(spark, d):
    empty, docs = F.array().cast("array<string>"), table(spark, d, "documents")
    choices = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(empty)
    tables = F.when(F.col("doc_id") % 5 == 0, F.array(F.array(F.array("lang", "source")))).otherwise(F.array().cast("array<array<array<string>>>"))
    stem = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text"))
    return docs.select(F.col("doc_id").alias("id"), C.estimated_height(stem, choices, empty, 2, tables=tables, title=F.lit(""), answer=F.col("source"), explanation=F.col("lang"), blank=True).alias("height"))


_PLAN = f"""
WITH RECURSIVE n AS (SELECT sel, pos, quantity * 3 AS height FROM ({_NUM})),
w AS (SELECT DISTINCT sel, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS height, CAST(0 AS BIGINT) AS start_slot, CAST(0 AS BIGINT) AS end_slot, CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS used, false AS break_before FROM n
  UNION ALL SELECT sel, pos, height, f, CASE WHEN height > 100 THEN f + (height + 99) // 100 - 1 ELSE f END, CASE WHEN height > 100 THEN f + height // 100 ELSE f END, CASE WHEN height > 100 THEN height % 100 WHEN brk THEN height ELSE used + height END, brk
  FROM (SELECT *, slot + CASE WHEN brk THEN 1 ELSE 0 END AS f FROM (SELECT n.sel, n.pos, n.height, w.slot, w.used, w.used > 0 AND w.used + n.height > 100 AS brk FROM w JOIN n ON n.sel = w.sel AND n.pos = w.pos + 1)))
SELECT sel, pos, height, start_slot, end_slot, break_before, start_slot // 2 + 1 AS page, start_slot % 2 + 1 AS "column", CASE WHEN height > 100 THEN 'split' WHEN height >= 82 THEN 'tight' ELSE 'none' END AS risk FROM w WHERE pos > 0
"""


@query("WIN_14_layout_plan", _PLAN)
def layout_plan(spark, d):
    """Quantities stand for heights."""
    n = numbered(spark, d).select("sel", "pos", (F.col("quantity") * 3).alias("height"))
    return C.planned(n, "sel", 2)


@query("CMP_1_baskets", "WITH RECURSIVE l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type AS e, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id FROM events), b AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids FROM events UNION ALL SELECT l.user_id, l.i, CASE WHEN e = 'error' THEN CAST([] AS BIGINT[]) WHEN e = 'purchase' THEN list_filter(ids, lambda x: x <> id) WHEN (e = 'view') <> list_contains(ids, id) THEN ids WHEN e = 'view' THEN list_prepend(id, list_filter(ids, lambda x: x <> id)) ELSE list_append(ids, id) END FROM b JOIN l ON l.user_id = b.user_id AND l.i = b.i + 1) SELECT user_id, ids FROM b QUALIFY i = max(i) OVER (PARTITION BY user_id)")
def baskets(spark, d):
    """Events stand for basket operations; a fold along each user's log, which the tests hold against a loop."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "purchase", "remove").when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "view", "move").otherwise("add")
    log = e.select("user_id", F.col("event_id").alias("pos"), op.alias("op"), F.get_json_object("props", "$.k").cast("long").alias("id"), F.when(F.col("event_type") == "view", 0).alias("at"))
    return C.basket(log, "user_id")


@query("CMP_6_endnotes_fit", "WITH g AS (SELECT conv_id, list(turn + 1 ORDER BY turn) AS n, avg(CASE WHEN text <> '' THEN 1.0 ELSE 0.0 END) AS share FROM conversations GROUP BY conv_id) SELECT conv_id, len(n) >= 2 AND n = list_transform(range(1, len(n) + 1), lambda x: CAST(x AS BIGINT)) AND share >= 0.8 AS fits FROM g")
def endnotes(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("number"), F.col("text").alias("answer"))
    return C.endnotes_fit(c, "conv_id")


@query("CMP_7_images", f"WITH s AS (SELECT sel, pos, row_number() OVER (PARTITION BY sel ORDER BY flag = 'R' DESC, pos) AS seat, count(*) OVER (PARTITION BY sel) AS n FROM ({_NUM})), i AS (SELECT l_orderkey AS sel, l_suppkey * 100000000000 + l_partkey * 10000 + l_linenumber AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey * 100000000000 + l_partkey * 10000 + l_linenumber) AS k FROM lineitem) SELECT i.sel, i.image, s.pos AS item_pos FROM i JOIN s ON s.sel = i.sel AND s.seat = least(i.k, s.n)")
def images(spark, d):
    items = numbered(spark, d).select("sel", "pos", (F.col("flag") == "R").alias("cue"))
    pictures = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sel"), (F.col("l_suppkey") * 100000000000 + F.col("l_partkey") * 10000 + F.col("l_linenumber")).alias("image"))
    return C.unpositioned_images(pictures, items, "sel")


@query("PRJ_16_answer_blanks", "SELECT doc_id AS id, doc_id % 2 = 0 AND NOT regexp_matches(text, '[(\\[][\\s＿_]{2,}[)\\]]|답\\s*[:：]?\\s*[(\\[]') AS needed FROM documents")
def blanks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), C.needs_answer_blank(F.col("text"), F.col("doc_id") % 2 == 1, F.lit(True)).alias("needed"))
