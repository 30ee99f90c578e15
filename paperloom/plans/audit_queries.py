"""Audit queries. Of a conversation the user's turns stand for the source, the assistant's for the output; texts' lengths for numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, characters
from ..operators import audit as A
from ..operators import router as R
from ..registry import query, table

_WORDS = "SELECT conv_id, unnest(string_split(text, ' ')) AS key FROM conversations WHERE role = '{}'"


def side(spark, d, role: str) -> DataFrame:
    return table(spark, d, "conversations").where(F.col("role") == role)


def words(spark, d, role: str) -> DataFrame:
    return side(spark, d, role).select("conv_id", F.explode(F.split("text", " ")).alias("key"))


def _overlap_sql(a: str, b: str) -> str:
    return f"WITH a AS (SELECT conv_id, key, count(*) AS a FROM ({a}) GROUP BY ALL), b AS (SELECT conv_id, key, count(*) AS b FROM ({b}) GROUP BY ALL), g AS (SELECT conv_id, CAST(sum(coalesce(a, 0)) AS BIGINT) AS source, CAST(sum(coalesce(b, 0)) AS BIGINT) AS output, CAST(sum(least(coalesce(a, 0), coalesce(b, 0))) AS BIGINT) AS matched FROM a FULL JOIN b USING (conv_id, key) GROUP BY conv_id), o AS (SELECT *, CASE WHEN source > 0 THEN matched / source ELSE 0 END AS recall, CASE WHEN output > 0 THEN matched / output ELSE 0 END AS precision, CASE WHEN source + output > 0 THEN 2 * matched / (source + output) ELSE 0 END AS f1 FROM g) "


@query("AGG_11_word_overlap", _overlap_sql(_WORDS.format("user"), _WORDS.format("assistant")) + "SELECT * FROM o")
def word_overlap(spark, d):
    return A.overlap(words(spark, d, "user"), words(spark, d, "assistant"), ["conv_id"])


_GRAMS = "SELECT conv_id, unnest(list_transform(range(1, greatest(length(text) - least(3, length(text)) + 1, 1) + 1), lambda i: substr(text, i, least(3, length(text))))) AS key FROM conversations WHERE role = '{}' AND length(text) > 0"


@query("AGG_12_gram_preservation", _overlap_sql(_GRAMS.format("user"), _GRAMS.format("assistant")) + "SELECT conv_id, matched, CASE WHEN source > 0 THEN 0.8::DOUBLE * recall + 0.2::DOUBLE * precision END AS score FROM o")
def gram_preservation(spark, d):
    return A.gram_preservation(side(spark, d, "user").select("conv_id", "text"), side(spark, d, "assistant").select("conv_id", "text"), ["conv_id"]).select("conv_id", "matched", "score")


@query("AGG_13_numbers", "WITH s AS (SELECT conv_id, list_sort(list_distinct(list(n))) AS s, count(*) AS st FROM (SELECT conv_id, CAST(length(text) % 20 AS BIGINT) AS n FROM conversations WHERE role = 'user') GROUP BY conv_id), o AS (SELECT conv_id, list_sort(list_distinct(list(n))) AS o, count(*) AS ot FROM (SELECT conv_id, CAST(length(text) % 20 AS BIGINT) AS n FROM conversations WHERE role = 'assistant') GROUP BY conv_id) SELECT conv_id, CAST(len(list_intersect(coalesce(s, []), coalesce(o, []))) AS BIGINT) AS kept, list_filter(coalesce(s, []), lambda x: NOT list_contains(coalesce(o, []), x)) AS missing, list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(s, []), x)) AS unexpected, coalesce(st, 0) AS source_times, coalesce(ot, 0) AS output_times FROM s FULL JOIN o USING (conv_id)")
def numbers(spark, d):
    n = lambda role: side(spark, d, role).select("conv_id", (F.length("text") % 20).cast("long").alias("number"))
    return A.number_preservation(n("user"), n("assistant"), ["conv_id"])


@query("AGG_16_weighted_score", "SELECT id, (a + b + 20) / (wa + wb + 20) AS score, (a + b + 20) / 80 AS conservative, (wa + wb + 20) / 80 AS coverage FROM (SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN 35 * (o_totalprice / 600000) ELSE 0::DOUBLE END AS a, CASE WHEN o_orderstatus <> 'P' THEN 35::DOUBLE ELSE 0::DOUBLE END AS wa, CASE WHEN o_custkey % 3 > 0 THEN 12.5::DOUBLE ELSE 0::DOUBLE END AS b, CASE WHEN o_custkey % 3 > 0 THEN 25::DOUBLE ELSE 0::DOUBLE END AS wb FROM orders)")
def weighted(spark, d):
    o = table(spark, d, "orders")
    part = lambda name, score: F.struct(F.lit(name).alias("part"), F.lit(A.WEIGHTS[name]).alias("weight"), score.cast("double").alias("score"))
    parts = F.array(part("text", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 600000)), part("numbers", F.when(F.col("o_custkey") % 3 > 0, F.lit(0.5))), part("pages", F.lit(1.0)))
    return A.weighted(o.select(F.col("o_orderkey").alias("id"), F.explode(parts).alias("p")).select("id", "p.*"), ["id"])


@query("AGG_14_page_ratio", "SELECT conv_id, CASE WHEN greatest(a, b) > 0 THEN least(a, b) / greatest(a, b) ELSE 0 END AS ratio, list_transform(range(least(a, b) + 1, a + 1), lambda x: CAST(x AS BIGINT)) AS missing FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS a, count(*) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id)")
def page_ratio(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("a"), F.count_if(F.col("role") == "assistant").alias("b"))
    missing = F.when(F.col("a") > F.col("b"), F.sequence(F.col("b") + 1, F.col("a"))).otherwise(F.array().cast("array<bigint>"))
    return g.select("conv_id", A.page_ratio(F.col("a"), F.col("b")).alias("ratio"), missing.alias("missing"))


@query("AGG_15_page_statistics", "SELECT l_orderkey AS id, round(avg(l_discount), 6) AS mean, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_orderkey")
def page_statistics(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.min("l_discount").alias("low"), F.max("l_tax").alias("high"))


@query("AGG_17_objective", "SELECT p_partkey AS id, least(0.6::DOUBLE * (p_size / 50) + 0.4::DOUBLE * (p_retailprice / 3000), 0.55::DOUBLE) AS score FROM part")
def objective(spark, d):
    s = {"blocks": (0.6, F.col("p_size") / 50), "text": (0.4, F.col("p_retailprice") / 3000)}
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.objective(s, F.lit(0.55)).alias("score"))


@query("AGG_20_variants", f"WITH q AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS ord, length(event_type) AS number, event_type AS t FROM events), p AS (SELECT *, ord // 10 + 1 AS page FROM q), h AS (SELECT *, max(page) OVER (PARTITION BY user_id) AS pages FROM p), k AS (SELECT DISTINCT user_id, page > pages / 2 AS second, number, substr(regexp_replace(t, '{WS}+', '', 'g'), 1, 240) AS t FROM h), z AS (SELECT user_id, count(*) FILTER (NOT second) AS a, count(*) FILTER (second) AS b FROM k GROUP BY user_id), m AS (SELECT user_id, count(*) FILTER (n > 1) AS m FROM (SELECT user_id, number, t, count(*) AS n FROM k GROUP BY ALL) GROUP BY user_id), f AS (SELECT user_id, max(pages) AS pages, arg_min(CASE WHEN page > pages / 2 THEN number END, CASE WHEN page > pages / 2 THEN ord END) AS restart FROM h GROUP BY user_id) SELECT user_id, pages % 2 = 0 AND pages >= 8 AND least(a, b) > 0 AND m / greatest(least(a, b), 1) >= 0.8 AND coalesce(restart <= 5, false) AS variants FROM f JOIN z USING (user_id) JOIN m USING (user_id)")
def halves(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events").withColumn("ord", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long"))
    q = e.select("user_id", "ord", (F.floor(F.col("ord") / 10) + 1).alias("page"), F.length("event_type").alias("number"), F.col("event_type").alias("text"))
    return A.halves_repeat(q, "user_id")


@query("AGG_21_editable_share", "SELECT conv_id, sum(CASE WHEN contains(o.t, f.w) THEN length(f.w) ELSE 0 END) / sum(length(f.w)) AS share, sum(CASE WHEN contains(o.t, f.w) THEN length(f.w) ELSE 0 END) / sum(length(f.w)) >= 0.98 AS editable FROM (SELECT conv_id, key AS w FROM (" + _WORDS.format("user") + ") WHERE key <> '') f LEFT JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id) o USING (conv_id) GROUP BY conv_id")
def editable(spark, d):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    out = side(spark, d, "assistant").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
    return A.editable_share(words(spark, d, "user").where("key <> ''").withColumnRenamed("key", "fragment"), out, ["conv_id"])


@query("AGG_24_statistics", "SELECT o_orderpriority AS name, median(o_totalprice) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high, (max(o_totalprice) - min(o_totalprice)) / nullif(min(o_totalprice), 0) * 100 AS change FROM orders GROUP BY o_orderpriority")
def statistics(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.median(p).alias("median"), F.min(p).alias("low"), F.max(p).alias("high"), ((F.max(p) - F.min(p)) / F.nullif(F.min(p), F.lit(0.0)) * 100).alias("change"))


@query("AGG_27_sequences", "SELECT conv_id, turn, CAST(len(list_filter(range(1, greatest(length(text), 1)), lambda i: substr(text, i, 2) = 'er')) AS INTEGER) AS times FROM conversations")
def sequences(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", A.sequence_count(characters(F.col("text")), ["e", "r"]).alias("times"))


@query("SET_1_missing_words", "SELECT key FROM (" + _WORDS.format("user").replace("conv_id, ", "") + ") EXCEPT ALL SELECT key FROM (" + _WORDS.format("assistant").replace("conv_id, ", "") + ")")
def missing_words(spark, d):
    return A.missing_things(words(spark, d, "user").select("key"), words(spark, d, "assistant").select("key"))


@query("SET_2_common_words", "SELECT key FROM (" + _WORDS.format("user").replace("conv_id, ", "") + ") INTERSECT ALL SELECT key FROM (" + _WORDS.format("assistant").replace("conv_id, ", "") + ")")
def common_words(spark, d):
    return A.common_things(words(spark, d, "user").select("key"), words(spark, d, "assistant").select("key"))


@query("SET_3_distinct_missing", "SELECT key FROM (" + _WORDS.format("user").replace("conv_id, ", "") + ") EXCEPT SELECT key FROM (" + _WORDS.format("assistant").replace("conv_id, ", "") + ")")
def distinct_missing(spark, d):
    return A.distinct_missing(words(spark, d, "user").select("key"), words(spark, d, "assistant").select("key"))


@query("SET_4_ordered_distinct", "WITH w AS (SELECT conv_id, turn, w, min(i) AS i FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations) GROUP BY conv_id, turn, w) SELECT conv_id, turn, list(w ORDER BY i) AS words FROM w GROUP BY conv_id, turn")
def ordered_distinct(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("words"))


@query("SET_5_latest", "WITH b AS (SELECT 0 AS page, event_id AS pos, user_id AS id, value FROM events WHERE event_type = 'view' UNION ALL SELECT 1, event_id, user_id, value FROM events WHERE event_type = 'click') SELECT id, arg_max(value, page * 1000000000 + pos) AS value, CAST(min(page * 1000000000 + pos) // 1000000000 AS INTEGER) AS first_page, min(page * 1000000000 + pos) % 1000000000 AS first_pos FROM b GROUP BY id")
def latest(spark, d):
    e = lambda kind: table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias("pos"), F.col("user_id").alias("id"), "value")
    return A.latest(e("view"), e("click"), "id")


@query("SET_6_inventory", "WITH e AS (SELECT conv_id, list(CAST(length(text) % 3 AS BIGINT) ORDER BY turn) AS e FROM conversations WHERE role = 'user' GROUP BY conv_id), f AS (SELECT conv_id, list(CAST(length(text) % 3 AS BIGINT) ORDER BY turn) AS f FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, list_sort(coalesce(e, [])) = list_sort(coalesce(f, [])) AS same_ids, coalesce(e, []) = coalesce(f, []) AS same_order FROM e FULL JOIN f USING (conv_id)")
def inventory(spark, d):
    n = lambda role: side(spark, d, role).select("conv_id", F.col("turn").alias("pos"), (F.length("text") % 3).cast("long").alias("id"))
    return A.inventory(n("user"), n("assistant"), "conv_id")


@query("JOIN_14_equal_pages", "WITH d AS (SELECT lang, doc_id, text, min(doc_id) OVER (PARTITION BY lang, text) AS first FROM documents WHERE text <> '' AND lang IS NOT NULL), p AS (SELECT lang, doc_id, text, length(text) - 2 AS n FROM d WHERE doc_id = first AND length(text) >= 3), g AS (SELECT doc_id, lang, n, key, count(*) AS c FROM (SELECT doc_id, lang, n, unnest(list_transform(range(1, n + 1), lambda i: substr(text, i, 3))) AS key FROM p) GROUP BY ALL), s AS (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, sum(least(a.c, b.c)) AS m FROM g a JOIN g b ON a.lang = b.lang AND a.key = b.key AND a.doc_id < b.doc_id AND 2 * least(a.n, b.n) >= 0.985 * (a.n + b.n) GROUP BY ALL) SELECT lang, a, b, 2 * m / (na + nb) AS dice, false AS copy FROM s WHERE 2 * m / (na + nb) >= 0.985 UNION ALL SELECT DISTINCT lang, first, doc_id, 1.0::DOUBLE, true FROM d WHERE doc_id > first")
def equal_pages(spark, d):
    """A language stands for a document, its texts for pages: all pairs of different texts, and each copy with the first of its text."""
    return A.near_equal_pages(table(spark, d, "documents"), "lang", "doc_id", "text")


#: Texts behind formulas that are whole or not; {b} is a backslash.
_FORMULAS = "CASE doc_id % 5 WHEN 0 THEN '${{' || text WHEN 1 THEN '$x}}{{$ ' || text || ' □' WHEN 2 THEN {b} || '$5 {{a{{b}}}} ' || {b} || '(x ' || text WHEN 3 THEN {b} || '[y' || {b} || '] ' || {b} || '{{ ' || text ELSE text END"


def _times(part: str) -> str:
    """How often a string of two characters stands in v."""
    return f"((len(v) - len(replace(v, chr(92) || '{part}', ''))) // 2)"


#: Issues of texts (id, text, v): of formulas in v, of white space in text.
_ISSUES_OF = f"""
WITH t AS (@),
b AS (SELECT *, regexp_replace(replace(replace(v, chr(92) || '{{', ''), chr(92) || '}}', ''), '[^{{}}]', '', 'g') AS m, replace(v, chr(92) || '$', '') AS w FROM t),
d AS (SELECT *, list_transform(range(1, len(m) + 1), lambda i: 2 * len(replace(m[1:i], '}}', '')) - i) AS depth FROM b)
SELECT id, list_filter([CASE WHEN (len(w) - len(replace(w, '$', ''))) % 2 = 1 THEN 'dollars' END, CASE WHEN {_times("(")} <> {_times(")")} THEN 'parentheses' END, CASE WHEN {_times("[")} <> {_times("]")} THEN 'brackets' END,
  CASE WHEN len(depth) > 0 AND (list_min(depth) < 0 OR depth[len(depth)] <> 0) THEN 'braces' END, CASE WHEN regexp_matches(v, '[\\x{{FFFD}}\\x{{25A1}}\\x{{25A2}}\\x{{25A0}}\\x{{E000}}-\\x{{F8FF}}]') THEN 'glyphs' END], lambda x: x IS NOT NULL) AS issues,
  regexp_matches(coalesce(text, ''), '^{WS}|{WS}$|[ \\t]{{2,}}|[ \\t]\\n|\\n{WS}*\\n{WS}*\\n') AS spaces FROM d
"""
_ISSUES = _ISSUES_OF.replace("@", f"SELECT doc_id AS id, text, {_FORMULAS.format(b='chr(92)')} AS v FROM documents")
_TURN_ISSUES = _ISSUES_OF.replace("@", "SELECT {'conv': conv_id, 'turn': turn} AS id, coalesce(text, '') AS text, coalesce(text, '') AS v FROM conversations")


@query("AGG_18_reviews", f"SELECT *, CAST(greatest(0, 100 - 20 * errors - 10 * warnings - 3 * infos) AS BIGINT) AS score FROM (SELECT id.conv AS conv_id, id.turn AS turn, CAST((trim(v) = '')::INT + len(issues) AS INTEGER) AS errors, CAST((trim(coalesce(role, '')) = '')::INT AS INTEGER) AS warnings, CAST(2 + (v <> '' AND spaces)::INT AS INTEGER) AS infos FROM (SELECT i.*, c.role, coalesce(c.text, '') AS v FROM ({_TURN_ISSUES}) i JOIN conversations c ON c.conv_id = i.id.conv AND c.turn = i.id.turn))")
def reviews(spark, d):
    """Turns stand for items without choices; the rules are held against fixtures in the tests."""
    c = table(spark, d, "conversations")
    items = c.select("conv_id", "turn", F.col("turn").cast("string").alias("number"), F.lit("").alias("title"), F.col("text").alias("stem"), F.array().cast("array<string>").alias("choices"), F.lit("3").alias("answer"), F.col("role").alias("explanation"))
    return A.reviewed(items).select("conv_id", "turn", "errors", "warnings", "infos", "score")


@query("AGG_19_findings", "WITH k AS (SELECT o_custkey AS item_id, o_orderpriority AS kind, min(o_orderkey) AS ord FROM orders GROUP BY ALL), p AS (SELECT o_custkey AS item_id, CAST(min(o_orderkey % 100) AS BIGINT) AS page FROM orders GROUP BY ALL), o AS (SELECT o_custkey AS item_id, o_orderpriority AS kind, min((o_orderkey % 100) * 100000000 + o_orderkey) AS ord FROM orders GROUP BY ALL) SELECT item_id, any_value(p.page) AS page, list(kind ORDER BY o.ord)[1:8] AS kinds, greatest(count(*) - 8, 0) AS more FROM o JOIN p USING (item_id) GROUP BY item_id")
def findings(spark, d):
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("item_id"), (F.col("o_orderkey") % 100).alias("page"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("kind"))
    return A.findings_by_item(f)


@query("FLT_13_flagged", "SELECT o_custkey AS id, list(o_orderkey ORDER BY o_orderkey)[1:8] AS shown, greatest(count(*) - 8, 0) AS more FROM orders GROUP BY o_custkey")
def flagged(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("s"))
    return g.select("id", F.slice("s", 1, 8).alias("shown"), F.greatest(F.size("s") - 8, F.lit(0)).cast("long").alias("more"))


_BLOCKS = "SELECT o_custkey AS page, o_totalprice / 600000 AS area_ratio, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 100) / 100 END AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS text, o_orderstatus AS backend FROM orders"
_DIAG = f"SELECT page, count(*) AS blocks, count(*) FILTER (area_ratio >= 0.5) / greatest(count(*), 1) AS large_ratio, max(area_ratio) AS largest, count(*) FILTER (confidence < 0.5) / greatest(count(*), 1) AS low_confidence_ratio, count(*) FILTER (text = '') / greatest(count(*), 1) AS empty_ratio, avg(confidence) AS avg_confidence FROM ({_BLOCKS}) GROUP BY page"


def blocks(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("page"), (F.col("o_totalprice") / 600000).alias("area_ratio"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 100 / 100).alias("confidence"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("text"), F.col("o_orderstatus").alias("backend"), F.col("o_orderkey").alias("ord"))


def page_diagnostics(spark, d) -> DataFrame:
    return R.page_diagnostics(blocks(spark, d), ["page"], "ord")


@query("AGG_5_diagnostics", f"SELECT * REPLACE (round(avg_confidence, 6) AS avg_confidence) FROM ({_DIAG})")
def diagnostics(spark, d):
    return page_diagnostics(spark, d).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("AGG_5_backends", f"SELECT page, backend, count(*) AS n FROM ({_BLOCKS}) GROUP BY page, backend")
def backends(spark, d):
    return R.backend_histogram(blocks(spark, d), ["page"])


_RISK = f"SELECT page, greatest(s, o) AS risk FROM (SELECT page, round(least(1, CASE WHEN blocks <= 1 THEN 0.48 ELSE 0 END + CASE WHEN large_ratio >= 0.5 OR largest >= 0.72 THEN 0.4 ELSE 0 END), 4)::DOUBLE AS s, round(least(1, CASE WHEN empty_ratio >= 0.5 THEN 0.4 ELSE 0 END + CASE WHEN low_confidence_ratio >= 0.5 THEN 0.45 ELSE 0 END + CASE WHEN coalesce(avg_confidence < 0.55, false) THEN 0.3 ELSE 0 END), 4)::DOUBLE AS o FROM ({_DIAG}))"


@query("AGG_6_risk", f"SELECT page, risk, CASE WHEN risk >= 0.66 THEN 'red' WHEN risk >= 0.33 THEN 'yellow' ELSE 'green' END AS tier FROM ({_RISK})")
def risk(spark, d):
    r = page_diagnostics(spark, d).select("page", F.greatest(R.segmentation_risk(), R.recognition_risk()).alias("risk"))
    return r.withColumn("tier", R.tier(F.col("risk")))


@query("AGG_7_routes", f"WITH t AS (SELECT page, CASE WHEN risk >= 0.66 THEN 'red' WHEN risk >= 0.33 THEN 'yellow' ELSE 'green' END AS tier, page % 2 = 0 AS ai, page % 5 = 0 AS forced FROM ({_RISK})) SELECT page, CASE WHEN ai AND (forced OR tier <> 'green') THEN 'ai_patch' ELSE 'local_only' END AS route, CASE WHEN ai AND (forced OR tier = 'red') THEN NULL WHEN tier = 'red' THEN 'ai_repair' WHEN tier = 'yellow' THEN 'local_retry' END AS next_best_action, CASE tier WHEN 'red' THEN 'failed' WHEN 'yellow' THEN 'suspicious' ELSE 'ok' END AS quality_status FROM t")
def routes(spark, d):
    return risk(spark, d).select("page", R.route(F.col("tier"), F.col("page") % 2 == 0, F.col("page") % 5 == 0).alias("r")).select("page", "r.*")


@query("AGG_22_cache_summary", "SELECT count(*) AS entries, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 10) AS large FROM events")
def cache_summary(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 10).alias("large"))


@query("AGG_23_unreadable", f"SELECT doc_id AS id, CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\\x{{E000}}-\\x{{F8FF}}]', '', 'g')) / length(t) ELSE 0 END AS share FROM (SELECT doc_id, regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN repeat(chr(57345), 50) ELSE '' END, '{WS}+', '', 'g') AS t FROM documents)")
def unreadable(spark, d):
    lost = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit(chr(57345)), F.lit(50))).otherwise(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), R.unreadable_share(lost).alias("share"))


@query("PRJ_13_pdf_failures", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'empty' WHEN o_orderkey % 7 = 0 THEN 'encrypted' WHEN o_custkey % 4 = 0 THEN 'damaged' WHEN (o_totalprice / 10000) / greatest(o_custkey % 4, 1) < 20 THEN 'scan_only' ELSE 'ok' END AS failure FROM orders")
def pdf_failures(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), R.pdf_failure(F.col("o_orderkey") % 10, F.col("o_orderkey") % 7 == 0, F.lit(True), F.col("o_custkey") % 4, F.col("o_totalprice") / 10000).alias("failure"))


@query("PRJ_12_block_kinds", "SELECT p_partkey AS id, CASE WHEN v = '' THEN 'unknown' WHEN regexp_matches(v, '=|lim|sin|cos|tan|log|∫|∑|√|≤|≥|확률|함수|미분|적분') THEN 'formula' WHEN regexp_matches(v, '^([①②③④⑤❶❷❸❹❺➀➁➂➃➄]|[1-5]\\)|[A-D]\\.)') THEN 'choice' WHEN length(v) <= 24 AND regexp_matches(v, '(장|단원|주제)$') THEN 'section' ELSE 'stem' END AS kind FROM (SELECT p_partkey, trim(CASE p_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'x = ' || p_size WHEN 2 THEN (p_size % 7 + 1) || ') ' || p_name WHEN 3 THEN p_name || ' 단원' WHEN 4 THEN '함수 ' || p_name ELSE p_name END) AS v FROM part)")
def block_kinds(spark, d):
    k = F.col("p_partkey") % 6
    v = F.when(k == 0, " ").when(k == 1, F.concat(F.lit("x = "), "p_size")).when(k == 2, F.concat(F.col("p_size") % 7 + 1, F.lit(") "), "p_name")).when(k == 3, F.concat("p_name", F.lit(" 단원"))).when(k == 4, F.concat(F.lit("함수 "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), R.block_kind(v).alias("kind"))


@query("STR_19_math_issues", _ISSUES)
def math_issues(spark, d):
    """Texts have no formulas: some are put before them."""
    t = F.expr(_FORMULAS.format(b="char(92)"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), A.math_issues(t).alias("issues"), A.whitespace_issue(F.col("text")).alias("spaces"))
