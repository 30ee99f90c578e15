"""Bank queries. Documents stand for items: doc_id is the id, source the source name, lang the subject, text the stem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CIRCLED, UPPER, LOWER, WS, circled_answer, cleaned, collapsed, json_list, visual_units, wrapped_lines
from ..operators import bank
from ..registry import query, table

_FOLD = f"translate({{}}, '{UPPER}', '{LOWER}')"
_LIKE = _FOLD.format("text") + " LIKE '%er%'"
_COLLAPSE = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"
_HASH = f"CASE WHEN {_COLLAPSE} = '' THEN '' ELSE 'v2:' || sha1({_COLLAPSE}) END"


def items(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_name"), F.col("lang").alias("subject"), F.col("text").alias("stem"), "n_chars")


@query("FLT_1_item_search", f"SELECT doc_id AS id, source AS source_name, lang AS subject, n_chars FROM documents WHERE ({_LIKE} OR {_FOLD.format('source')} LIKE '%er%') AND {_FOLD.format('lang')} LIKE '%en%'")
def item_search(spark, d):
    return bank.matching(items(spark, d), q="ER", subject="EN").drop("stem")


@query("FLT_2_item_page", f"SELECT doc_id AS id, source AS source_name, lang AS subject FROM documents WHERE {_LIKE} OR {_FOLD.format('source')} LIKE '%er%' ORDER BY doc_id DESC LIMIT 100 OFFSET 20")
def item_page(spark, d):
    return bank.page(bank.matching(items(spark, d), q="er"), 100, 20).select("id", "source_name", "subject")


@query("FLT_2_item_page_info", f"SELECT count(*) AS total, CAST(greatest(0, least(100, count(*) - 20)) AS BIGINT) AS rows, 20 + greatest(0, least(100, count(*) - 20)) < count(*) AS has_more FROM documents WHERE {_LIKE} OR {_FOLD.format('source')} LIKE '%er%'")
def item_page_info(spark, d):
    return bank.page_info(bank.matching(items(spark, d), q="er"), 100, 20)


@query("FLT_3_item_count", f"SELECT count(*) AS total FROM documents WHERE {_FOLD.format('text')} LIKE '%a_d%' OR {_FOLD.format('source')} LIKE '%a_d%'")
def item_count(spark, d):
    return bank.matching(items(spark, d), q="a_d").agg(F.count(F.lit(1)).alias("total"))


@query("SRC_1_item_scan", "SELECT doc_id AS id, source AS source_name, lang AS subject, n_chars FROM documents WHERE source = 'src0' AND lang LIKE '%e%'")
def item_scan(spark, d):
    return bank.matching(items(spark, d).where(F.col("source_name") == "src0"), subject="e").drop("stem")


@query("SRC_2_item_lookup", "SELECT doc_id AS id, source AS source_name, text AS stem FROM documents WHERE doc_id = 17")
def item_lookup(spark, d):
    return items(spark, d).where(F.col("id") == 17).select("id", "source_name", "stem")


def selection(spark, d) -> DataFrame:
    """Exams of labelled documents (every hundredth is of one exam), in the order of quality, then the newest first."""
    from pyspark.sql import Window as W

    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return labels.select(F.col("doc_id").alias("id"), F.row_number().over(W.partitionBy(F.col("doc_id") % 100).orderBy(F.desc("quality"), F.desc("doc_id"))).cast("long").alias("pos"))


_SELECTION = "SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY quality DESC, doc_id DESC) AS pos FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)"


@query("JOIN_2_items_in_selection_order", f"SELECT s.pos, s.id, d.source AS source_name, d.n_chars FROM ({_SELECTION}) s JOIN documents d ON d.doc_id = s.id")
def items_in_order(spark, d):
    return bank.in_order(items(spark, d), selection(spark, d)).select("pos", "id", "source_name", "n_chars")


@query("JOIN_3_missing_ids", "SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)")
def missing_ids(spark, d):
    return bank.missing(items(spark, d), table(spark, d, "events").select(F.col("event_id").alias("id")))


@query("JOIN_3_repeated_ids", "SELECT l_partkey AS id, count(*) AS times FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def repeated_ids(spark, d):
    return bank.repeated(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")))


@query("JOIN_4_answer_key", "SELECT d.doc_id AS id, coalesce(CASE WHEN d.doc_id % 7 = 0 THEN 'own' END, CAST(l.quality AS VARCHAR)) AS answer, d.doc_id % 7 <> 0 AND l.quality IS NOT NULL AS mapped FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def answer_key(spark, d):
    """Every seventh item has an answer of its own, which the key doesn't overwrite."""
    from ..operators.compose import with_answer_key

    own = table(spark, d, "documents").select(F.col("doc_id").alias("number"), F.when(F.col("doc_id") % 7 == 0, "own").alias("answer"))
    key = table(spark, d, "labels").groupBy(F.col("doc_id").alias("number")).agg(F.min("quality").cast("string").alias("value"))
    return with_answer_key(own, key).select(F.col("number").alias("id"), "answer", "mapped")


@query("JOIN_5_answer_key_report", "SELECT count(*) FILTER (d.doc_id IS NOT NULL AND d.doc_id % 7 <> 0) AS mapped, count(*) FILTER (d.doc_id IS NULL) AS unmatched FROM (SELECT DISTINCT user_id AS number FROM events) k LEFT JOIN documents d ON d.doc_id = k.number")
def answer_key_report(spark, d):
    from ..operators.compose import key_report

    own = table(spark, d, "documents").select(F.col("doc_id").alias("number"), F.when(F.col("doc_id") % 7 == 0, "own").alias("answer"))
    key = table(spark, d, "events").select(F.col("user_id").alias("number")).distinct().withColumn("value", F.lit("1"))
    return key_report(own, key)


@query("DED_1_content_identity", f"SELECT doc_id AS id, {_HASH} AS content_hash FROM documents")
def content_identity(spark, d):
    return items(spark, d).select("id", bank.identity(F.col("stem")).alias("content_hash"))


@query("DED_2_stored_duplicates", f"WITH h AS (SELECT doc_id, source, {_HASH} AS h, CASE WHEN doc_id % 3 = 0 THEN sha1(lower({_COLLAPSE})) ELSE {_HASH} END AS stored, sha1(lower({_COLLAPSE})) AS old FROM documents), b AS (SELECT * FROM h WHERE doc_id % 2 = 0) SELECT n.doc_id AS id, min(b.doc_id) AS duplicate_of FROM h n LEFT JOIN b ON n.doc_id % 2 = 1 AND b.source = n.source AND b.h = n.h AND b.stored IN (n.h, n.old) AND n.h <> '' WHERE n.doc_id % 2 = 1 GROUP BY n.doc_id")
def stored_duplicates(spark, d):
    """Items with even ids are the bank, a third of it with the former hash; the others come in."""
    fields = F.col("stem")
    stored = F.when(F.col("id") % 3 == 0, bank.legacy_identity(fields)).otherwise(bank.identity(fields))
    old = items(spark, d).where("id % 2 = 0").withColumn("content_hash", stored)
    return bank.duplicate_of(items(spark, d).where("id % 2 = 1"), old).select("id", "duplicate_of")


#: What an item is in an import: its stem, two choices, its answer and, for every third id, a table.
_CONTENT = "coalesce(text, '') || chr(10) || lang || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'c' END || chr(10) || source || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '[[[\"' || lang || '\"]]]' ELSE '' END"
_WHOLE_HASH = f"'v2:' || sha1(trim(regexp_replace({_CONTENT}, '{WS}+', ' ', 'g')))"
_IMPORT = f"""WITH h AS (SELECT doc_id, source, {_WHOLE_HASH} AS h FROM documents), m AS (SELECT n.*, (SELECT min(b.doc_id) FROM h b WHERE b.doc_id % 4 = 0 AND b.source = n.source AND b.h = n.h) AS dup FROM h n WHERE n.doc_id % 4 <> 0)
SELECT doc_id AS id, dup AS duplicate_of, CASE WHEN dup IS NOT NULL THEN 'existing' WHEN row_number() OVER (PARTITION BY dup IS NULL, h ORDER BY doc_id) > 1 THEN 'skipped' ELSE 'created' END AS state FROM m"""


@query("DED_3_import_states", _IMPORT)
def import_states(spark, d):
    """A quarter of the items is the bank; the rest is one import. Items with one stem and other choices or tables are others."""
    table_of = F.when(F.col("id") % 3 == 0, F.array(F.array(F.array("subject"))))
    whole = bank.item_content(F.col("stem"), F.array(F.col("subject"), F.when(F.col("id") % 2 == 0, "b").otherwise("c")), F.col("source_name"), table_of, F.array().cast("array<string>"))
    told = items(spark, d).withColumn("content", whole)
    old = told.where("id % 4 = 0").withColumn("content_hash", bank.identity(F.col("content")))
    return bank.import_states(told.where("id % 4 <> 0"), old, F.col("content"))


@query("DED_4_import_result", f"SELECT state, count(*) AS n, min(id) AS first_id FROM ({_IMPORT}) GROUP BY state")
def import_result(spark, d):
    return import_states(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("DED_4_ordered_ids", "SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY l_partkey")
def ordered_ids(spark, d):
    return bank.ordered_ids(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")))


@query("DED_6_same_words", f"SELECT item_id, len(w) AS words, len(w) - len(list_distinct(w)) AS repeats FROM (SELECT item_id, list_transform(string_split(text, ' '), lambda x: replace(lower(regexp_replace(regexp_replace(x, '^{WS}*(?:[{CIRCLED}]|\\(?[1-9][.)])', ''), '{WS}+', '', 'g')), 'ß', 'ss')) AS w FROM (SELECT item_id, text || ' Straße STRASSE ① strasse' AS text FROM benchmark))")
def same_words(spark, d):
    """The words of a benchmark item stand for choices."""
    keys = F.transform(F.split(F.concat("text", F.lit(" Straße STRASSE ① strasse")), " "), bank.choice_key)
    return table(spark, d, "benchmark").select("item_id", F.size(keys).cast("long").alias("words"), (F.size(keys) - F.size(F.array_distinct(keys))).cast("long").alias("repeats"))


@query("SNK_1_append", "SELECT r_regionkey + 0 AS id, r_name AS name FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_nationkey) AS id, n_name FROM nation")
def append(spark, d):
    old = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return bank.appended(old, table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name")))


@query("SNK_2_insert_unique", f"SELECT id FROM ({_IMPORT}) WHERE state = 'created'")
def insert_unique(spark, d):
    return import_states(spark, d).where("state = 'created'").select("id")


@query("SNK_3_update", f"SELECT d.doc_id AS id, d.source AS source_name, CASE WHEN l.quality = 1 THEN 'checked' ELSE d.lang END AS subject FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def update(spark, d):
    changes = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q")).select("id", F.when(F.col("q") == 1, "checked").alias("subject"))
    return bank.updated(items(spark, d).select("id", "source_name", "subject"), changes, ["subject"])


@query("SNK_4_delete", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete(spark, d):
    return bank.deleted(items(spark, d).select("id"), table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))


@query("SNK_6_upsert_counts", "SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_custkey AS key, 10 AS n FROM customer UNION ALL SELECT user_id, 1 FROM events) GROUP BY key")
def upsert_counts(spark, d):
    counters = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(10).cast("long").alias("n"))
    return bank.upserted_counts(counters, table(spark, d, "events").select(F.col("user_id").alias("key")))


@query("PRJ_2_aliased_fields", "SELECT trim(c_name) AS title, CAST(c_custkey AS VARCHAR) AS number, '' AS stem FROM customer")
def aliased_fields(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("NO"), F.col("c_name").alias("Title"))
    return bank.aliased_fields(rows, {"title": ["title", "제목"], "number": ["number", "num", "no", "번호"], "stem": ["stem", "question"]})


@query("PRJ_3_choices", f"SELECT conv_id, turn, list_filter(list_transform(string_split(replace(text, chr(10), '|'), '|'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS choices FROM conversations")
def choices(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", bank.choices_split(F.col("text")).alias("choices"))


@query("PRJ_4_titles", "SELECT doc_id AS id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS title FROM documents")
def titles(spark, d):
    return items(spark, d).select("id", bank.titled(F.lit(""), F.col("stem")).alias("title"))


@query("PRJ_5_public_jobs", "SELECT event_id AS id, event_type AS state, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM events")
def public_jobs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("state"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")


@query("PRJ_9_answers", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 AND regexp_full_match(substr(o_orderpriority, 1, 1), '[1-9]') THEN substr('{CIRCLED}', CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 1) ELSE substr(o_orderpriority, 1, 1) END AS answer FROM orders")
def answers(spark, d):
    """A third of the items has no choices."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), circled_answer(F.substring("o_orderpriority", 1, 1), F.lit(True), F.col("o_orderkey") % 3 > 0).alias("answer"))


@query("PRJ_15_image_paths", "SELECT page_id, list_distinct(list_filter([url, 'img/' || page_id || '.PNG', '../x.png', '/a.png', 'img/' || page_id || '.PNG'], lambda p: NOT regexp_matches(p, '^([/\\\\]|[A-Za-z]:)') AND NOT regexp_matches(p, '(^|[/\\\\])\\.\\.([/\\\\]|$)') AND regexp_matches(lower(p), '\\.(png|jpg|jpeg|gif|webp|bmp)$'))) AS paths FROM pages")
def image_paths(spark, d):
    name = F.concat(F.lit("img/"), F.col("page_id"), F.lit(".PNG"))
    return table(spark, d, "pages").select("page_id", bank.safe_image_paths(F.array("url", name, F.lit("../x.png"), F.lit("/a.png"), name)).alias("paths"))


@query("ARR_1_json_lists", "SELECT event_id, [props] AS list FROM events")
def json_lists(spark, d):
    """An object isn't a list, so its text is the only element."""
    return table(spark, d, "events").select("event_id", json_list(F.col("props")).alias("list"))


@query("STR_3_cleaned", f"SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g') AS text FROM documents")
def cleaned_texts(spark, d):
    return items(spark, d).select("id", cleaned(F.col("stem")).alias("text"))


_UNITS = f"(length(x) + length(regexp_replace(regexp_replace(x, '{WS}', '', 'g'), '[\\x00-\\x{{FF}}]', '', 'g')))"


@query("STR_16_wrapped_lines", f"SELECT doc_id AS id, CAST(length(x) + length(regexp_replace(regexp_replace(x, '{WS}', '', 'g'), '[\\x00-\\x{{FF}}]', '', 'g')) AS BIGINT) AS units, CAST(list_sum(list_transform(string_split(regexp_replace(x, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: greatest(1, CAST(ceil({_UNITS} / 48.0) AS BIGINT)))) AS BIGINT) AS lines FROM (SELECT doc_id, text AS x FROM documents)")
def wrapped(spark, d):
    return items(spark, d).select("id", visual_units(F.col("stem")).cast("long").alias("units"), wrapped_lines(F.col("stem"), 48).alias("lines"))


@query("STR_collapsed", f"SELECT doc_id AS id, {_COLLAPSE} AS text FROM documents")
def collapsed_texts(spark, d):
    return items(spark, d).select("id", collapsed(F.col("stem")).alias("text"))
