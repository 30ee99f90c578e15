"""Further queries: order-dependent folds over pages and conversations, loose keys, names, tables and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exam_text as T
from ..functions.text import WS
from ..operators import audit, bank
from ..operators import geometry as G
from ..operators import segment as S
from ..registry import query, table
from .segment_queries import _SQL_PARTS, boxes

#: Stems of forms of an exam: a number, a form's name, and of some a score, behind which they differ.
_STEM = "CASE WHEN doc_id % 3 = 0 THEN (doc_id % 90 + 1) || '. ' ELSE '' END || CASE doc_id % 4 WHEN 0 THEN '(홀수형) ' WHEN 1 THEN '짝수형' ELSE '' END || CASE WHEN doc_id % 5 < 2 THEN substr(text, 1, 60) || ' [ 3 점 ] ' || doc_id ELSE text END"
_HEAD = "CASE WHEN regexp_matches(t, '\\[\\s*\\d+\\s*점\\s*\\]') THEN regexp_extract(t, '(?s)^(.*?\\[\\s*\\d+\\s*점\\s*\\])', 1) ELSE array_to_string(string_split(t, chr(10))[1:6], chr(10)) END"
_LOOSE = f"regexp_replace(regexp_replace(regexp_replace({_HEAD}, '^\\s*\\d{{1,3}}\\s*[.)]\\s*', ''), '\\(?\\s*(?:홀수형|짝수형|미적분|확률과\\s*통계|기하)\\s*\\)?', '', 'g'), '[^0-9A-Za-z가-힣α-ωΑ-Ω]+', '', 'g')"


@query("DED_5_loose_keys", f"SELECT k AS key, min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, CASE WHEN length(b) < 24 THEN '' ELSE lang || ':' || substr(b, 1, 180) END AS k FROM (SELECT doc_id, lang, {_LOOSE} AS b FROM (SELECT doc_id, lang, {_STEM} AS t FROM documents))) WHERE k <> '' GROUP BY k")
def loose_keys(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.explode(F.array(bank.loose_key(F.col("lang"), F.expr(_STEM)))).alias("key"))  # behind explode no filter works a key out again
    return k.where("key <> ''").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


#: Names with Hangul in pieces, signs, and folders.
_NAMED = "concat(source, '/', doc_id, ' ᄒ', 'ᅡ', 'ᆫ글? ', text, '.hwp')"


@query("PRJ_14_safe_names", f"SELECT doc_id AS id, substr(regexp_replace(nfc_normalize({_NAMED}), '[^0-9A-Za-z가-힣._-]+', '_', 'g'), 1, 80) AS name, substr(regexp_replace(trim(regexp_extract(nfc_normalize({_NAMED}), '(?s)([^/]*)$', 1)), '[^0-9A-Za-z가-힣._ -]+', '_', 'g'), 1, 120) AS upload FROM documents WHERE NOT contains(text, chr(92))")
def safe_names(spark, d):
    raw = F.expr(_NAMED)
    return table(spark, d, "documents").where(~F.contains("text", F.lit("\\"))).select(F.col("doc_id").alias("id"), bank.safe_name(raw).alias("name"), bank.upload_name(raw).alias("upload"))


@query("ARR_2_tables", "SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) % 5 = 0 THEN [] ELSE [list_transform(string_split(l, '.'), lambda c: CASE WHEN length(c) % 4 = 0 THEN '' ELSE trim(c) END), []] END), lambda t: len(t) > 0) AS tables FROM conversations WHERE text IS NOT NULL")
def tables(spark, d):
    """A turn's lines are its tables (some missing), sentences their cells (some missing), each with a missing second row."""
    cells = lambda line: F.transform(F.split(line, r"\."), lambda c: F.when(F.length(c) % 4 > 0, F.concat(F.lit(" "), c)))
    raw = F.transform(F.split("text", "\n"), lambda line: F.when(F.length(line) % 5 > 0, F.array(cells(line), F.lit(None).cast("array<string>"))))
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", bank.normal_tables(raw).alias("tables"))


@query("STR_18_identifiers", "SELECT doc_id AS id, regexp_extract_all(text, '([A-Za-z]+[0-9]+(?:-[0-9]+)*)') AS ids FROM documents")
def identifiers(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), bank.identifiers(F.col("text")).alias("ids"))


@query("STR_23_hosts", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def hosts(spark, d):
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))


@query("STR_23_quoted", "SELECT page_id, replace(url_encode(url), '%2F', '/') AS quoted FROM pages")
def quoted(spark, d):
    return table(spark, d, "pages").select("page_id", bank.quoted(F.col("url")).alias("quoted"))


@query("STR_7_field_spans")
def field_spans(spark, d):
    fields = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in (("stem", F.col("text")), ("answer", F.concat(F.lit("x = "), F.col("turn").cast("string"))))])
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(fields).alias("at", "f"))
    return rows.select("conv_id", "turn", "f.field", F.explode(T.spans(F.col("f.value"))).alias("s")).select("conv_id", "turn", "field", "s.*")


_SAID = "CASE turn % 5 WHEN 0 THEN '[정답 표] ' || text WHEN 1 THEN ' 빠른  정답 ' || text WHEN 2 THEN '3. 정답표 ' || text WHEN 3 THEN '정답과 해설' ELSE text END"


@query("STR_13_key_sections", f"SELECT conv_id, turn, regexp_matches(f, '^(빠른[ \t]*정답|정답[ \t]*(및|과)[ \t]*해설|정답[ \t]*표|\\[[ \t]*정답[ \t]*표[ \t]*\\])') AND NOT regexp_matches(f, '^(문제[ \t]*)?[0-9]{{1,3}}[ \t]*[.)]([^0-9]|$)') AS starts_key FROM (SELECT conv_id, turn, ltrim(regexp_extract(ltrim({_SAID}), '^[^\n]*')) AS f FROM conversations)")
def key_sections(spark, d):
    from ..functions.exam_columns import opens_key

    return table(spark, d, "conversations").select("conv_id", "turn", opens_key(F.expr(_SAID)).alias("starts_key"))


@query("CMP_8_groups_by_end", "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS \"group\" FROM conversations")
def groups_by_end(spark, d):
    return S.groups_by_end(table(spark, d, "conversations"), F.col("role") == "assistant", "conv_id", "turn").select("conv_id", "turn", "group")


@query("WIN_13_walked_columns", f"SELECT id, CAST(sum(CASE WHEN t < prev THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS \"column\" FROM (SELECT *, lag(t) OVER (PARTITION BY page ORDER BY id) AS prev FROM ({_SQL_PARTS}))")
def walked(spark, d):
    return S.walked_columns(boxes(spark, d).withColumn("top", F.col("box.top")), "page", "id").select("id", "column")


@query("JOIN_16_paragraph_flow", "WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role = 'user'), l AS (SELECT conv_id, turn * 100000 + i AS line_id, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)), p AS (SELECT conv_id, text FROM conversations WHERE role = 'assistant'), j AS (SELECT l.conv_id, l.line_id, coalesce(bool_or(strpos(text, a) > 0 AND strpos(substr(text, strpos(text, a) + length(a)), b) > 0), false) AS k, coalesce(bool_or(contains(text, a)), false) AS ca, coalesce(bool_or(contains(text, b)), false) AS cb FROM l LEFT JOIN p USING (conv_id) GROUP BY ALL) SELECT conv_id, line_id, CASE WHEN k THEN 'kept' WHEN ca AND cb THEN 'split' ELSE 'missing' END AS flow FROM j")
def flow(spark, d):
    c = table(spark, d, "conversations")
    words = F.split("text", " ")
    pairs = F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b")), lambda x: x["b"].isNotNull())
    lines = c.where("role = 'user'").select("conv_id", "turn", F.posexplode(pairs).alias("i", "p"))
    lines = lines.select("conv_id", (F.col("turn") * 100000 + F.col("i") + 1).alias("line_id"), F.col("p.a").alias("first"), F.col("p.b").alias("second"))
    return audit.paragraph_flow(lines, c.where("role = 'assistant'").select("conv_id", "text"), ["conv_id"])


def page_rows(spark, d):
    return boxes(spark, d).select("page", "id", "p_size", F.col("box.left").alias("x"), F.col("box.top").alias("y"), S.right(F.col("box")).alias("x2"), S.bottom(F.col("box")).alias("y2"))


@query("WIN_12_choice_runs", f"WITH RECURSIVE p AS (SELECT *, CAST(w AS BIGINT) % 5 + 1 AS number, row_number() OVER (PARTITION BY page ORDER BY t, id) AS i FROM ({_SQL_PARTS})), s AS (SELECT page, id, i, l AS lane, number AS last, CAST(0 AS BIGINT) AS run, true AS question FROM p WHERE i = 1 UNION ALL SELECT page, id, i, CASE WHEN NOT question THEN lane WHEN aside THEN l ELSE lane * 0.8 + l * 0.2 END, CASE WHEN question THEN number ELSE last END, CASE WHEN question THEN 0 ELSE number END, question FROM (SELECT p.page, p.id, p.i, p.l, p.number, s.lane, s.last, abs(p.l - s.lane) > 24 AS aside, NOT ((abs(p.l - s.lane) > 24 OR p.number <= s.last) AND p.number = s.run + 1) AS question FROM s JOIN p ON p.page = s.page AND p.i = s.i + 1)) SELECT page, id, question FROM s")
def choice_runs(spark, d):
    pages = G.listed(page_rows(spark, d), "page", ["y", "id"], "x", "p_size")
    marks = F.transform("rows", lambda r: F.struct(r["x"].alias("x"), (r["p_size"] % 5 + 1).alias("number")))
    told = pages.select("page", F.explode(F.arrays_zip(F.col("rows")["id"].alias("id"), G.choice_runs(marks).alias("question"))).alias("m"))
    return told.select("page", "m.id", "m.question")


@query("WIN_16_clusters", f"WITH RECURSIVE p AS ({_SQL_PARTS}), c AS (SELECT page, CAST(0 AS BIGINT) AS cluster, min(t) AS low FROM p GROUP BY page UNION ALL SELECT c.page, c.cluster + 1, min(p.t) FROM c JOIN p ON p.page = c.page AND p.t > c.low + 18 GROUP BY c.page, c.cluster) SELECT c.page, cluster, low, count(*) AS n FROM c JOIN p ON p.page = c.page AND p.t BETWEEN low AND low + 18 GROUP BY ALL")
def clusters(spark, d):
    """Tops of a page's boxes within 18 of their cluster's first."""
    return G.clustered(page_rows(spark, d), "page", "y", 18.0, True).select("page", "cluster", "low", "n")


@query("WIN_16_running_means", f"WITH RECURSIVE p AS (SELECT page, l, row_number() OVER (PARTITION BY page ORDER BY l, id) AS i FROM ({_SQL_PARTS})), c AS (SELECT page, i, CAST(0 AS BIGINT) AS cluster, l AS total, CAST(1 AS BIGINT) AS k FROM p WHERE i = 1 UNION ALL SELECT p.page, p.i, CASE WHEN abs(p.l - total / k) <= 22 THEN cluster ELSE cluster + 1 END, CASE WHEN abs(p.l - total / k) <= 22 THEN total + p.l ELSE p.l END, CASE WHEN abs(p.l - total / k) <= 22 THEN k + 1 ELSE 1 END FROM c JOIN p ON p.page = c.page AND p.i = c.i + 1) SELECT page, cluster, max(k) AS n, arg_max(total, k) / max(k) AS mean FROM c GROUP BY page, cluster")
def running_means(spark, d):
    """Left edges within 22 of their cluster's mean so far."""
    return G.clustered(page_rows(spark, d), "page", "x", 22.0, False).select("page", "cluster", "n", "mean")


@query("GEO_4_merged_segments", f"WITH RECURSIVE p AS (SELECT page, t AS axis, l AS a, l + w AS b, row_number() OVER (PARTITION BY page ORDER BY t, l, l + w, id) AS i FROM ({_SQL_PARTS})), m AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(axes DOUBLE[], a DOUBLE, b DOUBLE)[]) AS g FROM p UNION ALL SELECT page, i, CASE WHEN k IS NULL THEN list_append(g, {{'axes': [axis], 'a': a, 'b': b}}) ELSE list_transform(g, lambda x, j: CASE WHEN j = k THEN {{'axes': list_append(x.axes, axis), 'a': least(x.a, a), 'b': greatest(x.b, b)}} ELSE x END) END FROM (SELECT p.page, p.i, m.g, p.axis, p.a, p.b, list_filter(range(1, len(m.g) + 1), lambda j: abs(m.g[j].axes[1] - p.axis) <= 20 AND p.a <= m.g[j].b + 60 AND p.b >= m.g[j].a - 60)[1] AS k FROM m JOIN p ON p.page = m.page AND p.i = m.i + 1)) SELECT page, list_aggregate(x.axes, 'median') AS axis, x.a AS start, x.b AS \"end\" FROM (SELECT page, unnest(g) AS x FROM m QUALIFY i = max(i) OVER (PARTITION BY page))")
def segments(spark, d):
    rows = page_rows(spark, d).select("page", "id", F.col("y").alias("axis"), F.col("x").alias("start"), F.col("x2").alias("end"))
    pages = G.listed(rows, "page", ["axis", "start", "end", "id"])
    return pages.select("page", F.explode(G.merged_segments(F.col("rows"), 20, 60)).alias("s")).select("page", "s.axis", "s.start", "s.end")


@query("JOIN_12_note_places", "WITH RECURSIVE a AS (SELECT conv_id, turn, list_filter(v, lambda w: length(w) = list_max(list_transform(v, lambda u: length(u))))[1] AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS v FROM conversations WHERE role = 'user')), c AS (SELECT conv_id, coalesce(list(text ORDER BY turn) FILTER (role IS DISTINCT FROM 'user'), []) AS texts, list(turn ORDER BY turn) FILTER (role IS DISTINCT FROM 'user') AS turns FROM conversations GROUP BY conv_id), m AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS cursor, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS DOUBLE) AS place FROM c UNION ALL SELECT conv_id, i, coalesce(k, cursor), turn, CAST(turns[k] AS DOUBLE) FROM (SELECT m.conv_id, a.i, m.cursor, a.turn, c.turns, list_filter(range(m.cursor, len(c.texts) + 1), lambda q: a.a <> '' AND contains(c.texts[q], a.a))[1] AS k FROM m JOIN a ON a.conv_id = m.conv_id AND a.i = m.i + 1 JOIN c ON c.conv_id = m.conv_id)) SELECT conv_id, turn, place FROM m WHERE i > 0")
def notes(spark, d):
    """A user's turn is a note, anchored by its first longest word; the other turns are the chunks."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    words = F.split("text", " ")
    longest = F.element_at(F.filter(words, lambda w: F.length(w) == F.array_max(F.transform(words, lambda u: F.length(u)))), 1)
    note, chunk = F.when(F.col("role") == "user", F.struct("turn", longest.alias("anchor"))), F.when(~F.col("role").eqNullSafe(F.lit("user")), F.struct("turn", "text"))
    lists = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(note)).alias("notes"), F.sort_array(F.collect_list(chunk)).alias("chunks"))
    places = F.transform(G.note_places(F.col("notes")["anchor"], F.col("chunks")["text"]), lambda k: F.get(F.col("chunks"), k)["turn"].cast("double"))
    told = lists.select("conv_id", F.explode(F.arrays_zip(F.col("notes")["turn"].alias("turn"), places.alias("place"))).alias("n"))
    return told.select("conv_id", "n.turn", "n.place")


@query("JOIN_13_band_scores", f"WITH RECURSIVE g AS (SELECT page, coalesce(list([t, t + h] ORDER BY t, t + h) FILTER (id % 2 = 1), []) AS a, coalesce(list([t, t + h] ORDER BY t, t + h) FILTER (id % 2 = 0), []) AS b FROM ({_SQL_PARTS}) GROUP BY page), m AS (SELECT page, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(0 AS BIGINT) AS hits FROM g UNION ALL SELECT page, i + CAST(hit OR less AS BIGINT), j + CAST(hit OR NOT less AS BIGINT), hits + CAST(hit AS BIGINT) FROM (SELECT page, i, j, hits, abs(a[i][1] - b[j][1]) <= 12 AND abs(a[i][2] - b[j][2]) <= 12 AS hit, a[i][1] < b[j][1] AS less FROM m JOIN g USING (page) WHERE i <= len(a) AND j <= len(b))) SELECT page, CAST(2 * max(hits) AS DOUBLE) / (len(any_value(a)) + len(any_value(b))) AS score FROM m JOIN g USING (page) GROUP BY page")
def bands(spark, d):
    band = F.struct(F.col("y").alias("top"), F.col("y2").alias("bottom"))
    side = lambda k: F.sort_array(F.collect_list(F.when(F.col("id") % 2 == k, band)))
    pages = page_rows(spark, d).groupBy("page").agg(side(1).alias("source"), side(0).alias("output"))
    return pages.select("page", G.band_score(F.col("source"), F.col("output"), 12.0).alias("score"))


_ROWS = "SELECT p_partkey AS id, p_name, p_brand, CASE WHEN p_partkey % 3 = 0 THEN '[\"' || p_brand || '\", \"b\"]' WHEN p_partkey % 3 = 1 THEN '[]' END AS choices_json, CASE WHEN p_partkey % 2 = 0 THEN '[\"img/a b' || p_size || '.png\", \"../x.png\"]' END AS image_paths_json, CASE p_partkey % 4 WHEN 0 THEN '{\"w\": 3}' WHEN 1 THEN '{}' WHEN 2 THEN 'broken' END AS layout_json FROM part"


@query("PRJ_1_api_items", f"SELECT id, coalesce(from_json(choices_json, '[\"VARCHAR\"]'), []) AS choices, CASE WHEN image_paths_json IS NULL THEN [] ELSE ['/files/' || replace(replace(from_json(image_paths_json, '[\"VARCHAR\"]')[1], ' ', '%20'), '+', '%2B')] END AS image_urls, CASE WHEN id % 4 = 0 THEN layout_json END AS layout, CAST(CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS formulas FROM ({_ROWS})")
def api_items(spark, d):
    rows = spark.sql(_ROWS.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {t}"), t=table(spark, d, "part"))
    stem = F.when(F.col("id") % 5 == 0, F.concat(F.lit("값 x² 는 "), F.regexp_replace("p_name", "[^A-Za-z ]", ""))).otherwise(F.regexp_replace("p_name", "[^A-Za-z ]", ""))
    out = bank.api_items(rows.withColumn("stem", stem).withColumns({"tables_json": F.lit("[]"), "content_hash": F.lit("v2:")}))
    return out.select("id", "choices", "image_urls", "layout", F.col("math_summary.symbolic").alias("formulas"))


@query("DED_1_item_identity", "SELECT doc_id AS id, 'v2:' || sha1(trim(regexp_replace(coalesce(text, '') || chr(10) || lang || chr(10) || 'b' || chr(10) || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '[[[\"' || source || '\", \"x\"], [\"\"]]]' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN chr(10) || sha1(source) ELSE '' END, '" + WS + "+', ' ', 'g'))) AS content_hash FROM documents")
def item_identity(spark, d):
    tables = F.when(F.col("doc_id") % 2 == 0, F.array(F.array(F.array(F.col("source"), F.lit("x")), F.array(F.lit("")))))
    images = F.when(F.col("doc_id") % 3 == 0, F.array(F.sha1("source")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), bank.item_identity(F.col("text"), F.array(F.col("lang"), F.lit("b")), F.col("source"), tables, images).alias("content_hash"))


@query("FLT_14_visible_files", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 OR lower(regexp_extract(lang || '.' || CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'docx' WHEN 2 THEN 'json' ELSE 'png' END, '[^.]*$')) IN ('hwpx', 'docx', 'hwp', 'pdf')")
def visible_files(spark, d):
    from ..sources.files import visible

    kind = F.element_at(F.array(*map(F.lit, ("PDF", "docx", "json", "png"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat("source", F.lit("/"))), "lang", F.lit("."), kind)
    return visible(table(spark, d, "documents").select(F.col("doc_id").alias("id"), path.alias("name"))).select("id")
