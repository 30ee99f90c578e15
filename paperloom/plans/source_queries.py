"""Source and text-rule queries: what Arrow and pandas functions say, which the tests hold against fixtures."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import exam_text as T
from ..functions.text import CIRCLED
from ..operators import geometry as G
from ..operators import segment as S
from ..registry import query, table
from ..sources import read_pages
from .segment_queries import _SQL_PARTS, boxes


@query("SRC_12_pages")
def pages(spark, d):
    return read_pages(table(spark, d, "pages"))


@query("STR_17_semantic_texts", r"SELECT conv_id, turn, regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\s\x{A0}\p{P}]', '', 'g') AS text FROM conversations")
def semantic(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.semantic_text("text").alias("text"))


@query("STR_4_math_spans")
def spans(spark, d):
    text = F.concat(F.lit("x² + 1 = 2, 2026-07-07: "), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.spans(text).alias("spans"))


@query("AGG_10_math_summary")
def math_summary(spark, d):
    s = spans(spark, d).select("conv_id", F.explode("spans").alias("s"))
    return s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("s.kind")).alias("kinds"), F.bool_or(F.col("s.kind") == "latex").alias("any_latex"), F.bool_or(F.col("s.kind") == "symbolic").alias("any_symbolic"))


#: Scripts over a part's size, and the LaTeX that each must become; a part takes the one of its key.
SCRIPTS = (
    ("root {@} of {x+1} over 2", r"\frac{\sqrt[@]{x+1}}{2}"),
    ("{n} choose {@}", r"\binom{n}{@}"),
    ("{ matrix {a & @ # c & d} }", r"\begin{matrix}a&@\\c&d\end{matrix}"),
    ("{cases{@``x & LEFT ( x GEQ 0 RIGHT )#-x & x<0}}", r"\begin{cases}@x&\left(x\geq0\right)\\-x&x<0\end{cases}"),
    ("UNDERBRACE {a+b} {@} != { vec {AB} }", r"\underbrace{a+b}_{@}\neq\overrightarrow{AB}"),
    ('lim _{x->@} {sin x} over {x} "over"', r"\lim_{x\rightarrow@}\frac{\sin x}{x}\text{over}"),
    ("sum_{k=1}^{@} it k^2 TIMES OMEGA", r"\sum_{k=1}^{@}k^{2}\times\Omega"),
)


@query("STR_8_latex", "SELECT p_partkey AS id, replace(CASE " + " ".join(f"WHEN p_partkey % {len(SCRIPTS)} = {i} THEN '{latex}'" for i, (_, latex) in enumerate(SCRIPTS)) + " END, '@', CAST(p_size AS VARCHAR)) AS latex FROM part")
def latex(spark, d):
    form = F.element_at(F.array(*[F.lit(script) for script, _ in SCRIPTS]), (F.col("p_partkey") % len(SCRIPTS) + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.latex(F.replace(form, F.lit("@"), F.col("p_size").cast("string"))).alias("latex"))


@query("GEO_2_merged_boxes", f"WITH RECURSIVE m AS (SELECT page, list({{'a': l, 'b': t, 'c': l + w, 'd': t + h}} ORDER BY id) AS g, CAST(1 AS BIGINT) AS i, CAST(2 AS BIGINT) AS j, CAST(count(*) AS BIGINT) AS before, false AS done FROM ({_SQL_PARTS}) GROUP BY page UNION ALL SELECT page, CASE WHEN hit THEN list_concat(list_transform(g[1:j - 1], lambda x, k: CASE WHEN k = i THEN u ELSE x END), g[j + 1:]) ELSE g END, CASE WHEN i > len(g) THEN 1 WHEN j > len(g) THEN i + 1 ELSE i END, CASE WHEN i > len(g) THEN 2 WHEN j > len(g) THEN i + 2 WHEN hit THEN j ELSE j + 1 END, CASE WHEN i > len(g) THEN len(g) ELSE before END, i > len(g) AND len(g) = before FROM (SELECT *, coalesce(j <= len(g) AND g[i].a <= g[j].c + 8 AND g[j].a <= g[i].c + 8 AND g[i].b <= g[j].d + 8 AND g[j].b <= g[i].d + 8, false) AS hit, {{'a': least(g[i].a, g[j].a), 'b': least(g[i].b, g[j].b), 'c': greatest(g[i].c, g[j].c), 'd': greatest(g[i].d, g[j].d)}} AS u FROM m WHERE NOT done)) SELECT page, x.a AS \"left\", x.b AS top, x.c AS \"right\", x.d AS bottom FROM (SELECT page, unnest(g) AS x FROM m WHERE done)")
def merged(spark, d):
    b = boxes(spark, d).select("page", F.col("id").alias("ord"), F.col("box.left").alias("left"), F.col("box.top").alias("top"), S.right(F.col("box")).alias("right"), S.bottom(F.col("box")).alias("bottom"))
    return G.merge_page_boxes(b, ["page"], gap=8.0)



@query("PRJ_6_subjects", "SELECT doc_id AS id, CASE WHEN lower(source || '.pdf') LIKE '%1%' THEN '수학' WHEN lower(source) LIKE '%src%' THEN '국어' ELSE '' END AS subject FROM documents")
def subjects(spark, d):
    from ..functions.exam_columns import first_keyword

    rules = [("수학", ["1", "수학"]), ("국어", ["src", "국어"])]
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), first_keyword(F.concat("source", F.lit(".pdf")), rules).alias("subject"))


@query("PRJ_7_mastheads", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) || '학년도 대학수학능력시험 ' || month(o_orderdate) || '월 모의평가 문제지' WHEN o_orderkey % 3 = 1 THEN CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) || '학년도 ' || month(o_orderdate) || '월 고2 전국연합학력평가 문제지' ELSE '' END ELSE '' END AS masthead FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 20 YEARS ELSE o_orderdate END AS o_orderdate FROM orders)")
def mastheads(spark, d):
    from ..functions.exam_columns import exam_header, masthead

    o = table(spark, d, "orders")
    late = F.col("o_orderdate") + F.expr("INTERVAL 20 YEARS")
    y, m = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.year(late).cast("string"), F.lit("학년도_"), F.month(late).cast("string"), F.lit("월 모의평가"))).when(F.col("o_orderkey") % 3 == 1, F.concat(y, F.lit("년 "), m, F.lit(" 월 고 2  학력평가"))).otherwise(F.lit("기말 시험"))
    return o.select(F.col("o_orderkey").alias("id"), masthead(exam_header(raw)).alias("masthead"))


#: Texts that begin with a range, and some that don't, around a part's size.
_RANGED = "CASE p_partkey % 7 WHEN 0 THEN concat('[', p_size, '~', p_size - 1, '] x') WHEN 1 THEN concat(' [', p_size, ' ∼ ', p_size + 2, '] 다음 글을') WHEN 2 THEN concat('[ ', p_size, '-', p_size, ' ]') WHEN 3 THEN concat(p_name, ' [1~2]') WHEN 4 THEN concat('[', p_size, '–', p_size * 40, ']') WHEN 5 THEN concat('[', p_size, '～99]') ELSE concat('(', p_size, '~50)') END"


@query("STR_21_ranges", rf"WITH t AS (SELECT p_partkey, string_split(regexp_replace(trim({_RANGED}), '[∼～–-]', '~', 'g'), ']')[1] AS x FROM part), n AS (SELECT p_partkey, x, list_transform(string_split(substr(x, 2), '~'), lambda v: trim(v)) AS v FROM t) SELECT p_partkey AS id, CASE WHEN x[1] = '[' AND len(v) = 2 AND regexp_full_match(v[1], '[0-9]{{1,3}}') AND regexp_full_match(v[2], '[0-9]{{1,3}}') AND CAST(v[1] AS INTEGER) <= CAST(v[2] AS INTEGER) THEN [CAST(v[1] AS INTEGER), CAST(v[2] AS INTEGER)] END AS range FROM n")
def ranges(spark, d):
    from ..functions.exam_columns import shared_range

    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), shared_range(F.expr(_RANGED)).alias("range"))


#: Answers of several kinds around an order's key.
_ANSWER = "CASE o_orderkey % 6 WHEN 0 THEN substr('①②③④⑤⑥⑦⑧⑨', CAST(o_orderkey % 9 + 1 AS INT), 3) WHEN 1 THEN concat(o_orderkey % 10, ', 3번') WHEN 2 THEN concat(o_orderkey % 100, ' ', o_orderkey % 4) WHEN 3 THEN concat('③, ', o_orderkey % 5, '/③') WHEN 4 THEN '없음' ELSE concat('정답 ', o_orderkey % 13, '번①') END"


@query("STR_20_answer_numbers", rf"SELECT o_orderkey AS id, list_sort(list_distinct(list_transform(list_filter(string_split_regex(translate({_ANSWER}, '①②③④⑤⑥⑦⑧⑨', '123456789'), '[^0-9]+'), lambda n: length(n) = 1 AND n <> '0'), lambda n: CAST(n AS INTEGER)))) AS numbers FROM orders")
def answer_numbers(spark, d):
    from ..functions.exam_columns import answer_numbers as numbers

    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_sort(numbers(F.expr(_ANSWER))).alias("numbers"))


#: Stems behind their own number, in forms that lose it and forms that keep it.
_PREFIXED = "CASE p_partkey % 9 WHEN 0 THEN concat(p_size, '. ', p_name) WHEN 1 THEN concat('문제 ', p_size, ') ', p_name) WHEN 2 THEN concat(p_size, '.5 + ', p_name) WHEN 3 THEN concat(p_size + 1, '. ', p_name) WHEN 4 THEN concat(p_size, '.+', p_name) WHEN 5 THEN concat('$', p_size, '.5+x$') WHEN 6 THEN concat('(', p_size, ') + ', p_name) WHEN 7 THEN concat('  ', p_size, ' .  ', p_name) ELSE concat(p_size, ')') END"


@query("STR_14_prefixes", rf"WITH t AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n, {_PREFIXED} AS x FROM part), u AS (SELECT *, CASE WHEN starts_with(ltrim(x), '문제') THEN ltrim(substr(ltrim(x), 3)) ELSE ltrim(x) END AS y FROM t), v AS (SELECT *, ltrim(substr(y, length(n) + 1)) AS z FROM u) SELECT p_partkey AS id, CASE WHEN starts_with(y, n) AND z[1] IN ('.', ')') AND (length(z) = 1 OR z[2] = ' ') THEN ltrim(substr(z, 2)) ELSE x END AS stem FROM v")
def prefixes(spark, d):
    from ..operators.compose import without_prefix

    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), without_prefix(F.expr(_PREFIXED), F.col("p_size").cast("string")).alias("stem"))


@query("STR_22_list_numbers", "SELECT p_partkey AS id, CASE WHEN p_size BETWEEN 1 AND 20 THEN chr(9312 + p_size - 1) ELSE CAST(p_size AS VARCHAR) END AS circled, chr(97 + CAST((p_size - 1) % 26 AS INTEGER)) AS latin FROM part")
def list_numbers(spark, d):
    circled = F.when(F.col("p_size").between(1, 20), F.element_at(F.array(*[F.lit(chr(9312 + i)) for i in range(20)]), F.least(F.greatest(F.col("p_size"), F.lit(1)), F.lit(20)))).otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), circled.alias("circled"), F.chr(97 + (F.col("p_size") - 1) % 26).alias("latin"))


#: Texts with an answer, an explanation and, by turn, more of either after them.
_ANSWERED = "text || chr(10) || '답답한 사람은 누구인가?' || chr(10) || '해설자는 말했다. Answers vary.' || chr(10) || 'Answers vary here' || chr(10) || '정답: ③' || chr(10) || '해설: 끝' || chr(10) || CASE turn % 3 WHEN 0 THEN text || chr(10) || '[답] 4' || chr(10) || '남은 말' WHEN 1 THEN '풀이' || chr(10) || text ELSE '정답 및 해설' || chr(10) || '정답률은 낮다' || chr(10) || '답 ②' || chr(10) || '[해설]' || chr(10) || 'x' END"
_B1 = "[ \t\u00a0\u3000]"
_B = f"{_B1}*"
_CLEAN = "trim(regexp_replace(regexp_replace(coalesce({}, ''), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"
_ANSWERS = rf"""
WITH t AS (SELECT conv_id, turn, {_ANSWERED} AS x FROM conversations WHERE text IS NOT NULL),
l AS (SELECT conv_id, turn, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM t),
v AS (SELECT *, regexp_extract(line, '(?i)^{_B}(\[{_B})?(정답|답|answer)({_B}\]{_B}[:：]?|{_B}[:：]|{_B1}+){_B}(\S.*)$', 4) AS told, regexp_matches(line, '(?i)^{_B}(\[{_B})?(해설|풀이|explanation|solution)({_B}\]|{_B}[:：]|{_B1}|$)') AS head,
  regexp_replace(line, '(?i)^{_B}(\[{_B})?(해설|풀이|explanation|solution)({_B}\]{_B}[:：]?|{_B}[:：]|{_B1}+|$){_B}', '') AS rest FROM l),
k AS (SELECT *, CASE WHEN told <> '' AND NOT regexp_matches(told, '^(및{_B})?(해설|풀이){_B}$') THEN 'a' WHEN head THEN 'e' END AS kind FROM v),
m AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS mode FROM k)
SELECT conv_id, turn, {_CLEAN.format("string_agg(line, chr(10) ORDER BY i) FILTER (kind IS NULL AND mode IS DISTINCT FROM 'e')")} AS body, trim(coalesce(arg_max(told, i) FILTER (kind = 'a'), '')) AS answer,
  {_CLEAN.format("string_agg(CASE WHEN kind = 'e' THEN rest ELSE line END, chr(10) ORDER BY i) FILTER (mode = 'e' AND (kind IS NULL OR rest <> ''))")} AS explanation FROM m GROUP BY conv_id, turn
"""


@query("STR_11_answer_lines", _ANSWERS)
def answer_lines(spark, d):
    from ..functions.exam_columns import answer_and_explanation

    parts = answer_and_explanation(F.expr(_ANSWERED.replace("chr(10)", "char(10)")))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", parts.alias("parts")).select("conv_id", "turn", "parts.*")


#: Keys, lists of choices, and numbers that lead to nothing, around a turn's number.
_KEYED = "concat(turn, '. ③ ', turn + 1, '번 정답 ② ', turn, ' ① 가 ', text, ' 보기 ① 10 ② 20 ③ 30 ', char(10), turn + 2, ') ④ 1234 ⑤ ', turn + 3, '.5 ① ', turn + 4, CASE WHEN turn % 2 = 0 THEN ' ❷' ELSE ' 정답: ⑤' END)"


@query("STR_12_answer_pairs", f"WITH t AS (SELECT conv_id, turn, regexp_replace({_KEYED.replace('char(10)', 'chr(10)')}, '([^0-9{T.MARKS}\\s]\\s*)[{T.MARKS}]\\s*[0-9]{{1,3}}(?:\\s+[{T.MARKS}]\\s*[0-9]{{1,3}})+', '\\1|', 'g') AS x FROM conversations WHERE text IS NOT NULL), p AS (SELECT conv_id, turn, regexp_extract_all(x, '(?:^|[^0-9.])([0-9]{{1,3}})\\s*(?:번\\s*)?(?:[.):]\\s*)?(?:정답\\s*[:：]?\\s*)?[{CIRCLED}]', 1) AS n, regexp_extract_all(x, '(?:^|[^0-9.])[0-9]{{1,3}}\\s*(?:번\\s*)?(?:[.):]\\s*)?(?:정답\\s*[:：]?\\s*)?([{CIRCLED}])', 1) AS v FROM t), u AS (SELECT conv_id, turn, unnest(range(1, len(n) + 1)) AS i, n, v FROM p) SELECT conv_id, turn, CAST(CAST(n[i] AS INTEGER) AS VARCHAR) AS number, arg_min(v[i], i) AS value FROM u GROUP BY conv_id, turn, CAST(n[i] AS INTEGER)")
def pairs(spark, d):
    from ..functions.exam_columns import key_pairs

    told = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.explode(key_pairs(F.expr(_KEYED))).alias("p"))
    return told.select("conv_id", "turn", "p.*")


@query("STR_15_numbered_lines")
def numbered_lines(spark, d):
    number = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), F.col("text"))
    numbered = T.arrow(lambda t: T.numbered_lines(t.split("\n")[1:], t.split("\n")[0]), "array<string>")
    return table(spark, d, "conversations").select("conv_id", "turn", numbered(number).alias("lines"))


@query("STR_6_math_pieces")
def math_pieces(spark, d):
    pieces = T.arrow(lambda t: [{"piece": p, "math": m} for p, m in T.split_math(t)], "array<struct<piece:string,math:boolean>>")
    return table(spark, d, "conversations").select("conv_id", "turn", pieces(F.concat(F.lit("가 $x+1$ 나 "), "text")).alias("pieces"))


#: Plain forms of mathematical letters and full-width signs, as Unicode has them.
_FANCY = {c: n for c in map(chr, [*range(0x1D400, 0x1D800), *range(0xFF01, 0xFF5F)]) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n not in ("'", c)}


@query("STR_1_glyphs", f"SELECT conv_id, turn, 'x+1□ ' || translate(regexp_replace(coalesce(text, ''), '[\\x{{E000}}-\\x{{F8FF}}]+', '□', 'g'), '{''.join(_FANCY)}−∕∗\u2009\u00a0', '{''.join(_FANCY.values())}-/*  ') AS text FROM conversations")
def glyphs(spark, d):
    raw = F.concat(F.lit("𝑥＋１\ue001\ue002 "), F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.arrow(T.glyphs, "string")(raw).alias("text"))
