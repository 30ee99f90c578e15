"""The item bank: search and pages, lookups in order, content identity, inserts, updates and deletes as plans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.choices import let
from ..functions.text import WS, ascii_fold, casefolded, collapsed, like, text, with_line_feeds
from ..session import staged

SEARCHED = ("title", "stem", "source_name", "number", "answer")


def matching(items: DataFrame, q: str = "", source_type: str = "", subject: str = "", tag: str = "") -> DataFrame:
    """Items that hold q in a searched field, and fit the other filters; an empty parameter filters nothing."""
    conditions: list[Column] = []
    if q:
        fields = [like(text(c), q) for c in SEARCHED if c in items.columns]
        conditions.append(reduce(lambda a, b: a | b, fields, F.lit(False)))
    if source_type:
        conditions.append(F.col("source_type") == source_type)
    if subject:
        conditions.append(like(text("subject"), subject))
    if tag:
        conditions.append(like(text("tags"), tag))
    return reduce(lambda df, c: df.where(c), conditions, items)


def page(items: DataFrame, limit: int = 100, offset: int = 0, most: int = 300) -> DataFrame:
    """The newest first, one page of them; a page has at most ``most`` rows."""
    return items.orderBy(F.col("id").desc()).offset(max(0, offset)).limit(max(1, min(limit, most)))


def page_info(items: DataFrame, limit: int = 100, offset: int = 0, most: int = 300) -> DataFrame:
    """total, rows on the page and whether more follow."""
    shown = F.greatest(F.lit(0), F.least(F.lit(min(limit, most)), F.col("total") - offset))
    return items.agg(F.count(F.lit(1)).alias("total")).select("total", shown.cast("long").alias("rows"), (F.lit(offset) + shown < F.col("total")).alias("has_more"))


def in_order(items: DataFrame, selection: DataFrame) -> DataFrame:
    """Items of a selection (pos, id), with their position; sort by pos to show them."""
    return selection.join(items, "id")


def missing(items: DataFrame, selection: DataFrame) -> DataFrame:
    return selection.join(items.select("id"), "id", "left_anti")


def repeated(selection: DataFrame) -> DataFrame:
    return selection.groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def _whole(fields: Iterable[Column]) -> Column:
    return collapsed(F.concat_ws("\n", *[text(f) for f in fields]))


def _current(whole: Column) -> Column:
    return F.when(whole == "", F.lit("")).otherwise(F.concat(F.lit("v2:"), F.sha1(whole)))


def _former(whole: Column) -> Column:
    return F.when(whole == "", F.lit("")).otherwise(F.sha1(F.lower(whole)))


def identity(*fields: Column) -> Column:
    """Content identity: SHA-1 over the fields joined by newlines, white space collapsed, case kept; empty content has none."""
    return _current(_whole(fields))


def tables_json(tables: Column) -> Column:
    """Tables (rows of cells) as JSON text with a blank after each comma; no table gives the empty text."""
    listed = lambda c, inner: F.concat(F.lit("["), F.array_join(F.transform(c, inner), ", "), F.lit("]"))
    cell = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, listed(tables, lambda t: listed(t, lambda r: listed(r, cell)))).otherwise("")


def item_content(stem: Column, choices: Column, answer: Column, tables: Column, image_hashes: Column) -> Column:
    """What an item is: stem, choices, answer, tables and the hashes of its pictures, in that order, as one text."""
    none = F.array().cast("array<string>")
    nonempty = F.filter(F.array(tables_json(tables)), lambda t: t != "")
    parts = F.concat(F.array(text(stem)), F.coalesce(choices, none), F.array(text(answer)), nonempty, F.coalesce(image_hashes, none))
    return F.array_join(parts, "\n")


def item_identity(stem: Column, choices: Column, answer: Column, tables: Column, image_hashes: Column) -> Column:
    """Identity of a whole item."""
    return identity(item_content(stem, choices, answer, tables, image_hashes))


def api_items(rows: DataFrame) -> DataFrame:
    """Stored rows as a reader gets them: JSON columns parsed, pictures with their addresses, formulas of the stem with a
    summary, no content hash. Unreadable or empty layouts are null."""
    from ..functions.exam_text import spans

    strings, nested = "array<string>", "array<array<array<string>>>"
    paths = safe_image_paths(F.coalesce(F.from_json("image_paths_json", strings), F.array().cast(strings)))
    layout = F.when(F.size(F.from_json("layout_json", "map<string,string>")) > 0, F.col("layout_json"))
    out = rows.withColumns({
        "choices": F.coalesce(F.from_json("choices_json", strings), F.array().cast(strings)), "tables": F.coalesce(F.from_json("tables_json", nested), F.array().cast(nested)),
        "image_paths": paths, "layout": layout, "math_spans": spans(text("stem")),
    }).drop("choices_json", "tables_json", "image_paths_json", "layout_json", "content_hash")
    address = lambda p: F.concat(F.lit("/files/"), quoted(p))
    count = lambda kind: F.size(F.filter("math_spans", lambda s: s["kind"] == kind)).cast("long")
    return out.withColumns({"image_urls": F.transform("image_paths", address), "math_summary": F.struct(F.size("math_spans").cast("long").alias("n"), count("latex").alias("latex"), count("symbolic").alias("symbolic"))})


def quoted(path: Column) -> Column:
    """Percent-encoded; letters, digits, ``_.-~`` and ``/`` stay as they are."""
    out = F.url_encode(path)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def legacy_identity(*fields: Column) -> Column:
    """The former identity, which folded case and had no prefix; it only shortlists."""
    return _former(_whole(fields))


def _hashed(rows: DataFrame, content: Column, *more: str) -> DataFrame:
    """id, source_name, hash and legacy hash of each row, and its further columns ``more``; texts go no further."""
    plain = rows.select("id", "source_name", *more, _whole([content]).alias("_content"))
    return plain.select("id", "source_name", *more, _current(F.col("_content")).alias("hash"), _former(F.col("_content")).alias("legacy"))


def import_states(incoming: DataFrame, bank: DataFrame, content: Column | None = None) -> DataFrame:
    """id, duplicate_of and state of each incoming row; ``content`` tells what a row is (its stem, or ``item_content``).

    duplicate_of is the least bank id with its source name and content: a bank row's stored hash, new or legacy,
    shortlists, the stored content decides. States are ``existing`` (the bank has it under this source), ``skipped`` (an
    inserted row of this run has its content) and ``created``; a row that the bank rejects doesn't block a later row of
    another source; rows without content are always created. Each content is hashed once, and only hashes are exchanged.
    """
    content = F.col("stem") if content is None else content
    new = _hashed(incoming, content)
    old = _hashed(bank, content, "content_hash").select(F.col("id").alias("_id"), F.col("source_name").alias("_source"), F.col("content_hash").alias("_stored"), F.col("hash").alias("_now"), F.col("legacy").alias("_former"))
    old = old.where((F.col("_stored") == F.col("_now")) | (F.col("_stored") == F.col("_former"))).groupBy("_source", "_now").agg(F.min("_id").alias("duplicate_of")).where("_now <> ''")
    marked = new.join(old, (F.col("hash") == F.col("_now")) & (F.col("source_name") == F.col("_source")), "left")
    key = F.when(F.col("hash") == "", F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(F.col("hash"))
    turn = F.row_number().over(W.partitionBy(key, F.col("duplicate_of").isNull()).orderBy("id"))
    state = F.when(F.col("duplicate_of").isNotNull(), "existing").when((turn > 1) & (F.col("hash") != ""), "skipped").otherwise("created")
    return marked.select("id", "duplicate_of", state.alias("state"))


def duplicate_of(incoming: DataFrame, bank: DataFrame, content: Column | None = None) -> DataFrame:
    """The incoming rows with the least bank id that has their source name and content, if any."""
    return incoming.join(import_states(incoming, bank, content).drop("state"), "id")


def import_unique(incoming: DataFrame, bank: DataFrame, content: Column | None = None) -> DataFrame:
    """The incoming rows with duplicate_of and state."""
    return incoming.join(import_states(incoming, bank, content), "id")


def ordered_ids(selection: DataFrame) -> DataFrame:
    """Ids in the order in which they came up first."""
    return selection.groupBy("id").agg(F.min("pos").alias("pos")).orderBy("pos")


def updated(bank: DataFrame, changes: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Rows with the fields that a change carries (null: not given); other rows as they are."""
    given = changes.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    out = bank.join(given, "id", "left").withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields})
    return out.select(*bank.columns)


def deleted(bank: DataFrame, ids: DataFrame) -> DataFrame:
    return bank.join(ids.select("id"), "id", "left_anti")


def appended(bank: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with new ids after the largest one, in the order of their pos: ranges of pos are numbered on their own, and each
    begins after the rows of those before it. Only a row a range meets in one place."""
    top = bank.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    spread = staged(rows.repartitionByRange("pos").withColumn("_part", F.spark_partition_id()), "import")
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = spread.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy("pos")))
    numbered = placed.join(F.broadcast(offsets), "_part").join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_before") + F.col("_n"))
    return bank.unionByName(numbered.select(*bank.columns))


def upserted_counts(counters: DataFrame, events: DataFrame) -> DataFrame:
    """Counters (key, n) with one more for each event of the key; new keys start at their events."""
    return counters.select("key", "n").unionByName(events.select("key", F.lit(1).cast("long").alias("n"))).groupBy("key").agg(F.sum("n").alias("n"))


def aliased_fields(rows: DataFrame, aliases: Mapping[str, Iterable[str]]) -> DataFrame:
    """Canonical fields from a header in any case: of each field's aliases the first that the header has, stripped, null as ''."""
    header = {c.strip().lower(): c for c in reversed(rows.columns)}
    out = []
    for field, names in aliases.items():
        there = [F.col(f"`{header[a.lower()]}`").cast("string") for a in names if a.lower() in header]
        out.append(F.trim(F.regexp_replace(F.coalesce(*there, F.lit("")), f"^{WS}+|{WS}+$", "")).alias(field) if there else F.lit("").alias(field))
    return rows.select(*out)


def titled(title: Column, stem: Column, width: int = 40) -> Column:
    """A title, or the stem's first characters."""
    short = F.when(F.length(stem) > width, F.concat(F.substring(stem, 1, width), F.lit("..."))).otherwise(stem)
    return F.when(text(title) != "", title).otherwise(short)


def choices_split(whole: Column) -> Column:
    """Choices in one text, between bars, semicolons or line ends; empty ones fall away."""
    parts = F.split(text(whole), rf"{WS}*[|;\n]{WS}*")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", "")), lambda x: x != "")


def choice_key(choice: Column) -> Column:
    """What makes two choices the same: no label, no white space, no case."""
    body = F.regexp_replace(choice, rf"^{WS}*(?:[①②③④⑤⑥⑦⑧⑨]|\(?[1-9][.)])", "")
    return casefolded(F.regexp_replace(body, WS + "+", ""))


def safe_image_paths(paths: Column) -> Column:
    """Relative paths without ``..`` that end like images, each once, in order."""
    ok = lambda p: ~p.rlike(r"^([/\\]|[A-Za-z]:)") & ~p.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ascii_fold(p).rlike(r"\.(png|jpg|jpeg|gif|webp|bmp)$")
    return F.array_distinct(F.filter(paths, ok))


#: What shows a question's score, and the forms of an exam, which differ between its copies.
SCORE = r"\[\s*\d+\s*점\s*\]"
FORMS = r"\(?\s*(?:홀수형|짝수형|미적분|확률과\s*통계|기하)\s*\)?"


def loose_key(number: Column, stem: Column) -> Column:
    """A key that survives drifting choices, pictures and forms: letters and digits up to the score, or of the first six lines,
    without the question's number and the names of forms; 24 of them at least, else it is empty."""
    whole = text(stem)
    scored = F.when(F.contains(whole, F.lit("점")), F.regexp_extract(whole, rf"(?s)^(.*?{SCORE})", 1)).otherwise("")
    head = let(scored, lambda x: F.when(x != "", x).otherwise(F.substring_index(with_line_feeds(whole), "\n", 6)))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"^\s*\d{1,3}\s*[.)]\s*", ""), FORMS, ""), r"[^0-9A-Za-z가-힣α-ωΑ-Ω]+", "")
    return let(bare, lambda x: F.when(F.length(x) < 24, "").otherwise(F.concat(F.trim(text(number)), F.lit(":"), F.substring(x, 1, 180))))


#: Characters that names keep, ASCII ones each by itself, which Java looks up in one table.
NAMES = r"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._\-가-힣"
#: Head of a text that is tried for a name, in lengths of the name.
HEAD = 3


def _telling(whole: Column, most: int) -> Column:
    """A text's head where it surely tells the first ``most`` characters of the text's name, else the whole text.

    A head ends before an ASCII character, which composes with none before it: composed, the head still begins the composed
    text, and its name begins the text's name, as a run that goes on stays one line. A run of others can compose with the one
    character before it, so a head's name has at least as many characters as the head keeps, less its runs.
    """
    head = F.regexp_extract(F.substring(whole, 1, HEAD * most), r"(?s)^(.*)[\x00-\x7F]", 1)
    runs = F.regexp_replace(head, f"[^{NAMES}]+", "\n")
    sure = let(runs, lambda r: 2 * F.length(F.replace(r, F.lit("\n"), F.lit(""))) - F.length(r))
    return F.when(sure >= most, head).otherwise(whole)


def safe_name(name: Column, most: int = 80) -> Column:
    """A file name of ASCII letters, digits, Hangul, dots, lines and dashes, composed first; runs of others become one line."""
    return F.substring(F.regexp_replace(composed(_telling(text(name), most)), f"[^{NAMES}]+", "_"), 1, most)


def upload_name(path: Column, most: int = 120) -> Column:
    """The name of an uploaded file, which may have blanks; ``upload`` if it has none."""
    name = composed(_telling(F.trim(F.substring_index(F.replace(text(path), F.lit("\\"), F.lit("/")), "/", -1)), most))
    return F.substring(F.regexp_replace(F.when(name == "", "upload").otherwise(name), f"[^{NAMES} ]+", "_"), 1, most)


@F.arrow_udf(StringType())
def composed(texts: pa.Array) -> pa.Array:
    """Texts with letters and their marks as one character where there is one (NFC)."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def normal_tables(tables: Column) -> Column:
    """Tables of stripped cells; missing tables, rows and cells are empty, and tables without rows fall away."""
    cell = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"^{WS}+|{WS}+$", "")
    row = lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), cell)
    table = lambda t: F.transform(F.coalesce(t, F.array().cast("array<array<string>>")), row)
    return F.filter(F.transform(tables, table), lambda t: F.size(t) > 0)


def identifiers(value: Column) -> Column:
    """Literal identifiers in a text: letters, then digits, then dashed numbers."""
    return F.regexp_extract_all(text(value), F.lit(r"([A-Za-z]+[0-9]+(?:-[0-9]+)*)"))
