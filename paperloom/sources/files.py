"""Importers: CSV, SQLite, text, DOCX, HWPX and web pages, each a function from bytes to item rows.

Spark reads the files (``binaryFile``: any store, one row a file); a bad or too large file becomes a row with a
reason, not a failed job; a file of zero bytes, which Spark doesn't list, gives no row.
"""

from __future__ import annotations

import csv
import io
import itertools
import os
import re
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exam_text import chunked, clean, split_answer, split_choices

MOST_BYTES, MOST_ENTRIES, MOST_EXPANDED = 64 << 20, 5000, 256 << 20
ITEM = "path string, pos int, source_name string, number string, subject string, unit string, tags string, title string, stem string, choices array<string>, answer string, explanation string, images array<string>, tables array<array<array<string>>>, reason string"
#: Header names of the fields, in two languages.
ALIASES = {
    "number": ["number", "num", "no", "문항", "문항번호", "번호"],
    "subject": ["subject", "과목"],
    "unit": ["unit", "chapter", "단원", "소단원"],
    "tags": ["tags", "tag", "태그"],
    "title": ["title", "제목"],
    "stem": ["stem", "question", "body", "content", "본문", "문제", "문항본문"],
    "answer": ["answer", "정답"],
    "explanation": ["explanation", "solution", "해설", "풀이"],
}
CHOICE_NAMES, CHOICE_LISTS = ("choice", "option", "선지", "보기"), ("choices", "options", "선지", "보기")


def decoded(data: bytes) -> str:
    for name in ("utf-8-sig", "cp949", "euc-kr"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def reader(header: list[str]) -> Callable[[list], dict | None]:
    """What makes items of the rows below this header: where each field may stand is looked up once.

    A row without stem and title is none; without choice columns the stem is cut into answer, explanation and choices.
    """
    at = {name.strip().lower(): k for k, name in enumerate(header) if name is not None}
    places = {field: [at[a] for a in names if a in at] for field, names in ALIASES.items()}
    numbered = [[at[f"{name}{n}"] for name in CHOICE_NAMES if f"{name}{n}" in at] for n in range(1, 10)]
    listed = [at[name] for name in CHOICE_LISTS if name in at]

    def item(row: list) -> dict | None:
        cells = ["" if c is None else str(c).strip() for c in row] + [""] * (len(header) - len(row))
        given = [c is not None for c in row] + [False] * (len(header) - len(row))
        out = {field: next((cells[k] for k in some if given[k]), "") for field, some in places.items()}
        if not (out["stem"] or out["title"]):
            return None
        found = [next((cells[k] for k in some if cells[k]), "") for some in numbered]
        apart = re.split(r"[|;\n]", next((cells[k] for k in listed if cells[k]), ""))
        out["choices"] = list(filter(None, found)) or [c.strip() for c in apart if c.strip()]
        if not out["choices"]:
            body, answer, explanation = split_answer(out["stem"])
            out["stem"], out["choices"] = split_choices(body)
            out |= {"answer": out["answer"] or answer, "explanation": out["explanation"] or explanation}
        short = out["stem"][:40]
        return out | {"title": out["title"] or short + "..." * (len(out["stem"]) > len(short))}

    return item


def from_csv(data: bytes) -> list[dict]:
    text = decoded(data)
    dialect: type[csv.Dialect] | csv.Dialect = csv.excel
    if any(sign in text[:2048] for sign in ",\t"):
        try:
            dialect = csv.Sniffer().sniff(text[:2048], ",\t;|")
        except csv.Error:
            dialect = csv.excel
    rows = csv.reader(io.StringIO(text), dialect=dialect)
    item = reader(next(rows, []))
    return [i for row in rows if row and (i := item(row))]


def from_sqlite(data: bytes, most: int | None = None) -> list[dict]:
    """Rows (all, or the first ``most`` of each) of every user table that has a stem or a title; the file lies in a
    temporary place of the task while it is read."""
    out = []
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "bank.db")
        with open(path, "wb") as f:
            f.write(data)
        bank = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        try:
            tables = bank.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")
            for (name,) in tables.fetchall():
                rows = bank.execute('SELECT * FROM "' + name.replace('"', '""') + '"')
                header = [c[0] for c in rows.description]
                if {h.strip().lower() for h in header} & {*ALIASES["stem"], *ALIASES["title"]}:
                    item = reader(header)
                    out += [i | {"table": name} for r in itertools.islice(rows, most) if (i := item(list(r)))]
        finally:
            bank.close()
    return out


def from_text(data: bytes) -> list[dict]:
    parts = [p for p in re.split(r"\n(?=\s*(?:문제\s*)?\d{1,3}\s*[.)])|\n\s*\n", clean(decoded(data))) if p.strip()]
    return chunked([{"text": p.strip()} for p in parts])[0]


def _archive(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if len(z.infolist()) > MOST_ENTRIES or sum(i.file_size for i in z.infolist()) > MOST_EXPANDED:
        raise ValueError("archive_too_large")
    return z


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _docx_text(p: ElementTree.Element) -> str:
    out = ""
    for e in p.iter():
        name = _local(e)
        out += (e.text or "") if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else ""
    return out


def from_docx(data: bytes) -> list[dict]:
    """Paragraphs, tables and pictures of a document's body, in its order."""
    z = _archive(data)
    names = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))} if "word/_rels/document.xml.rels" in z.namelist() else {}
    body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _local(e) == "body")
    blocks = []
    for e in body:
        if _local(e) == "p":
            images = [names.get(v, v) for x in e.iter() if _local(x) == "blip" for k, v in x.attrib.items() if k.endswith("}embed")]
            blocks.append({"text": _docx_text(e), "images": images})
        elif _local(e) == "tbl":
            rows = [["\n".join(_docx_text(p) for p in c.iter() if _local(p) == "p") for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            blocks.append({"text": "", "tables": [rows]})
    return chunked([b for b in blocks if b["text"].strip() or b.get("images") or b.get("tables")])[0]


def hwpx_grid(table: ElementTree.Element) -> list[list[str]]:
    """Cells at their addresses, spans filled; where addresses clash, the rows as they stand."""
    rows = [[c for c in r if _local(c) == "tc"] for r in table if _local(r) == "tr"]
    said = lambda c: "".join(x.text or "" for x in c.iter() if _local(x) == "t").strip()
    grid: dict[tuple[int, int], str] = {}
    for row in rows:
        for c in row:
            at, span = ({k: int(v) for k, v in e.attrib.items() if v.lstrip("-").isdigit()} if (e := next((x for x in c if _local(x) == name), None)) is not None else {} for name in ("cellAddr", "cellSpan"))
            if "rowAddr" not in at or "colAddr" not in at:
                return [[said(c) for c in r] for r in rows]
            for i in range(max(1, span.get("rowSpan", 1))):
                for j in range(max(1, span.get("colSpan", 1))):
                    place = at["rowAddr"] + i, at["colAddr"] + j
                    if place in grid or len(grid) > 20000:
                        return [[said(c) for c in r] for r in rows]
                    grid[place] = said(c) if i == j == 0 else ""
    height, width = (max((p[k] for p in grid), default=-1) + 1 for k in (0, 1))
    return [[grid.get((i, j), "") for j in range(width)] for i in range(height)]


def from_hwpx(data: bytes) -> list[dict]:
    """Paragraphs, tables and pictures of all sections, in the order of their numbers."""
    z = _archive(data)
    sections = sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))
    blocks = []
    for name in sections:
        for p in ElementTree.fromstring(z.read(name)):
            if _local(p) != "p":
                continue
            tables = [t for t in p.iter() if _local(t) == "tbl"]
            inside = {id(x) for t in tables for x in t.iter()}
            text = "".join(x.text or "" for x in p.iter() if _local(x) == "t" and id(x) not in inside)
            images = [v for x in p.iter() if _local(x) == "img" for k, v in x.attrib.items() if k.endswith("binaryItemIDRef")]
            if text.strip() or tables or images:
                blocks.append({"text": text, "images": images, "tables": [hwpx_grid(t) for t in tables]})
    return chunked(blocks)[0]


class _Page(HTMLParser):
    """Block texts and image addresses of a page, apart from what only frames it."""

    SKIP = frozenset("script style nav header footer aside form iframe svg noscript".split())
    BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote pre div section article main figcaption dt dd tr ul ol table br".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipped, self.inside, self.blocks, self.images = [], [], [["", False]], []

    def handle_starttag(self, tag, attrs):
        if self.skipped or tag in self.SKIP:
            self.skipped += [tag] if tag in self.SKIP else []
            return
        if tag in ("article", "main"):
            self.inside.append(tag)
        if tag == "img" and (src := dict(attrs).get("src")):
            self.images.append((src, bool(self.inside)))
        if tag in self.BLOCK:
            self.blocks.append(["", bool(self.inside)])

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
            return
        if tag in self.BLOCK:
            self.blocks.append(["", bool(self.inside)])
        if self.inside and tag == self.inside[-1]:
            self.inside.pop()

    def handle_data(self, data):
        if not self.skipped:
            self.blocks[-1][0] += data


def page_paragraphs(html: str, most_images: int = 12) -> tuple[list[str], list[str]]:
    """Texts and images of a page: of its article where that has more than 200 characters, without adjacent repeats."""
    page = _Page()
    page.feed(html or "")
    page.close()
    texts = [(re.sub(r"\s+", " ", t).strip(), own) for t, own in page.blocks]
    own = [t for t, o in texts if o and t]
    article = sum(map(len, own)) > 200
    some = own if article else [t for t, _ in texts if t]
    images = list(dict.fromkeys(s for s, o in page.images if o or not article))
    return [t for i, t in enumerate(some) if i == 0 or t != some[i - 1]], images[:most_images]


def from_html(data: bytes) -> list[dict]:
    texts, images = page_paragraphs(decoded(data))
    out = chunked([{"text": t} for t in texts])[0]
    return [i | {"images": images if n == 0 else []} for n, i in enumerate(out)]


KINDS: dict[str, Callable[[bytes], list[dict]]] = {"csv": from_csv, "sqlite": from_sqlite, "text": from_text, "docx": from_docx, "hwpx": from_hwpx, "html": from_html}
MAGIC = {"sqlite": b"SQLite format 3\0", "docx": b"PK", "hwpx": b"PK"}
_FIELDS = ["number", "subject", "unit", "tags", "title", "stem", "choices", "answer", "explanation", "images", "tables"]
_LISTS = {"choices", "images", "tables"}


def _rows(kind: str, path: str, data: bytes, size: int) -> list[tuple]:
    name = unquote(path.rpartition("/")[2])
    bad = lambda why: [(path, 0, name, *[[] if f in _LISTS else "" for f in _FIELDS], why)]
    if size > MOST_BYTES:
        return bad("file_too_large")
    if not data:
        return bad("empty_file")
    if not data.startswith(MAGIC.get(kind, b"")):
        return bad("wrong_kind")
    try:
        items = KINDS[kind](data)
    except Exception as e:  # a file that can't be read is a result, whatever is wrong with it
        return bad(f"unreadable: {type(e).__name__}")
    if not items:
        return bad("no_items")
    return [(path, i, f"{name}:{x['table']}" if "table" in x else name, *[x.get(f) or ([] if f in _LISTS else "") for f in _FIELDS], None) for i, x in enumerate(items)]


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Items of all files at a path (pos is their order in a file); ``reason`` tells why a file gave none."""
    if kind not in KINDS:
        raise ValueError(f"no importer for {kind}; there are {', '.join(KINDS)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.select("path", "length", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEM.split(", ")]
        for batch in batches:
            rows = [r for p, n, c in zip(batch["path"], batch["length"], batch["content"], strict=True) for r in _rows(kind, p, bytes(c) if c is not None else b"", n)]
            yield pd.DataFrame(rows, columns=names)

    return small.mapInPandas(parse, ITEM)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, paragraphs and images of web pages that a table holds."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [page_paragraphs(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "paragraphs": [f[0] for f in found], "images": [f[1] for f in found]})

    return pages.select("page_id", "url", "html").mapInPandas(parse, "page_id long, url string, paragraphs array<string>, images array<string>")


def exports(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".hwpx", ".docx", ".json", ".png")) -> DataFrame:
    """Files of an export folder, newest first, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.lower("path").endswith(s)
    return files.where(ok).orderBy(F.desc("modificationTime"), "path")


def visible(files: DataFrame) -> DataFrame:
    """Files (name: the path below the export folder) that a list shows: all of the folder itself, only documents of folders in it."""
    nested = F.contains("name", F.lit("/"))
    return files.where(~nested | F.lower(F.substring_index("name", ".", -1)).isin("hwpx", "docx", "hwp", "pdf"))


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines of a report at a path of any store: written aside, then moved to where readers look, so they never meet half of it."""
    spark = rows.sparkSession
    jvm, aside = spark._jvm.org.apache.hadoop.fs, f"{path}.{uuid.uuid4().hex}.part"
    rows.write.json(aside)
    new, old = jvm.Path(aside), jvm.Path(path)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    former = jvm.Path(f"{aside}.old")
    had = fs.exists(old) and fs.rename(old, former)
    if not fs.rename(new, old):
        if had:
            fs.rename(former, old)
        raise OSError(f"{aside} can't be moved to {path}")
    if had:
        fs.delete(former, True)


def seconds(at: Column) -> Column:
    """A time to the second."""
    return F.date_trunc("second", at)


def stamp(at: Column) -> Column:
    """A time as it stands in names of files."""
    return F.date_format(seconds(at), "yyyyMMdd_HHmmss")


def now() -> Column:
    return seconds(F.current_timestamp())
