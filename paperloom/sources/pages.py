"""Pages as a source: ``spark.read.format("pages")`` over JSON lines, one page a line, as text extractors write them.

A page is ``{"doc_id", "page", "width", "height", "blocks": [{"lines": [{"spans": [{"text", "font", "size", "bbox",
"chars": [{"c", "bbox"}]}], "bbox"}]}], "drawings": [bbox, ...], "images": [bbox, ...]}`` in points, a bbox being left,
top, right, bottom. Files are planned as byte ranges of at most ``split`` bytes: a range holds the lines that begin in
it. A schema given to the reader prunes what is built of a page, down to the fields of its lines; equality and order
filters on doc_id and page are pushed down and skip pages before they are built.

Options: ``path`` (a file or a folder in any store that Arrow knows), ``dpi`` (of the pixels that boxes are told in, 150)
and ``split`` (64 MB). A line that is no JSON object is a row whose ``reason`` tells so, with the file as its doc_id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BOX = "struct<left:double,top:double,width:double,height:double>"
LINE = f"struct<line_no:int,text:string,box:{BOX},chars:array<struct<c:string,box:{BOX}>>,spans:array<struct<text:string,font:string,size:double,box:{BOX}>>>"
PAGE = f"doc_id string, page int, page_width double, page_height double, lines array<{LINE}>, figures array<{BOX}>, reason string"
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
ROWS = 256  # pages a batch


class Range(InputPartition):
    """The lines of a file that begin from a byte on, before another."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def scaled(bbox: object, scale: float, least: float = 0.0) -> dict | None:
    """A box in pixels, or None for one without an extent; with ``least``, corners in any order and at least so thick."""
    try:
        left, top, right, bottom = (float(x) * scale for x in bbox)
    except (TypeError, ValueError):
        return None
    if least:
        left, right, top, bottom = min(left, right), max(left, right), min(top, bottom), max(top, bottom)
        right, bottom = max(right, left + least) if right <= left else right, max(bottom, top + least) if bottom <= top else bottom
    return {"left": left, "top": top, "width": right - left, "height": bottom - top} if right > left and bottom > top else None


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.where = schema, options["path"], []
        self.scale, self.split = float(options.get("dpi", "150")) / 72, int(options.get("split", str(64 << 20)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("doc_id",), ("page",)) and f.value is not None:
                self.where.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, path = _opened(self.path)
        found = fs.get_file_info(path)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        sizes = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Range(scheme + p, a, min(n, a + self.split)) for p, n in sizes for a in range(0, n, self.split)]

    def _lines(self, part: Range) -> Iterator[bytes]:
        """The range's lines; the line that a range begins within belongs to the one before."""
        fs, path = _opened(part.path)
        with fs.open_input_file(path) as raw:
            at = max(0, part.start - 1)
            raw.seek(at)
            rest, first = b"", part.start > 0
            while True:
                data = raw.read(1 << 20)
                rest += data
                *whole, rest = rest.split(b"\n")
                if not data and rest:
                    whole, rest = [rest], b""
                for line in whole:
                    if not first and at >= part.end:
                        return
                    at += len(line) + 1
                    if not first and line.strip():
                        yield line
                    first = False
                if not data:
                    return

    def _page(self, line: bytes, source: str) -> dict | None:
        try:
            page = json.loads(line)
            row = {"doc_id": str(page["doc_id"]), "page": int(page["page"]), "page_width": float(page["width"]) * self.scale, "page_height": float(page["height"]) * self.scale}
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            return {"doc_id": source, "reason": f"unreadable: {type(e).__name__}"}
        if not all(_TESTS[kind](row[name], value) for name, kind, value in self.where):
            return None
        wanted = {f.name: f.dataType for f in self.schema}
        if "lines" in wanted:
            row["lines"] = self._text_lines(page, set(wanted["lines"].elementType.names))
        if "figures" in wanted:
            drawn = [scaled(b, self.scale, max(1.0, self.scale)) for b in page.get("drawings") or []]
            row["figures"] = [b for b in (scaled(b, self.scale) for b in page.get("images") or []) if b] + [b for b in drawn if b and self._counts(b, row)]
        return row

    def _counts(self, b: dict, row: dict) -> bool:
        """Drawings that are large, or long lines."""
        thin = min(b["width"], b["height"]) <= max(3.0, 2 * self.scale) and max(b["width"], b["height"]) >= max(50.0, row["page_width"] * 0.04)
        return thin or b["width"] * b["height"] >= max(400.0, row["page_width"] * row["page_height"] * 0.0008)

    def _text_lines(self, page: dict, fields: set[str]) -> list[dict]:
        out = []
        for line in (x for b in page.get("blocks") or [] for x in b.get("lines") or []):
            spans = line.get("spans") or []
            text = "".join(s["text"] if s.get("text") is not None else "".join(c.get("c") or "" for c in s.get("chars") or []) for s in spans).strip()
            box = scaled(line.get("bbox"), self.scale)
            if not text or box is None:
                continue
            item = {"text": text, "box": box}
            if "chars" in fields:
                item["chars"] = [{"c": c.get("c"), "box": b} for s in spans for c in s.get("chars") or [] if (b := scaled(c.get("bbox"), self.scale))]
            if "spans" in fields:
                item["spans"] = [{"text": s.get("text"), "font": s.get("font"), "size": s.get("size"), "box": scaled(s.get("bbox"), self.scale)} for s in spans]
            out.append(item)
        out.sort(key=lambda x: (x["box"]["top"], x["box"]["left"]))
        return [x | {"line_no": k} for k, x in enumerate(out, 1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.schema)
        held: list[dict] = []
        for line in self._lines(partition):
            if (row := self._page(line, partition.path)) is not None:
                held.append(row)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
