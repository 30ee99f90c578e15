"""Importers on files made here."""

from __future__ import annotations

import sqlite3
import zipfile

from paperloom.sources import read
from paperloom.sources.files import exports, now, page_paragraphs, visible, write_report

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_csv_and_failures(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("번호,문제,선지1,선지2,정답\n27,알파,가,나,1\n12,감마\n정답: ②,,,\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    got = {(r.path.rpartition("/")[2], r.pos): r for r in read(spark, "csv", str(tmp_path)).collect()}
    assert (got["a.csv", 0].number, got["a.csv", 0].choices, got["a.csv", 0].title) == ("27", ["가", "나"], "알파")
    assert ("b.csv", 0) not in got and got["c.csv", 0].reason == "no_items"  # Spark lists no file of zero bytes


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "bank.db") as db:
        db.execute("CREATE TABLE q (no, question, answer)")
        db.execute("CREATE TABLE other (x)")
        db.executemany("INSERT INTO q VALUES (?, ?, ?)", [(1, "one", "3"), (2, None, "x")])
    db.close()
    rows = read(spark, "sqlite", str(tmp_path / "bank.db")).collect()
    assert [(r.number, r.stem, r.answer, r.subject, r.source_name) for r in rows] == [("1", "one", "3", "", "bank.db:q")]
    (tmp_path / "bad.db").write_bytes(b"no database")
    assert read(spark, "sqlite", str(tmp_path / "bad.db")).first().reason == "wrong_kind"


def test_text_docx_hwpx(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1. 첫째\n① 가 ② 나\n2. 둘째\n빠른 정답\n1. ②\n", encoding="utf-8")
    rows = read(spark, "text", str(tmp_path / "t.txt")).collect()
    assert [r.number for r in rows][:2] == ["1", "2"] and rows[0].choices == ["가", "나"]
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('1. 가')}<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>{p('2. 나')}</w:body></w:document>")
    rows = read(spark, "docx", str(tmp_path / "d.docx")).orderBy("pos").collect()
    assert [(r.number, r.tables) for r in rows] == [("1", [[["x", "y"]]]), ("2", [])]
    cell = lambda r, c, s, t: f'<tc><subList><p><run><t>{t}</t></run></p></subList><cellAddr rowAddr="{r}" colAddr="{c}"/><cellSpan rowSpan="1" colSpan="{s}"/></tc>'
    with zipfile.ZipFile(tmp_path / "h.hwpx", "w") as z:
        z.writestr("Contents/section10.xml", "<sec><p><run><t>3. 끝</t></run></p></sec>")
        z.writestr("Contents/section2.xml", f"<sec><p><run><t>1. 가</t><tbl><tr>{cell(0, 0, 2, 'w')}</tr><tr>{cell(1, 0, 1, 'a')}{cell(1, 1, 1, 'b')}</tr></tbl></run></p></sec>")
    rows = read(spark, "hwpx", str(tmp_path / "h.hwpx")).orderBy("pos").collect()
    assert [r.number for r in rows] == ["1", "3"] and rows[0].tables == [[["w", ""], ["a", "b"]]]
    assert exports(spark, str(tmp_path)).count() == 2


def test_pages():
    html = f"<nav>menu</nav><p>aside</p><article><h1>T</h1><p>{'long ' * 60}</p><p>same</p><p>same</p><img src=a.png></article><script>x</script><img src=b.png>"
    texts, images = page_paragraphs(html)
    assert texts == ["T", ("long " * 60).strip(), "same"] and images == ["a.png"]
    assert page_paragraphs("<p>one</p><img src=b.png><img src=b.png>") == (["one"], ["b.png"]) and page_paragraphs(None) == ([], [])


def test_reports_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/report.json"
    for n in (3, 2):
        write_report(spark.range(n), path)
        assert spark.read.json(path).count() == n and [p.name for p in tmp_path.iterdir()] == ["report.json"]
    assert spark.range(1).select(now().alias("t")).first().t.microsecond == 0


def test_visible_files(spark):
    names = ["a.json", "b/c.json", "b/c.PDF", "b/d.hwpx", "e"]
    assert [r.name for r in visible(spark.createDataFrame([(n,) for n in names], "name string")).collect()] == ["a.json", "b/c.PDF", "b/d.hwpx", "e"]
