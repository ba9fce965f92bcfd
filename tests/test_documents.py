"""Documents and slides read back, combined tables, and prompts of several steps."""

import csv
import zipfile

import pytest

from gridloom.engine import Engine
from gridloom.export.office import write_document, write_slides
from gridloom.sources import documents

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_what_the_writers_wrote(spark, tmp_path):
    write_document(str(tmp_path / "d.docx"), "Prices", ["Of all kinds.", ("Fruit", ["Item", "Price"], iter([("apple", 1.5), ("pear & co", 3)]))])
    write_slides(str(tmp_path / "s.pptx"), "Deck", [[("Item", "Price"), ("apple", 1.5), ("pear", 3)], ["one line", "another"]])
    e = Engine(spark, output=str(tmp_path / "out"))
    assert e.ingest(str(tmp_path / "d.docx"), "d") == 2 and e.ingest(str(tmp_path / "s.pptx"), "s") == 2
    table = next(t.df for t in e.catalog.of(["d"]) if t.page == "Table 1")
    assert table.dtypes == [("Item", "string"), ("Price", "double")] and sorted(map(tuple, table.collect())) == [("apple", 1.5), ("pear & co", 3.0)]
    assert e.ask("show the table of contents of the document", file_id="d").text.splitlines()[0] == "Prices"
    assert "one line" in e.ask("what is on page 3 of the document", file_id="s").text
    assert "Tables on this page: Table 1" in e.ask("what is on page 2 of the document", file_id="s").text


def test_pages_headings_and_merged_cells():
    cell = lambda text, look="": f"<w:tc><w:tcPr>{look}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>A &amp; B</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br w:type="page"/></w:r></w:p>'
        "<w:p><w:r><w:lastRenderedPageBreak/><w:t>three</w:t></w:r></w:p><w:p/>"
        f"<w:tbl><w:tr>{cell('h', '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}{cell('x')}</w:tr>"
        f"<w:tr>{cell('v', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell('1')}{cell('2')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('3')}{cell('')}</w:tr></w:tbl>"
    )
    import io

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as book:
        book.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    rows = documents.parse_document(raw.getvalue())
    assert [(r[1], r[3], r[9]) for r in rows if r[0] == "text"] == [(1, 2, "A & B"), (1, 0, "one two"), (3, 0, "three")]
    assert {(r[5], r[6]): r[9] for r in rows if r[0] == "cell"} == {(0, 0): "h", (0, 2): "x", (1, 0): "v", (1, 1): "1", (1, 2): "2", (2, 1): "3", (2, 2): None}
    assert [r[5:9] for r in rows if r[0] == "merge"] == [(0, 0, 0, 1), (1, 0, 2, 0)]


@pytest.fixture
def two_files(spark, tmp_path):
    for name, rows in (("a", "x,y\n1,one\n2,two\n"), ("b", "x,y\n30,three\n"), ("c", "other,cols\n1,2\n")):
        (tmp_path / f"{name}.csv").write_text(rows)
    e = Engine(spark, output=str(tmp_path / "out"))
    for name in "abc":
        e.ingest(str(tmp_path / f"{name}.csv"), name)
    return e


def test_tables_of_several_files_combined(two_files):
    assert two_files.query("SELECT source_file, sum(x) AS s FROM combined GROUP BY source_file ORDER BY 1").collect() == [("a", 3), ("b", 30)]
    assert two_files.plan("how many rows")["files"] == ["a", "b", "c"] and two_files.plan("how many rows", "b")["files"] == ["b"]


def test_steps_follow_each_other(two_files, tmp_path):
    answer = two_files.ask("list the rows of the table with x over 1 and then export the file to picked.csv", sql="SELECT x, y FROM combined WHERE x > 1")
    assert answer.intent == "complex" and answer.written.ok and answer.table.count() == 2
    with open(tmp_path / "out" / "picked.csv", encoding="utf-8") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["x", "y"] and sorted(rows[1:]) == [["2", "two"], ["30", "three"]]
