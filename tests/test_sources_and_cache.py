"""Workbooks as a data source, tables of pages, kept tables, pages and deadlines."""

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.engine import Engine
from gridloom.export.office import write_workbook
from gridloom.sources import files, workbook


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    workbook.register(spark)
    home = tmp_path_factory.mktemp("books")
    for b in range(3):
        write_workbook(str(home / f"b{b}.xlsx"), [(f"Sheet{s}", ["Id", "Name", "Price"], iter([(i, f"n{b}{s}{i}", i / 4) for i in range(20 + s)])) for s in range(4)])
    (home / "notes.txt").write_text("no workbook")
    return str(home)


def test_cells_of_a_folder_a_partition_a_sheet(spark, folder):
    cells = spark.read.format("workbook").load(folder)
    assert cells.rdd.getNumPartitions() == 12
    got = {(r.file.rsplit("/", 1)[1], r.sheet, r.row, r.col): r.value for r in cells.collect()}
    parsed = {(r.file.rsplit("/", 1)[1], r.sheet, r.row, r.col): r.value for r in files.workbook_rows(spark, f"{folder}/*.xlsx").where("what = 'cell'").collect()}
    assert got == parsed and got["b1.xlsx", "Sheet2", 3, 1] == "n122" and len(got) == 3 * sum(3 * (21 + s) for s in range(4))
    assert spark.read.format("workbook").load(f"{folder}/b0.xlsx").select("file").distinct().count() == 1


def test_rows_by_schema_read_the_asked_columns(spark, folder):
    df = spark.read.format("workbook").schema("price double, id bigint, missing string").load(folder)
    assert df.agg(F.count("*"), F.sum("id"), F.sum("price"), F.count("missing")).first()[:] == (3 * 86, 3 * sum(sum(range(20 + s)) for s in range(4)), 3 * sum(sum(range(20 + s)) for s in range(4)) / 4, 0)
    read = workbook.WorkbookReader(folder, df.select("id").schema, False, 0)
    assert list(read.read(read.partitions()[0]))[:3] == [(0,), (1,), (2,)]
    with pytest.raises(PySparkException):
        spark.read.format("workbook").load(folder + "/nowhere").count()


PAGE = """<h1>Prices</h1><p>of all kinds</p>
<table><tr><th>Item<th>Year<th>Price</tr><tr><td rowspan=2>apple</td><td>2020<td>1.5</tr><tr><td>2021</td><td>2.5</td></tr><tr><td>pear &amp; co</td><td>2020</td><td>3</td></tr></table>
<table><tr><td>word</td><td>list</td></tr><tr><td>only</td><td>words</td></tr><tr><td>are</td><td>here</td></tr></table>"""


def test_tables_of_a_page(spark, tmp_path):
    (tmp_path / "p.html").write_text(PAGE)
    e = Engine(spark, output=str(tmp_path / "out"))
    assert e.ingest(str(tmp_path / "p.html"), "p") == 3
    found = {t.page: t.df for t in e.catalog.of(["p"]) if t.page != "text"}
    prices = found["1 Table 1"]
    assert prices.dtypes == [("Item", "string"), ("Year", "bigint"), ("Price", "double")]
    assert [tuple(r) for r in prices.orderBy("Item", "Year").collect()] == [("apple", 2020, 1.5), ("apple", 2021, 2.5), ("pear & co", 2020, 3.0)]
    assert [t.page for t in e.catalog.of(["p"], 2, 1, real=True) if t.page != "text"] == ["1 Table 1"]  # a list of words is none
    assert e.catalog.of(["p"], page=2) == [] and len(e.catalog.of(["p"], least_rows=3)) == 1
    answer = e.ask("what is on page 1 of the document", file_id="p")
    assert "Tables on this page: 1 Table 1" in answer.text and answer.table.count() == 3


def test_pages_of_a_text_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text("first page\ftext of the second\fthird")
    e = Engine(spark, output=str(tmp_path / "out"))
    e.ingest(str(tmp_path / "t.txt"), "t")
    assert e.ask("what is on page 2 of the document", file_id="t").text == "text of the second"


def test_a_reingested_file_never_answers_from_what_was_kept(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a,b\n1,2\n")
    e = Engine(spark, output=str(tmp_path / "out"))
    e.ingest(str(path), "f")
    total = lambda: e.query("SELECT sum(a) AS s FROM data").first().s
    assert [total(), total(), total()] == [1, 1, 1]
    assert len(e.catalog.kept) == 1 and e.catalog.kept[0].df.storageLevel.useMemory
    old = e.catalog.kept[0].df
    e.ingest(str(path), "f")  # the same content: what is kept stays
    assert e.catalog.kept[0].df is old
    time.sleep(0.01)
    path.write_text("a,b\n40,2\n2,2\n")
    e.ingest(str(path), "f")
    assert e.catalog.kept == [] and not old.storageLevel.useMemory
    assert [total(), total(), total()] == [42, 42, 42]
    again = Engine(spark, output=str(tmp_path / "out2"))
    again.ingest(str(path), "g")
    assert again.query("SELECT sum(a) AS s FROM data").first().s == 42


def test_the_table_used_longest_ago_goes(spark, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_KEPT", 2)
    c = catalog.Catalog(spark)
    c.add_file("f", "n", "tabular")
    a, b, d = (c.add_table("f", n, spark.range(i + 70, i + 75)) for i, n in enumerate("abd"))
    for t in (a, a, b, b, a, d, d):
        c.use(t)
    assert c.kept == [a, d] and not b.df.storageLevel.useMemory
    c.drop_file("f")
    assert c.kept == [] and not a.df.storageLevel.useMemory


def test_deadlines_of_queries_and_writes(spark, tmp_path, monkeypatch):
    (tmp_path / "n.csv").write_text("a\n" + "\n".join(map(str, range(300))))
    e = Engine(spark, output=str(tmp_path / "out"), deadline=1.0, write_deadline=1.0)
    e.ingest(str(tmp_path / "n.csv"), "f")
    began = time.time()
    with pytest.raises(Exception, match="(?i)cancel"):
        e.query("SELECT count(*) AS n FROM data x CROSS JOIN data y CROSS JOIN data z CROSS JOIN data w WHERE x.a + y.a * z.a % (w.a + 1) = -1")
    assert time.time() - began < 30
    assert e.query("SELECT count(*) AS n FROM data").first().n == 300
    slow = F.udf(lambda x: (time.sleep(0.2), x)[1], "bigint")
    written = e._write([e.catalog.tables[0].df.select(slow("a").alias("a"))], {"sink": "csv", "filename": None}, "slow")
    assert not written.ok
