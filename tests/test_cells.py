"""Table cleaning, against small grids and a plain model."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom.operators import cells as c
from gridloom.operators import ocr
from gridloom.plans import domain_queries

CELLS = "sheet string, row int, col int, value string"


def grid(spark, rows, sheet="s"):
    return spark.createDataFrame([(sheet, i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], CELLS)


def test_unmerge_overwrites_and_reaches_absent_cells(spark):
    df = spark.createDataFrame([("s", 0, 0, "a"), ("s", 0, 1, "x"), ("s", 3, 3, "z")], CELLS)
    merges = spark.createDataFrame([("s", 0, 0, 1, 1)], "sheet string, r0 int, c0 int, r1 int, c1 int")
    got = {(r.row, r.col): r.value for r in c.unmerge(df, merges).collect()}
    assert got == {(0, 0): "a", (0, 1): "a", (1, 0): "a", (1, 1): "a", (3, 3): "z"}


def test_tables_of_a_messy_sheet(spark):
    N = None
    df = grid(spark, [
        ["Report", N, N], ["Name", "Qty", N], ["ann", "3", N], [N, N, N], ["bob", "4", N],
        [N, N, N], [N, N, N], ["alone", N, N], [N, N, N], [N, N, N],
        ["k", "K", ""], ["1", "2", "3"], ["4", "5", "6"],
    ])
    rows = c.tables(df).orderBy("table", "row", "col").collect()
    first = [(r.row, r.name, r.value) for r in rows if r.table == "s (block 1)"]
    assert first == [(0, "Name", "ann"), (0, "Qty", "3"), (1, "Name", "bob"), (1, "Qty", "4")]
    second = [r.name for r in rows if r.table == "s (block 2)" and r.row == 0]
    assert second == ["k", "K_1", "col_2"]
    frame = c.to_frame(c.tables(df), "s (block 1)")
    assert [tuple(r) for r in frame.collect()] == [("ann", "3"), ("bob", "4")]


def model_blocks(filled, run=2):
    out, start, blank = [], None, 0
    for i, f in enumerate(filled):
        if f:
            start, blank = (i if start is None else start), 0
        else:
            blank += 1
            if start is not None and blank >= run:
                out.append((start, i - blank + 1))
                start = None
    if start is not None:
        out.append((start, len(filled)))
    return [b for b in out if b[1] - b[0] >= 2]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=18), min_size=1, max_size=6))
def test_blocks_like_the_model(spark, sheets):
    rows = [(f"s{k}", i, 0, "v" if f else None) for k, filled in enumerate(sheets) for i, f in enumerate(filled)]
    got = {}
    for r in c.blocks(spark.createDataFrame(rows, CELLS)).orderBy("sheet", "block").collect():
        got.setdefault(r.sheet, []).append((r.first, r.past))
    assert got == {f"s{k}": b for k, filled in enumerate(sheets) if (b := model_blocks(filled))}


@given(st.lists(st.one_of(st.none(), st.sampled_from(["a", "A", "a_1", " ", "b"]))))
def test_unique_names_never_clash(names):
    out = c.unique_names(names)
    assert len({n.lower() for n in out}) == len(names)
    assert all(n == (raw or "").strip() or n.startswith((raw or "").strip() or "col_") for n, raw in zip(out, names, strict=True))


def test_real_tables(spark):
    rows = [("words", w) for w in ("ant", "bee", "cat", "dog", "elk")] + [("digit", w) for w in ("ant", "bee", "c3")] + [("mixed", w) for w in ("ant", "bee", "cat", "dog", "two words")]
    df = spark.createDataFrame(rows, "table string, value string")
    assert {r.table for r in c.real_tables(df).collect()} == {"digit", "mixed"}


def test_ocr_columns_anchor_at_the_last_bound(spark):
    words = [("p", t, 90.0, x, 0, line, 1) for t, x, line in (("a", 0, 1), ("b", 40, 1), ("c", 81, 1), ("d", 5, 2), ("e", 100, 2))] + [("q", "x", -1.0, 0, 0, 1, 1)]
    df = spark.createDataFrame(words, "page string, text string, conf double, left int, top int, line_num int, block_num int")
    cells = {(r.row, r.col): r.value for r in ocr.word_tables(df).collect()}
    assert cells == {(0, 0): "a b", (0, 1): "c", (1, 0): "d", (1, 1): "e"}
    pages = {r.page: (r.text, r.avg_conf, r.n_words) for r in ocr.page_text(df).collect()}
    assert pages == {"p": ("a b c\nd e", 90.0, 5), "q": ("x", 0.0, 1)}


def broadcast_of(df, node):
    """Whether a broadcast holds the rows of ``node``, not a sum of them."""
    depth, lines = None, df._jdf.queryExecution().executedPlan().toString().splitlines()
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-*"))
        if depth is not None and (at <= depth or "Aggregate" in line):
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = at
        if depth is not None and node in line:
            return True
    return False


def test_cells_are_not_broadcast(spark, data):
    """Cells are made of a file that is far smaller than they are."""
    cells = domain_queries._cells(spark, data)
    for found in (c.unmerge(cells, domain_queries._merges(spark)), c.headers(cells, c.blocks(cells)), c.tables(cells)):
        assert not broadcast_of(found, "Generate")


def test_many_merges_join_by_shuffle(spark, monkeypatch):
    df = grid(spark, [["a", None, "b"], ["c", "d", None]])
    merges = spark.createDataFrame([("s", 0, 0, 1, 1), ("s", 1, 1, 3, 3), ("t", 0, 0, 0, 0)], "sheet string, r0 int, c0 int, r1 int, c1 int")
    rows = lambda: sorted(map(tuple, c.unmerge(df, merges).collect()), key=str)
    want = rows()
    monkeypatch.setattr(c, "BROADCAST_ROWS", 2)
    assert rows() == want and len(want) == 14


def test_blocks_over_many_bins(spark, monkeypatch):
    """Blocks and lines go on over the ends of bins."""
    lines = [["k", "v"] if i in (3, 30) else [str(i), "x"] if i % 11 < 9 and i != 20 else [None, None] for i in range(60)]
    df = grid(spark, lines)
    whole = sorted(map(tuple, c.tables(df).collect()))
    monkeypatch.setattr(c, "BIN", 4)
    assert sorted(map(tuple, c.tables(df).collect())) == whole
    got = [(r["first"], r.past) for r in c.blocks(df).orderBy("block").collect()]
    assert got == model_blocks([any(r) for r in lines])
