"""Substring joins, numbering in ranges, clauses and intents of prompts that the rules were not written beside."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import clauses
from gridloom.operators import relational as rel
from gridloom.plans import relational_queries, router


def test_substring_join_finds_every_pair(spark, data):
    texts = ["small ring", "ring", "", None, "ünïcode ring", "in", "a", "aaaa", "ringring"]
    needles = ["ring", "in", "a", "", None, "aaa", "ï", "ring ", "not there", "ring"]
    a = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    b = spark.createDataFrame(list(enumerate(needles)), "j int, n string")
    got = sorted((r.i, r.j) for r in rel.contains_join(a, b, "t", "n").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if t is not None and n is not None and n in t)
    assert rel.contains_join(a, b.limit(0), "t", "n").count() == 0
    plan = rel.contains_join(a, b, "t", "n")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert relational_queries.join_substring(spark, data).count() > 0


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_places_of_a_total_order(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("k"), (F.col("id") * 7919 % 500).alias("v"))
        rows = rel.with_place(df, ["k", "v"], "at").collect()
        assert [r.at for r in sorted(rows, key=lambda r: (r.k is None, r.k or "", r.v))] == list(range(500))
        sizes = [r["count"] for r in rel.ranged(df, ["k", "v"]).groupBy("__range").count().collect()]
        assert parts == 1 or max(sizes) < 2.5 * 500 / parts  # though two thirds of the rows have one first value
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(
    ("prompt", "names"),
    [
        ("export it, columns: a, b c,d", ["a", "b c", "d"]),
        ("Columns = unit price\tname  total\nowner", ["unit price", "name", "total", "owner"]),
        ("ratio 3:1, then column : x", ["x"]),
        ("the columns of a=b, columns: \"first, last\", 'net sum', rest", ["first, last", "net sum", "rest"]),
        ("columns:", None), ("columns a, b", None), ("mycolumns: a", None), ("rows: a, b", None), (None, None), ("columns: driver's age,é", ["driver's age", "é"]),
    ],
)
def test_wanted_columns(spark, prompt, names):
    assert spark.createDataFrame([(prompt,)], "p string").select(clauses.wanted_columns(F.col("p"))).first()[0] == names


#: Prompts and what a reader takes them to ask, with a table in scope.
UNSEEN = [
    ("what did i ask you earlier", "chat_history"), ("remind me of my last question", "chat_history"), ("what was your previous answer?", "chat_history"),
    ("recap our conversation", "chat_history"), ("why did you fail", "ai_meta"), ("you are wrong again", "ai_meta"), ("this isn't working", "ai_meta"),
    ("which files are there?", "list_files"), ("what documents did we upload", "list_files"), ("list my files please", "list_files"), ("how many files have I uploaded", "list_files"),
    ("good morning", "general"), ("who invented the telephone", "general"), ("thanks a lot!", "general"),
    ("how many rows have a total above 50", "data_query"), ("show the average amount by region", "data_query"), ("give me the highest value per customer", "data_query"),
    ("filter the table to last year's records", "data_query"), ("sum the amount column", "data_query"), ("find duplicate rows in the sheet", "data_query"),
    ("create 20 rows of fake sales data", "generate"), ("generate a realistic sample dataset", "generate"), ("create synthetic records", "generate"),
    ("give me a summary of the report", "overview"), ("what is this document about", "overview"), ("overview of the uploaded file", "overview"),
    ("which chapters does the report have", "table_of_contents"), ("show the headings", "table_of_contents"), ("sections of the document", "table_of_contents"),
    ("save the report as report.docx, columns: name, age", "export"), ("download the document as a pdf slide deck in pptx", "export"), ("write the document to out.csv", "export"),
    ("what is on page 12 of the document", "page_lookup"), ("read page 4", "page_lookup"), ("explain the second paragraph of the document", "qa"), ("does the document mention penalties", "qa"),
]


def test_unseen_prompts(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(UNSEEN)], "i int, p string")
    got = {r.i: r.intent for r in df.select("i", router.intent(F.col("p")).alias("intent")).collect()}
    wrong = [(p, want, got[i]) for i, (p, want) in enumerate(UNSEEN) if got[i] != want]
    # With a table in scope the rule for table questions comes before the one for headings.
    assert wrong == [("show the headings", "table_of_contents", "data_query")]


def test_first_rows_are_those_read_first(spark):
    from gridloom.export.sinks import first_rows

    df = spark.range(0, 1000, 1, 7).select(F.col("id").alias("a"))
    assert [r.a for r in first_rows(df, 12).collect()] == list(range(12))


def test_runs_leave_each_others_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from gridloom import scratch

    def one(i):
        with scratch.run():
            other, kept = scratch.materialize(spark.range(5), "other"), scratch.materialize(spark.range(10 + i), "kept")
            scratch.discard_all_but(kept)
            return other, kept

    outside = scratch.materialize(spark.range(3), "outside")
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(one, range(4)))
    assert [kept.count() for _, kept in found] == [10, 11, 12, 13] and outside.count() == 3
    for other, _ in found:
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            other.collect()
    scratch.discard(outside)


@pytest.mark.parametrize("parts", [1, 3])
def test_extremes_of_equal_balances_are_those_of_the_least_key(spark, tmp_path, parts):
    rows = [(k, None if k == 2 else f"c{k:03d}", k % 3, None if k < 3 else [5.0, -1.0][k // 3 % 2]) for k in range(60)] + [(60, None, 0, 9.0)]
    df = spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double")
    df.repartition(parts).sortWithinPartitions("c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_nationkey: (r.richest, r.poorest) for r in relational_queries.arg_extremes(spark, str(tmp_path)).collect()}
    assert got == {n: (f"c{n + 6:03d}", f"c{n + 3:03d}") for n in range(3)}
