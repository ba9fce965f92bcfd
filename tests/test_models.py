"""What models do, by deterministic stand-ins; repaired text; arithmetic."""

import pytest
from pyspark.sql import functions as F

from gridloom import models
from gridloom.functions import text
from gridloom.operators import ocr
from gridloom.plans import guard


def test_reshaping_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * 400, None if i == 5 else f"n{i}") for i in range(40)], "id int, long string, name string").coalesce(1)

    def model(rows, wanted):
        assert len(rows) <= 12 and all(len(r["long"]) == 300 for r in rows)
        if any(r["id"] == "13" for r in rows):
            raise RuntimeError("the second batch fails")
        return [{"Name": r["name"], "Key": int(r["id"]) * 2, "other": 1} for r in rows]

    out = models.reshaped_by(df, ["Key", "Name", "Missing"], model)
    assert out.columns == ["Key", "Name", "Missing"]
    rows = [tuple(r) for r in out.collect()]
    assert rows == [(str(2 * i), "" if i == 5 else f"n{i}", "") for i in range(40) if not 12 <= i < 24]
    assert models.reshaped_by(df.limit(0), ["a"], model).collect() == []


@pytest.mark.parametrize("reply", ['[{"a": 1}]', '```json\n{"rows": [{"a": 1}]}\n```', '```\n[{"a": 1}]```'])
def test_rows_of_a_reply(reply):
    assert models.rows_of_reply(reply) == [{"a": 1}]
    with pytest.raises(ValueError):
        models.rows_of_reply("[1]")


def test_pages_by_a_reader(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"hello world|second page")
    (tmp_path / "b.png").write_bytes(b"broken")

    def reader(content):
        if content == b"broken":
            raise ValueError
        return [[{"text": w, "conf": 90.0, "left": 100 * i, "top": 0, "line_num": 1, "block_num": 1} for i, w in enumerate(p.split())] for p in content.decode().split("|")]

    words = models.read_pages(spark.read.format("binaryFile").load(str(tmp_path)), reader)
    got = {(r.path.rsplit("/", 1)[1], r.page): r.text for r in words.groupBy("path", "page").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text")).collect()}
    assert got == {("a.png", 1): "hello world", ("a.png", 2): "page second", ("b.png", 0): ""}
    assert {(r.page, r.text, r.avg_conf) for r in ocr.page_text(words.where("page > 0")).collect()} == {(1, "hello world", 90.0), (2, "second page", 90.0)}


def test_embedding_and_grounded_answers(spark):
    embed = lambda texts: [[t.count(c) for c in "abcdefgh"] for t in texts]  # noqa: E731  a module of tests isn't on the workers
    chunks = spark.createDataFrame([(i, c) for i, c in enumerate(["aaa", "aab", "bbb", "cc", "ccd", "", "gh", None])], "chunk_id int, chunk string")
    vectors = models.embedded(chunks, embed, batch=2)
    got = {r.chunk_id: r.embedding for r in vectors.collect()}
    assert got[7] is None and got[5] is None and got[0][0] == 1.0 and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in got.values() if v)

    def generate(question, context):
        if question == "h":
            raise RuntimeError
        return f"{question}: {', '.join(context)}"

    questions = spark.createDataFrame([(1, "a"), (2, "c"), (3, "h"), (4, None), (5, "zzz")], "question_id int, question string")
    out = {r.question_id: (r.answer, r.sources) for r in models.grounded(questions, vectors, embed, generate, k=2).collect()}
    assert out[1] == ("a: aaa, aab", ["0", "1"]) and out[2] == ("c: cc, ccd", ["3", "4"])
    assert out[3][0] is None and out[3][1][0] == "6" and out[4] == out[5] == (None, None)


def test_repair(spark):
    good = ["naïve café – “déjà vu”", "Größe €5", "日本語", "plain", "", None, "Ã alone", "über Â", "x\x92y"]
    bad = [None if t is None else t.encode().decode("latin-1") for t in good]
    windows = "naïve café déjà vu €5 – ok".encode().decode("cp1252", "ignore")
    df = spark.createDataFrame(list(enumerate([*bad, *good, windows])), "i int, t string")
    got = [r.u for r in df.select("i", text.unmangled(F.col("t")).alias("u")).orderBy("i").collect()]
    assert got[: len(good)] == good and got[len(good) : 2 * len(good)] == good
    assert "naïve café déjà vu €5" in got[-1]
    odd = "ﬁne ﬂow ‘a’ “b”\r\nc\rd\u2028e\u200b\x00f\ufeff"
    assert spark.createDataFrame([(odd,)], "t string").select(text.repaired(F.col("t"))).first()[0] == "fine flow 'a' \"b\"\nc\nd\nef"


def test_arithmetic(spark):
    assert guard.calculate(spark, "2 * (3 + 4) - 1") == 13 and float(guard.calculate(spark, "sqrt(2.25) + pow(2, 3)")) == 9.5
    for bad in ("1) AS a, (2", "reflect('java.lang.System', 'exit', 1)", "(SELECT max(x) FROM t)", "1; DROP TABLE t"):
        with pytest.raises(guard.NotAllowed):
            guard.calculate(spark, bad)
