"""Main text of pages of other layouts, by a generator and a reader that the operator knows nothing of."""

import random
import sys
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, str(Path(__file__).parent))

import web_pages as web  # noqa: E402
from gridloom.llm import html_labeller  # noqa: E402

SCHEMA = "page_id bigint, url string, html string"


def texts(spark, pages):
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], SCHEMA)
    got = {r.page_id: r.text for r in html_labeller.page_digest(df).collect()}
    return [got[i] for i in range(len(pages))]


def shares(found, wanted):
    """Of the characters of the main text the share found, and of those found the share that is main text."""
    hit = sum(len(b) for f, w in zip(found, wanted, strict=True) for b in f.split("\n") if b in w)
    return hit / sum(len(b) for w in wanted for b in w), hit / max(1, sum(len(b) for f in found for b in f.split("\n")))


@pytest.mark.parametrize("form", web.FORMS)
def test_layouts(spark, form):
    made = [web.page(form, seed) for seed in range(100)]
    recall, precision = shares(texts(spark, [p for p, _ in made]), [w for _, w in made])
    assert recall >= 0.98 and precision >= 0.98


def test_any_class_on_any_layout(spark):
    """Twenty classes, most of them made up, on each form that takes classes."""
    rng = random.Random(20)
    names = ["wp block paragraph", "body copy", "t1", "it's", *(web.name(rng) for _ in range(16))]
    for form in ("classed", "nested", "br", "table"):
        made = [web.page(form, seed, marks) for seed, marks in enumerate(names)]
        recall, precision = shares(texts(spark, [p for p, _ in made]), [w for _, w in made])
        assert recall >= 0.98 and precision >= 0.98, form


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_given_pages_by_the_standard_reader(spark, scale):
    pages = [r.html for r in spark.read.parquet(f"/root/testdata/{scale}/pages.parquet").select("html").limit(2000).collect()]
    found = texts(spark, pages)
    wanted = [web.Reader.text("article", p) if p else "" for p in pages]
    same = sum(f == w for f, w in zip(found, wanted, strict=True))
    assert same >= 0.98 * len(pages)


def test_pages_without_tags_and_broken_lines(spark):
    long = "A harvest is told of here, and of the road to the town. " * 4
    pages = [long, f"<div>{long}<br><br>{long}</div>", f"<table><tr><td><p>{long}</p><p>Second: {long}</p></td></tr></table>", "<p>one</p>", ""]
    got = texts(spark, pages)
    assert got[0] == long.strip() and got[1] == f"{long}{long}".strip() and got[2] == f"{long.strip()}\nSecond: {long.strip()}" and got[4] == ""
