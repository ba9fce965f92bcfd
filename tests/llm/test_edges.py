"""Odd tables through every operator and every stage: clashing extra columns, empty tables, nulls everywhere, long texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from gridloom.llm import bpe, html_labeller, packing, pii, quality, sharding, simhash, sketch, substring_index, suffix_dedup  # noqa: E402

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = """__x __row __found __words __hashes __next __place __range __of __stratum __id __text __key tie own next k s a b n gram fp root
component_id stratum kept n_words n_good quality size shard slot row id key pos hub links piece start length offset sequence_id tokens word hash run page label""".split()

DIGESTS = {
    "pii": pii.pii_digest,
    "simhash": simhash.near_digest,
    "suffix_dedup": suffix_dedup.dedup_digest,
    "sketch": sketch.sketch_digest,
    "packing": lambda docs: packing.pack_documents(docs, RANKS, PATTERN),
    "substring": substring_index.dedup_digest,
    "sharding": sharding.shard_documents,
    "bpe": lambda docs: bpe.encode_digest(docs, RANKS, PATTERN),
    "quality": lambda docs: quality.quality_digest(docs, labels_of(docs)),
}


def labels_of(docs):
    return docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).distinct()


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"w{i}" for i in range(90))
    texts = [passage, passage, f"one more {passage} and its end", "Call +1 (555) 010-0199 or a.b@example.org on 2020-01-31.", "", None, " ", passage + " x" * 20000 + " mail c.d@example.org"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None,) * 5, (None,) * 5], DOCS).repartition(2).cache()


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def bag(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_extra_columns_change_nothing(docs, wide, name):
    plain = DIGESTS[name](docs)
    assert bag(plain, plain.columns) == bag(DIGESTS[name](wide), plain.columns)


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_tables_without_rows(spark, name):
    assert DIGESTS[name](spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, docs, wide, tmp_path, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    labels_of(docs).write.parquet(f"file://{tmp_path}/labels.parquet")
    out = run(spark, wide, str(tmp_path))
    if stage != "packing":
        assert out.columns == wide.columns
        extra = out.select(*CLASHING).distinct().collect()
        assert [tuple(r) for r in extra] == [tuple(f"own {c}" for c in CLASHING)]
        texts = docs.columns
        assert bag(out, texts) == bag(run(spark, docs, str(tmp_path)), texts)
    else:
        assert out.count() >= docs.count()
    assert run(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_personal_data_in_a_long_text(docs):
    long = docs.where("doc_id = 7").withColumn("before", F.char_length("text"))
    got = pii.pseudonymize(long).first()
    assert "c.d@example.org" not in got.text and got.text.endswith("@example.org") and got.text.count(" x") >= 20000


def test_long_and_unclosed_pages(spark):
    body = "".join(f"<p>Paragraph {i} tells of the harvest and of the long road to the town.</p>" for i in range(3000))
    pages = [(1, "u", f"<html><body><article><h1>Harvest</h1>{body}</article></body></html>"), (2, "u", "<div><p>open <b"), (3, None, None), (None, None, "<" * 5000)]
    wide = spark.createDataFrame(pages, "page_id bigint, url string, html string").select("*", *[F.lit("own").alias(c) for c in CLASHING])
    got = {r.page_id: r for r in html_labeller.page_digest(wide).collect()}
    assert len(got) == 4 and (got[3].text, got[3].n_chars) == ("", 0)
    assert all(f"Paragraph {i} tells" in got[1].text for i in (0, 1500, 2999)) and got[1].n_chars == len(got[1].text)
    assert html_labeller.page_digest(wide.limit(0)).collect() == []
