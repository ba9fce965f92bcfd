"""Queries of the training-data operators over their whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontaminate, html_labeller, merkle, packing, pii, quality, sharding, simhash, sketch, substring_index, suffix_dedup, whitening
from gridloom.llm.scratch import table

RANK_FILE = "byte_bpe_50k.tiktoken"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_labeller.page_digest(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op5_document_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.sketch_digest(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.dedup_digest(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_html_extraction": op2_html_extraction,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_document_sketch": op5_document_sketch,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_decontamination": op11_decontamination,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN firsts USING (k), range(13) r(j) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t, count(gone.p) AS n FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS k FROM starts),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d JOIN lengths ON len(w) >= m),
hits AS (SELECT row, m, i, item FROM (SELECT row, m, i, array_to_string(w[i : i + m - 1], ' ') AS k FROM places) JOIN windows USING (m, k)),
covered AS (SELECT row, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT row, m, i FROM hits) h, range(10) r(j) WHERE j < m GROUP BY 1),
items AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item::BLOB) AS ids FROM (SELECT DISTINCT row, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c USING (row) LEFT JOIN items t USING (row)""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
fields AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS run, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS own, [doc_id::VARCHAR, source, lang, (n_chars::HUGEINT + 1)::VARCHAR, text] AS more,
    coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0, false) AS hit
  FROM documents, crc_table),
hashed AS (
  SELECT doc_id, run, sha256(array_to_string(list_transform(own, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) AS leaf,
    CASE WHEN hit THEN sha256(array_to_string(list_transform(more, lambda v: coalesce(strlen(v) || ':' || v, '-')), '')) ELSE leaf END AS given FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY run) AS n FROM hashed),
nodes(run, lvl, pos, n, h) AS (
  SELECT run, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT run, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY run, lvl, n, pos // 2),
subroots AS (SELECT run, h, row_number() OVER (ORDER BY run::BLOB) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, n, pos // 2),
inner_levels AS (SELECT DISTINCT run, lvl FROM nodes WHERE n > 1),
outer_levels AS (SELECT DISTINCT lvl FROM tops WHERE n > 1),
steps AS (
  SELECT l.run, l.pos, 0 AS part, v.lvl, coalesce(CASE WHEN l.pos >> v.lvl & 1 = 1 THEN '<' ELSE '>' END || o.h, '') AS s
  FROM leaves l JOIN inner_levels v USING (run) LEFT JOIN nodes o ON o.run = l.run AND o.lvl = v.lvl AND o.pos = xor(l.pos >> v.lvl, 1)
  UNION ALL SELECT l.run, l.pos, 1, v.lvl, coalesce(CASE WHEN r.pos >> v.lvl & 1 = 1 THEN '<' ELSE '>' END || o.h, '')
  FROM leaves l JOIN subroots r USING (run) CROSS JOIN outer_levels v LEFT JOIN tops o ON o.lvl = v.lvl AND o.pos = xor(r.pos >> v.lvl, 1)),
paths AS (SELECT run, pos, list(s ORDER BY part, lvl) AS path FROM steps GROUP BY 1, 2),
proofs AS (
  SELECT doc_id, leaf, r.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(given, coalesce(path, [])), lambda h, s: CASE WHEN s[1] = '<' THEN sha256(s[2:] || h) ELSE sha256(h || s[2:]) END) AS folded_root
  FROM leaves l JOIN subroots r USING (run) LEFT JOIN paths p ON p.run = l.run AND p.pos = l.pos)
SELECT *, folded_root = root AS verified FROM proofs""",
}
