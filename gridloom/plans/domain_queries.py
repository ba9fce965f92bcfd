"""Queries of the table-cleaning, text, routing, log, retrieval, page and streaming operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import oplog, retrieval
from gridloom.catalog import scope
from gridloom.export import match, validate
from gridloom.functions import clauses, text
from gridloom.neighbours import VectorIndex
from gridloom.operators import cells as cell_ops
from gridloom.operators import ocr
from gridloom.plans import router
from gridloom.plans.registry import load, query
from gridloom.sources import files
from gridloom.streaming import jobs, sessions

# Scalar functions


@query(
    """SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, upper(p_type) AS up, replace(p_name, ' ', '_') AS under, string_split(p_name, ' ')[1] AS first_word, substring(p_name, 2, 4) AS cut, length(p_name) AS n,
    lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, concat_ws('/', p_brand, p_type) AS joined, p_name LIKE '%ing%' AS has_ing, p_name ILIKE 'RED%' AS red, regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no,
    regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, reverse(p_type) AS backwards, left(sha256(p_name), 16) AS key FROM part"""
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), F.upper("p_type").alias("up"), F.replace(name, F.lit(" "), F.lit("_")).alias("under"), F.split(name, " ")[0].alias("first_word"),
        F.substring(name, 2, 4).alias("cut"), F.length(name).cast("bigint").alias("n"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.concat_ws("/", "p_brand", "p_type").alias("joined"),
        name.contains("ing").alias("has_ing"), name.ilike("RED%").alias("red"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("brand_no"), F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"),
        F.reverse("p_type").alias("backwards"), text.content_key(name).alias("key"),
    )


@query(
    """SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, least(greatest(c_acctbal, 0), 5000) AS clipped, round(ln(abs(c_acctbal) + 1), 6) AS l, round(pow(c_nationkey, 2), 2) AS p,
    round(sqrt(abs(c_acctbal)), 6) AS s, CAST(c_custkey % 7 AS BIGINT) AS m, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(sign(c_acctbal) AS DOUBLE) AS sg, round(c_acctbal / nullif(c_nationkey, 0), 6) AS ratio FROM customer"""
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.abs(x).alias("a"), F.round(x, 1).alias("r"), F.least(F.greatest(x, F.lit(0.0)), F.lit(5000.0)).alias("clipped"), F.round(F.log(F.abs(x) + 1), 6).alias("l"), F.round(F.pow("c_nationkey", F.lit(2)), 2).alias("p"),
        F.round(F.sqrt(F.abs(x)), 6).alias("s"), (F.col("c_custkey") % 7).alias("m"), F.floor(x).alias("f"), F.signum(x).alias("sg"), F.round(F.try_divide(x, F.col("c_nationkey")), 6).alias("ratio"),
    )


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST((dayofweek(o_orderdate) + 6) % 7 AS INTEGER) AS monday_0,
    strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days_left, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due,
    CAST(quarter(o_orderdate) AS INTEGER) AS q FROM orders"""
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"), F.weekday(day).alias("monday_0"), F.trunc(day, "month").cast("string").alias("month_start"),
        F.datediff(F.lit("2000-01-01").cast("date"), day).alias("days_left"), F.date_add(day, 30).cast("string").alias("due"), F.quarter(day).alias("q"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


@query("SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, 'Brand#1', '') AS INTEGER) AS n, CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 30 THEN 'mid' ELSE 'high' END AS band, nullif(p_type, 'SMALL') AS kind, coalesce(nullif(p_type, 'SMALL'), '?') AS shown FROM part")
def conditional_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.nullif("p_type", F.lit("SMALL"))
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_replace("p_brand", "Brand#1", "").try_cast("int").alias("n"), F.when(F.col("p_size") < 10, "low").when(F.col("p_size") < 30, "mid").otherwise("high").alias("band"), kind.alias("kind"), F.coalesce(kind, F.lit("?")).alias("shown")
    )


@query("SELECT vec_id, len(embedding) AS n, round(list_max(embedding), 5) AS top, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 'sum'), 4) AS norm, len(list_filter(embedding, lambda x: x > 0)) AS n_positive FROM embeddings")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.size(v).cast("bigint").alias("n"), F.round(F.array_max(v), 5).alias("top"), F.round(squares, 4).alias("norm"), F.size(F.filter(v, lambda x: x > 0)).cast("bigint").alias("n_positive"))


@query("SELECT event_id, map_keys(m)[1] AS k, map_values(m)[1] AS v, m['click'] AS clicked, s.a AS a FROM (SELECT event_id, map([event_type], [value]) AS m, {'a': user_id, 'b': value} AS s FROM events)")
def map_struct_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = F.create_map("event_type", "value"), F.struct(F.col("user_id").alias("a"), F.col("value").alias("b"))
    rows = load(spark, sf_dir, "events").select("event_id", m.alias("m"), s.alias("s"))
    return rows.select("event_id", F.map_keys("m")[0].alias("k"), F.map_values("m")[0].alias("v"), F.try_element_at("m", F.lit("click")).alias("clicked"), F.col("s.a").alias("a"))


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS kinds FROM orders GROUP BY 1")
def array_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"))


@query("SELECT c_custkey, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || coalesce(chr(10) || 'segment: ' || nullif(c_mktsegment, 'MACHINERY'), '') AS card FROM customer")
def record_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    return c.select("c_custkey", text.record_card(["c_custkey", "c_name", "segment"]).alias("card"))


# Table cleaning, over cells made from part: a sheet for each remainder of 7, three blank rows after every nine.

CELLS = """c AS (SELECT 's' || (p_partkey % 7) AS sheet, CAST(p_partkey // 7 + 3 * (p_partkey // 7 // 9) AS INTEGER) AS row, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part),
cells AS (SELECT sheet, row, 0 AS col, p_name AS value FROM c UNION ALL SELECT sheet, row, 1, p_brand FROM c UNION ALL SELECT sheet, row, 2, nullif(p_size, '7') FROM c UNION ALL SELECT sheet, row, 3, NULL FROM c)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.floor(k / 7)
    c = load(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), (k % 7).cast("string")).alias("sheet"), (line + 3 * F.floor(line / 9)).cast("int").alias("row"),
        F.posexplode(F.array("p_name", "p_brand", F.nullif(F.col("p_size").cast("string"), F.lit("7")), F.lit(None).cast("string"))).alias("col", "value"),
    )
    return c


def _merges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"s{i}", r, i % 2, r + 2, i % 2 + 1) for i in range(7) for r in (0, 13, 40)], "sheet string, r0 int, c0 int, r1 int, c1 int")


@query(
    f"""WITH {CELLS}, m AS (SELECT 's' || i AS sheet, r AS r0, i % 2 AS c0, r + 2 AS r1, i % 2 + 1 AS c1 FROM range(7) a(i), (VALUES (0), (13), (40)) b(r)),
    f AS (SELECT m.*, value AS filled FROM m LEFT JOIN cells ON cells.sheet = m.sheet AND row = r0 AND col = c0)
    SELECT cells.sheet, cells.row, cells.col, CASE WHEN f.sheet IS NOT NULL THEN filled ELSE value END AS value FROM cells LEFT JOIN f ON cells.sheet = f.sheet AND row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1
    UNION ALL SELECT f.sheet, r.r, k.c, filled FROM f, range(200) r(r), range(4) k(c) WHERE r.r BETWEEN r0 AND r1 AND k.c BETWEEN c0 AND c1 AND NOT EXISTS (SELECT 1 FROM cells WHERE cells.sheet = f.sheet AND row = r.r AND col = k.c)"""
)
def unmerge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_ops.unmerge(_cells(spark, sf_dir), _merges(spark))


BLOCKS = f"""{CELLS}, rows AS (SELECT sheet, row, bool_or(value IS NOT NULL) AS filled FROM cells GROUP BY ALL),
s AS (SELECT sheet, row, coalesce(CAST(row - lag(row) OVER w > 2 AS INTEGER), 1) AS starts FROM rows WHERE filled WINDOW w AS (PARTITION BY sheet ORDER BY row)),
p AS (SELECT sheet, row, sum(starts) OVER (PARTITION BY sheet ORDER BY row) AS part FROM s),
b AS (SELECT sheet, min(row) AS first, max(row) + 1 AS past FROM p GROUP BY sheet, part HAVING max(row) + 1 - min(row) >= 2),
blocks AS (SELECT sheet, CAST(row_number() OVER (PARTITION BY sheet ORDER BY first) AS INTEGER) AS block, first, past FROM b)"""


@query(f"WITH {BLOCKS} SELECT * FROM blocks")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_ops.blocks(_cells(spark, sf_dir))


HEADERS = f"""{BLOCKS}, v AS (SELECT b.sheet, b.block, b.first, cells.row, trim(value) AS v FROM blocks b JOIN cells ON cells.sheet = b.sheet AND row BETWEEN first AND past - 1 WHERE value IS NOT NULL AND row - first < 16),
    t AS (SELECT sheet, block, first, row, count(*) AS n, avg(CAST(NOT regexp_full_match(v, '[0-9]+') AS INTEGER)) AS text, count(DISTINCT v) AS kinds, avg(length(v)) AS len FROM v GROUP BY ALL),
    x AS (SELECT *, n / 4 AS fill, lead(n / 4) OVER (PARTITION BY sheet, block ORDER BY row) AS next FROM t),
    y AS (SELECT sheet, block, row, fill * 0.4 + text * 0.3 + kinds / n * 0.2 + CASE WHEN len < 40 THEN 0.1 ELSE 0.0 END + CASE WHEN next > fill * 0.5 THEN 0.15 ELSE 0.0 END AS score FROM x WHERE n >= 2 AND row - first < 15),
    h AS (SELECT sheet, block, row AS header FROM y QUALIFY row_number() OVER (PARTITION BY sheet, block ORDER BY round(score, 9) DESC, row) = 1)"""


@query(f"WITH {HEADERS} SELECT * FROM h")
def header_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    return cell_ops.headers(c, cell_ops.blocks(c)).select("sheet", "block", "header")


@query(
    f"""WITH {HEADERS}, l AS (SELECT sheet, first, past, header, CASE WHEN count(*) OVER (PARTITION BY sheet) > 1 THEN sheet || ' (block ' || block || ')' ELSE sheet END AS "table" FROM blocks JOIN h USING (sheet, block)),
    i AS (SELECT "table", header, row, col, value FROM l JOIN cells ON cells.sheet = l.sheet AND row BETWEEN first AND past - 1 WHERE value IS NOT NULL),
    k AS (SELECT "table", col, coalesce(nullif(t, ''), 'col_' || col) AS raw, row_number() OVER (PARTITION BY "table" ORDER BY col) - 1 AS place, count(*) OVER (PARTITION BY "table") AS width
        FROM (SELECT DISTINCT "table", col FROM i WHERE row > header) LEFT JOIN (SELECT "table", col, trim(value) AS t FROM i WHERE row = header) USING ("table", col)),
    u AS (SELECT *, row_number() OVER (PARTITION BY "table", lower(raw) ORDER BY place) - 1 AS again FROM k WHERE width >= 2),
    r AS (SELECT "table", row, row_number() OVER (PARTITION BY "table" ORDER BY row) - 1 AS line FROM (SELECT DISTINCT "table", row FROM i WHERE row > header))
    SELECT "table", CAST(line AS INTEGER) AS row, CAST(place AS INTEGER) AS col, CASE WHEN again = 0 THEN raw ELSE raw || '_' || again END AS name, value FROM i JOIN u USING ("table", col) JOIN r USING ("table", row)"""
)
def clean_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_ops.tables(_cells(spark, sf_dir))


@query("SELECT p_type, p_partkey, CASE WHEN n = 0 THEN p_name ELSE p_name || '_' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_type, lower(p_name) ORDER BY p_partkey) - 1 AS n FROM part)")
def unique_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_type", "p_partkey", cell_ops.unique_name("p_type", "p_name", "p_partkey").alias("name"))


@query("SELECT doc_id AS \"table\" FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) GROUP BY 1 HAVING avg(CAST(regexp_full_match(trim(w), '\\p{L}+') AS INTEGER)) <= 0.8 OR bool_or(regexp_matches(w, '\\p{Nd}'))")
def junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("table"), F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("value"))
    return cell_ops.real_tables(words)


@query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) < 40 AS thin, length(trim(text, ' ')) < 20 OR contains(text, '<|') AS malformed FROM documents")
def thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.is_thin(F.col("text")).alias("thin"), text.is_malformed(F.col("text")).alias("malformed"))


@query("SELECT url, trim(regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g'), '_') AS name, trim(regexp_replace(url, '\\W+', '_', 'g'), '_') AS sql_name FROM pages")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("url", text.identifier(F.col("url")).alias("name"), text.sql_identifier(F.col("url")).alias("sql_name"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("text"), F.when(k == 3, -1.0).otherwise(F.col("l_quantity")).alias("conf"),
        (F.col("l_partkey") % 500).cast("int").alias("left"), F.lit(0).alias("top"), (F.col("l_suppkey") % 3).cast("int").alias("line_num"), F.lit(1).alias("block_num"),
    )


WORDS = "w AS (SELECT l_orderkey AS page, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS text, CASE WHEN l_linenumber = 3 THEN -1.0 ELSE l_quantity END AS conf, CAST(l_partkey % 500 AS INTEGER) AS \"left\", CAST(l_suppkey % 3 AS INTEGER) AS line_num FROM lineitem)"


@query(f"WITH {WORDS}, l AS (SELECT page, line_num, string_agg(text, ' ' ORDER BY \"left\", text) AS line, sum(conf) FILTER (WHERE conf >= 0) AS s, count(*) FILTER (WHERE conf >= 0) AS c, count(*) AS n FROM w GROUP BY ALL) SELECT page, string_agg(line, chr(10) ORDER BY line_num) AS text, coalesce(round(sum(s) / sum(c), 1), 0) AS avg_conf, CAST(sum(n) AS BIGINT) AS n_words FROM l GROUP BY 1")
def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.page_text(_words(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {WORDS}, b(page, edge) AS (SELECT page, min("left") FROM w GROUP BY 1 UNION ALL SELECT b.page, min(w."left") FROM b JOIN w ON w.page = b.page AND w."left" > edge + 40 GROUP BY b.page, edge),
    p AS (SELECT w.page, line_num, text, "left", (SELECT count(*) FROM b WHERE b.page = w.page AND edge <= "left") - 1 AS col FROM w),
    c AS (SELECT page, line_num, col, string_agg(text, ' ' ORDER BY "left", text) AS value FROM p GROUP BY ALL)
    SELECT page, CAST(dense_rank() OVER (PARTITION BY page ORDER BY line_num) - 1 AS INTEGER) AS row, CAST(col AS INTEGER) AS col, value FROM c QUALIFY min(line_num) OVER (PARTITION BY page) < max(line_num) OVER (PARTITION BY page)"""
)
def ocr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.word_tables(_words(spark, sf_dir))


# Matching and checks


@query("SELECT count(*) AS n_rows, round(avg(filled) / 3, 6) AS fill_rate, round(avg(CAST(filled = 0 AS INTEGER)), 6) AS blank_row_rate, round(1 - count(DISTINCT (a, b, c)) / count(*), 6) AS repeat_rate FROM (SELECT *, (a <> '')::INT + (b <> '')::INT + (c <> '')::INT AS filled FROM (SELECT CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS a, CASE WHEN p_size > 30 THEN p_type ELSE '' END AS b, CASE WHEN p_size > 40 THEN p_name ELSE '' END AS c FROM part))")
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    df = load(spark, sf_dir, "part").select(F.when(size > 25, F.col("p_brand")).otherwise("").alias("a"), F.when(size > 30, F.col("p_type")).alias("b"), F.when(size > 40, F.col("p_name")).otherwise("nan").alias("c"))
    return validate.rates(df).select("n_rows", *[F.round(c, 6).alias(c) for c in ("fill_rate", "blank_row_rate", "repeat_rate")])


@query("SELECT unnest(['p_partkey', 'digits']) AS name FROM (SELECT 1)")
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"), "p_type")
    return spark.createDataFrame([(c,) for c in validate.numeric_columns(df)], "name string")


@query("SELECT p_brand AS label, len(list_intersect(list(DISTINCT lower(p_type)), ['small', 'economy', 'no such'])) / 3 AS overlap FROM part GROUP BY 1")
def schema_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.collect_set("p_type").alias("columns"))
    return match.overlaps(tables, ["Small", " ECONOMY ", "no  such"]).select("label", "overlap")


# Prompts: short ones made from part, and the users' turns.

PROMPTS = [
    "remind me what you said", "why did you fail again", "how many files did I upload", "what is the weather", "how many rows are there in the table", "generate 20 rows of sample data", "give me an overview of this document",
    "show the table of contents of the file", "columns in the report file?", "export the document to report.docx", "what is on page 12 of the pdf", "tell me more about the document",
]


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = F.element_at(F.array(*[F.lit(p) for p in PROMPTS]), (F.col("p_partkey") % len(PROMPTS) + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(picks, F.lit(" "), F.col("p_name")).alias("prompt"))


#: What each of the prompts asks for, with a table in scope and without, written by hand.
EXPECTED = [
    ("chat_history", "chat_history"), ("ai_meta", "ai_meta"), ("list_files", "list_files"), ("general", "general"), ("data_query", "list_columns"), ("generate", "generate"), ("overview", "overview"),
    ("data_query", "table_of_contents"), ("data_query", "list_columns"), ("export", "export"), ("page_lookup", "page_lookup"), ("qa", "qa"),
]
_SQL_LIST = ["[" + ", ".join(f"'{e[k]}'" for e in EXPECTED) + "]" for k in (0, 1)]


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_SQL_LIST[0]}[p_partkey % 12 + 1] ELSE {_SQL_LIST[1]}[p_partkey % 12 + 1] END AS intent FROM part".replace("p_partkey % 12", "CAST(p_partkey % 12 AS INTEGER)"))
def route_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("p_partkey", router.intent(F.col("prompt"), F.col("p_partkey") % 2 == 0).alias("intent"))


# The users' turns are made-up words, of which only "stores" happens to be one that the rules know.
@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\bstores\b') THEN 'export' ELSE 'general' END AS intent FROM conversations WHERE role = 'user'")
def route_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", router.intent(F.col("text")).alias("intent"))


@query("SELECT c_custkey, c_name AS \"from\", c_mktsegment AS \"to\", [c_name, c_mktsegment] AS wanted, 'docx' AS sink, 'out.docx' AS filename FROM customer")
def prompt_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat(F.lit("Rename '"), F.col("c_name"), F.lit("' to \""), F.col("c_mktsegment"), F.lit("\", save as Out.docx, columns: "), F.col("c_name"), F.lit(",  "), F.col("c_mktsegment"))
    c = load(spark, sf_dir, "customer").select("c_custkey", prompt.alias("prompt"))
    renames = clauses.renames(F.col("prompt"))
    return c.select(
        "c_custkey", F.map_keys(renames)[0].alias("from"), F.map_values(renames)[0].alias("to"), clauses.wanted_columns(F.col("prompt")).alias("wanted"), clauses.target_format(F.col("prompt")).alias("sink"), clauses.file_name(F.col("prompt")).alias("filename")
    )


UPLOADS = [("f0", "Plan.xlsx", 0), ("f1", "sales.csv", 1), ("f2", "scan.png", 2)]


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ['f0', 'f1', 'f2'] WHEN 1 THEN ['f2'] WHEN 2 THEN ['f0'] WHEN 3 THEN ['f0', 'f1'] WHEN 4 THEN ['f0'] ELSE [] END AS scope FROM part")
def file_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["use all files", "open the latest upload", "the first document", "join sales.csv with PLAN.xlsx", "the excel one", "nothing named"]
    prompt = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 6 + 1).cast("int"))
    prompts = load(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"))
    return scope(prompts, spark.createDataFrame(UPLOADS, "file_id string, name string, pos int")).select("p_partkey", "scope")


# Logs: ingestions, turns and feedback made from documents and events.


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("timestamp"), F.lit("ingestion").alias("type"),
        F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") % 200).cast("string")).alias("file_id"), F.when(F.col("doc_id") % 11 != 0, F.left(F.sha2("text", 256), F.lit(12))).alias("content_hash"),
    )
    e = load(spark, sf_dir, "events")
    turns = e.where("event_id % 3 > 0").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("timestamp"), F.lit("interaction").alias("type"), (F.col("event_type") != "error").alias("success"))
    rated = e.where("event_id % 3 = 0").select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("timestamp"), F.lit("feedback").alias("type"),
        F.concat(F.lit("e"), (F.col("event_id") + 1 + F.col("user_id") % 5).cast("string")).alias("interaction_id"), F.when(F.col("value") < 5, "bad").when(F.col("value") < 8, "wrong_intent").otherwise("good").alias("rating"),
    )
    return docs.unionByName(turns, True).unionByName(rated, True)


INGESTED = "i AS (SELECT 'd' || doc_id AS id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS timestamp, source || '/' || (doc_id % 200) AS file_id, CASE WHEN doc_id % 11 <> 0 THEN left(sha256(text), 12) END AS content_hash FROM documents)"


@query(f"WITH {INGESTED} SELECT id, file_id, content_hash FROM i WHERE file_id IN (SELECT file_id FROM i GROUP BY 1 HAVING count(DISTINCT content_hash) > 1)")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.collisions(_log(spark, sf_dir)).select("id", "file_id", "content_hash")


@query("SELECT DISTINCT id FROM (SELECT 'e' || event_id AS id, event_type FROM events WHERE event_id % 3 > 0) WHERE event_type = 'error' OR id IN (SELECT 'e' || (event_id + 1 + user_id % 5) FROM events WHERE event_id % 3 = 0 AND value < 8)")
def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.failures(_log(spark, sf_dir)).select("id")


@query(f"WITH {INGESTED} SELECT id, timestamp FROM i ORDER BY timestamp DESC, id DESC LIMIT 50")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.tail(oplog.uploads(_log(spark, sf_dir)).select("id", "timestamp"))


@query("SELECT conv_id, turn, role, CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.recent_turns(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM (SELECT * FROM events) GROUP BY 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.latest(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# Retrieval


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, CAST(i * 1300 + 1 AS INTEGER), 1500) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 200) / 1300) AS BIGINT)))) AS i FROM documents WHERE length(trim(text, ' ')) > 0)")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fixed_chunks(load(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def chunk_at_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE label < 5 ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id LIMIT 6")
def nearest_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 7").first()["embedding"]
    return retrieval.nearest(vectors, asked, 6, where=F.col("label") < 5).select("vec_id", F.round("distance", 5).alias("distance"))


@query("SELECT q.vec_id AS query_id, e.vec_id FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) <= 6")
def nearest_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return retrieval.nearest_each(vectors.where("vec_id % 20 = 0"), vectors).select("query_id", "vec_id")


@query()
def nearest_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by probing; tests hold the recall against all pairs."""
    vectors = load(spark, sf_dir, "embeddings")
    index = VectorIndex(vectors)
    return index.nearest(vectors.where("vec_id % 20 = 0"), 6, index.probes_for(0.93)).select("query_id", "vec_id", "rank", F.round("distance", 5).alias("distance"), "compared")


# Pages


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]\\s*>', 1)) AS h FROM pages) WHERE trim(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) <> '' GROUP BY 1")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.headings(load(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?is)<(?:script)\\b.*?</script\\s*>|<(?:style)\\b.*?</style\\s*>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", files.visible_text(F.col("html")).alias("text"))


# Every text as it looks after its UTF-8 bytes were read as Latin-1, once and twice over, and repaired again.
@query("SELECT doc_id, md5(text) AS once, md5(text) AS twice, length(text) AS n FROM documents WHERE text IS NOT NULL")
def text_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    mangled = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", mangled(F.col("text")).alias("once"))
    found = docs.select("doc_id", text.unmangled(F.col("once")).alias("once"), text.unmangled(mangled(F.col("once"))).alias("twice"))
    return found.select("doc_id", F.md5("once").alias("once"), F.md5("twice").alias("twice"), F.char_length("once").cast("bigint").alias("n"))


# Streams, drained to the end and read back


def _drained(spark: SparkSession, df: DataFrame) -> DataFrame:
    folder = tempfile.mkdtemp(prefix="gridloom-stream-") if not (shared := spark.conf.get("spark.checkpoint.dir", None)) else f"{shared.rstrip('/')}/gridloom-stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one table, without its name's suffix being taken for a folder."""
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 DAY, min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts in append mode: days that the watermark has closed."""
    out = jobs.tumbling(_closing(spark, sf_dir), "ts", "1 day", ["event_type"])
    return _drained(spark, out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT user_id, count(*) AS n_events, CAST(sum(fresh) AS BIGINT) AS n_sessions FROM (SELECT user_id, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY 1")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of four hours by the same function that streams use, in batch."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sessions(e, "ts", "4 hours", ["user_id"]).groupBy("user_id").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_sessions"))


# A pause of a day or a purchase ends a session; those over an hour before the last event are closed.
@query(
    """WITH e AS (SELECT *, event_type = 'purchase' AS buys, max(ts) OVER () AS top FROM events),
    marked AS (SELECT *, CASE WHEN lag(buys) OVER w OR ts - lag(ts) OVER w > INTERVAL 24 HOUR THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS run FROM marked),
    s AS (SELECT user_id, run, min(ts) AS started, max(ts) AS ended, count(*) AS n, round(sum(value), 4) AS total, bool_or(buys) AS closed, min(top) AS top FROM runs GROUP BY 1, 2)
    SELECT user_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended, n, total, closed FROM s
    WHERE date_trunc('millisecond', top) - INTERVAL 1 HOUR >= CASE WHEN closed THEN ended ELSE ended + INTERVAL 24 HOUR END"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.closing_sessions(_closing(spark, sf_dir), "user_id", "ts", "value", F.col("event_type") == "purchase", "24 hours", "1 hour")
    found = _drained(spark, out).where("kind = 'session'")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("user_id", stamp("started"), stamp("ended"), "n", F.round("total", 4).alias("total"), "closed")
