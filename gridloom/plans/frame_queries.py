"""Queries of the data-frame methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.export import match
from gridloom.operators import frames, reshape, windows
from gridloom.plans.registry import load, query

GAPS = "SELECT p_partkey, nullif(p_type, 'SMALL') AS kind, nullif(p_size, 7) AS size, nullif(p_brand, 'Brand#1') AS brand FROM part"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("kind"), F.nullif("p_size", F.lit(7)).alias("size"), F.nullif("p_brand", F.lit("Brand#1")).alias("brand"))


@query(f"SELECT * FROM ({GAPS}) WHERE (kind IS NOT NULL)::INT + (size IS NOT NULL)::INT + (brand IS NOT NULL)::INT >= 2")
def frame_dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.drop_missing(_gaps(spark, sf_dir), ["kind", "size", "brand"], least=2)


@query(f"SELECT p_partkey, coalesce(kind, '?') AS kind, coalesce(size, 0) AS size, brand FROM ({GAPS})")
def frame_fillna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).na.fill({"kind": "?", "size": 0})


@query("SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'S' WHEN 'ECONOMY' THEN 'E' ELSE p_type END AS p_type FROM part")
def frame_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.replace_values(load(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_type"], {"SMALL": "S", "ECONOMY": "E"})


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 AS after_first, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) > 1 AS before_last, count(*) OVER (PARTITION BY p_name) > 1 AS any_repeat FROM part")
def frame_duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda keep: frames.duplicated(["p_name"], ["p_partkey"], keep)
    return load(spark, sf_dir, "part").select("p_partkey", d("first").alias("after_first"), d("last").alias("before_last"), d(None).alias("any_repeat"))


@query("SELECT p_partkey, p_name, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey DESC) = 1")
def frame_drop_duplicates_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.without_duplicates(load(spark, sf_dir, "part"), ["p_name", "p_brand"], ["p_partkey"], "last").select("p_partkey", "p_name", "p_brand")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders")
def frame_cumcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", frames.place_in_group(["o_custkey"], ["o_orderkey"]).alias("place"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2")
def frame_group_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.group_tail(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 260000)")
def frame_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.groups_where(load(spark, sf_dir, "orders"), ["o_custkey"], F.avg("o_totalprice") > 260000).select("o_orderkey")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def frame_select_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.columns_like(load(spark, sf_dir, "customer"), kinds=["bigint", "int", "double"])


@query("SELECT c_custkey AS id, c_name AS \"full name\", round(c_acctbal * 1.1, 4) AS raised FROM customer")
def frame_assign_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer").withColumns({"raised": F.round(F.col("c_acctbal") * 1.1, 4)})
    return match.kept(match.renamed(df, {"C_CUSTKEY": "id", " c_name ": "full name"}), ["id", "Full  Name", "raised"])


@query("SELECT c_name AS \"C_NAME\", c_acctbal AS \"C_ACCTBAL\", '' AS price, '' AS owner FROM customer")
def frame_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.reshaped(load(spark, sf_dir, "customer"), ["C_NAME", "C_ACCTBAL", "price", "owner"])


@query("SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem")
def frame_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.pairwise_correlation(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("r", F.round("r", 6))


@query("SELECT n_regionkey AS regionkey, max(CASE WHEN place = 0 THEN n_name END) AS first, max(CASE WHEN place = 1 THEN n_name END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place FROM nation) GROUP BY 1")
def frame_unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = load(spark, sf_dir, "nation").withColumn("place", frames.place_in_group(["n_regionkey"], ["n_nationkey"]))
    return reshape.unstack(placed, ["n_regionkey"], "place", "n_name", [0, 1], ["first", "second"]).withColumnRenamed("n_regionkey", "regionkey")


@query("WITH g AS (SELECT l_returnflag AS f, sum(l_quantity) AS q, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) SELECT 'quantity' AS measure, max(q) FILTER (f = 'A') AS \"A\", max(q) FILTER (f = 'N') AS \"N\", max(q) FILTER (f = 'R') AS \"R\" FROM g UNION ALL SELECT 'lines', max(n) FILTER (f = 'A'), max(n) FILTER (f = 'N'), max(n) FILTER (f = 'R') FROM g")
def frame_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_flag = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    return reshape.transpose(by_flag, "l_returnflag", ["A", "N", "R"], "measure")


@query("SELECT event_id, greatest(value, max(value) OVER w) AS top, min(value) OVER w AS low, round(value / first_value(value) OVER w, 6) AS indexed FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def frame_cummax(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return load(spark, sf_dir, "events").select("event_id", F.max("value").over(w).alias("top"), F.min("value").over(w).alias("low"), F.round(F.col("value") / F.first("value").over(w), 6).alias("indexed"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) <= 4")
def frame_nsmallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_per_group(load(spark, sf_dir, "customer"), ["c_mktsegment"], [F.asc("c_acctbal"), F.asc("c_custkey")], 4).select("c_mktsegment", "c_custkey", "c_acctbal")


@query("SELECT user_id, CAST(epoch(max(ts)) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS seconds FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def frame_timedelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return span.select("user_id", frames.seconds_between(F.col("a"), F.col("z")).alias("seconds"))


@query("SELECT strftime(unnest(generate_series(DATE '2024-01-29', DATE '2024-02-02', INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM region")
def frame_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.sequence(F.lit("2024-01-29").cast("date"), F.lit("2024-02-02").cast("date"))
    return load(spark, sf_dir, "region").select(F.explode(days.cast("array<string>")).alias("day"))


@query("SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H') AS lima FROM events")
def frame_time_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in UTC shown in a zone five hours behind."""
    return load(spark, sf_dir, "events").select("event_id", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/Lima"), F.col("ts")), "yyyy-MM-dd HH").alias("lima"))


@query()
def frame_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.hashed_sample(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 0.1)


@query("SELECT (SELECT count(*) FROM customer) AS n_rows, 5 AS n_columns, (SELECT count(DISTINCT c_nationkey) FROM customer) AS n_nations")
def frame_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer")
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.count_distinct("c_nationkey").alias("n_nations"))
