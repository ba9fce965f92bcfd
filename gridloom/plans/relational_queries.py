"""Queries of the relational operators: filters, joins, aggregates, windows, sets, shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.export.sinks import lines_of
from gridloom.functions import statistics as stats
from gridloom.operators import relational as rel
from gridloom.operators import reshape, sketches, windows
from gridloom.operators.quantiles import exact_quantiles
from gridloom.operators.scans import Scan, asof_join, scanned
from gridloom.plans import guard
from gridloom.plans.registry import load, query

REVENUE = """
SELECT c_mktsegment AS segment, count(*) AS n_items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment"""


@query(REVENUE)
def revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a prompt-shaped request as guarded SQL over views."""
    views = ["lineitem", "orders", "customer"]
    for v in views:
        load(spark, sf_dir, v).createOrReplaceTempView(v)
    return guard.run(spark, REVENUE, views)


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS gross FROM lineitem WHERE l_quantity > 45 AND l_returnflag IN ('A', 'R')")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_returnflag in ('A', 'R')").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_extendedprice")).alias("gross"))


@query("SELECT * FROM customer WHERE c_name = 'Customer#000000042'")
def row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").where("c_name = 'Customer#000000042'")


@query("SELECT p_partkey, nullif(p_size, 7) IS NULL AS size_missing, coalesce(nullif(p_size, 7), -1) AS size_filled FROM part WHERE nullif(p_type, 'SMALL') IS NOT NULL")
def null_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    size = F.nullif("p_size", F.lit(7))
    return part.where(F.nullif("p_type", F.lit("SMALL")).isNotNull()).select("p_partkey", size.isNull().alias("size_missing"), F.coalesce(size, F.lit(-1)).alias("size_filled"))


# Joins


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.where("o_totalprice > 400000").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


def _some_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_orderpriority")


def _some_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), "c_name")


SIDES = "(SELECT o_custkey AS custkey, o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 450000) o {} JOIN (SELECT c_custkey AS custkey, c_name FROM customer WHERE c_acctbal > 0) c USING (custkey)"


@query(f"SELECT custkey, c_name, o_orderkey, o_orderpriority FROM {SIDES.format('LEFT')}")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.merge(_some_orders(spark, sf_dir), _some_customers(spark, sf_dir), ["custkey"], "left").select("custkey", "c_name", "o_orderkey", "o_orderpriority")


@query(f"SELECT custkey, c_name, o_orderkey, o_orderpriority FROM {SIDES.format('RIGHT')}")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.merge(_some_orders(spark, sf_dir), _some_customers(spark, sf_dir), ["custkey"], "right").select("custkey", "c_name", "o_orderkey", "o_orderpriority")


@query(f"SELECT custkey, c_name, o_orderkey, o_orderpriority FROM {SIDES.format('FULL')}")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.merge(_some_orders(spark, sf_dir), _some_customers(spark, sf_dir), ["custkey"], "outer").select("custkey", "c_name", "o_orderkey", "o_orderpriority")


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = load(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return load(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = load(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return load(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "region").crossJoin(load(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("SELECT a.key, a.n AS n_parts, b.n AS n_types FROM (SELECT nullif(p_size, 7) AS key, count(*) AS n FROM part GROUP BY 1) a JOIN (SELECT nullif(p_size, 7) AS key, count(DISTINCT p_type) AS n FROM part GROUP BY 1) b ON a.key IS NOT DISTINCT FROM b.key")
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").withColumn("key", F.nullif("p_size", F.lit(7)))
    return rel.merge(part.groupBy("key").agg(F.count("*").alias("n_parts")), part.groupBy("key").agg(F.count_distinct("p_type").alias("n_types")), ["key"], null_keys_match=True)


@query("SELECT event_id, band FROM events JOIN (SELECT s_suppkey AS band, s_suppkey % 100 * 1.0 AS low, s_suppkey % 100 + 0.5 AS high FROM supplier) b ON value BETWEEN low AND high")
def join_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("band"), (F.col("s_suppkey") % 100 * F.lit(1.0)).alias("low"), (F.col("s_suppkey") % 100 + F.lit(0.5)).alias("high"))
    return rel.band_join(load(spark, sf_dir, "events").select("event_id", "value"), bands, "value", "low", "high", 1.0, clustered=True).select("event_id", "band")


SECONDS = "date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts)"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("second", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"))


@query(
    """SELECT a.event_id AS error_id, b.event_id AS click_id FROM (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type = 'error') a
    JOIN (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND b.us BETWEEN a.us AND a.us + 3600000000"""
)
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within an hour after an error of the same user."""
    e = load(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("us").alias("low"), (F.col("us") + 3_600_000_000).alias("high"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "us")
    return rel.band_join(clicks, errors, "us", "low", "high", 3_600_000_000, ["user_id"]).select("error_id", "click_id")


@query(
    """SELECT p.event_id, c.event_id AS last_click, round(c.value, 4) AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""
)
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("last_click"), F.round("value", 4).alias("last_value"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, clicks, ["user_id"], "ts", ["last_click", "last_value"], tie="last_click").select("event_id", "last_click", "last_value")


@query("SELECT p_partkey, kind FROM part JOIN (SELECT DISTINCT lower(p_type) AS kind FROM part) ON contains(p_name, kind)")
def join_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    kinds = part.select(F.lower("p_type").alias("kind")).distinct()
    return rel.contains_join(part, kinds, "p_name", "kind").select("p_partkey", "kind")


# Aggregates


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n,
    round(stddev(l_quantity), 6) AS std_qty, median(l_quantity) AS med_qty FROM lineitem GROUP BY ALL"""
)
def agg_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_discount").alias("min_disc"), F.max("l_tax").alias("max_tax"),
        F.count("*").alias("n"), F.round(F.stddev("l_quantity"), 6).alias("std_qty"), F.median("l_quantity").alias("med_qty"),
    )


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n > 15")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("SELECT l_linestatus, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def agg_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("n_discounted"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"))


GROUPED = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INTEGER) AS g1, CAST(grouping(l_linestatus) AS INTEGER) AS g2, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY {}"


def _levels() -> list:
    return [F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"), F.sum("l_quantity").alias("qty")]


@query(GROUPED.format("ROLLUP (l_returnflag, l_linestatus)"))
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(*_levels())


@query(GROUPED.format("CUBE (l_returnflag, l_linestatus)"))
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(*_levels())


@query(GROUPED.format("GROUPING SETS ((l_returnflag), (l_linestatus))"))
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(*_levels())


@query("SELECT o_orderpriority, round(skewness(o_totalprice), 6) AS skew, round(kurtosis(o_totalprice), 6) AS kurt, round(var_samp(o_totalprice) / 1e6, 4) AS var_millions, round(stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 4) AS sem FROM orders GROUP BY 1")
def agg_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(stats.skewness(x), 6).alias("skew"), F.round(stats.kurtosis(x), 6).alias("kurt"), F.round(F.var_samp(x) / 1e6, 4).alias("var_millions"), F.round(stats.standard_error(x), 4).alias("sem"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem GROUP BY 1")
def agg_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_quantiles(load(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.9], ["l_returnflag"], "q")
    return found.select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 8) AS cov FROM lineitem")
def agg_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.covar_samp("l_quantity", "l_discount"), 8).alias("cov"))


# The SQL has the exact figures; the sketches of days, merged, must lie within their error bounds of them.
@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close FROM events GROUP BY 1")
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and the median of the values by type, read off merged sketches of days, beside the exact figures."""
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    by_day = sketches.sketched(e, ["day", "event_type"], ["user_id"], ["value"])
    found = sketches.read_off(sketches.merged(by_day, ["event_type"])).select(F.col("event_type").alias("of_type"), "n", "sum_value", "distinct_user_id", F.get("quantiles_value", F.lit(0)).alias("median"))
    joined = e.join(F.broadcast(found), F.col("event_type") == F.col("of_type"))  # a row for each type
    exact = joined.groupBy("event_type", "n", "sum_value", "distinct_user_id").agg(
        F.count_distinct("user_id").alias("users"), F.avg((F.col("value") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("upto")
    )
    close = F.abs(F.col("distinct_user_id") - F.col("users")) <= 1 + 0.07 * F.col("users")
    return exact.select("event_type", "n", F.round("sum_value", 2).alias("total"), "users", close.alias("users_close"), ((F.col("below") <= 0.54) & (F.col("upto") >= 0.46)).alias("median_close"))


@query("SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.value_counts(load(spark, sf_dir, "events"), "event_type").withColumn("share", F.round("share", 6))


@query("SELECT p_size, n FROM (SELECT p_size, count(*) AS n, max(count(*)) OVER () AS top FROM part GROUP BY 1) WHERE n = top")
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.modes(load(spark, sf_dir, "part"), "p_size")


@query("SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev(c_acctbal), 4) AS std, min(c_acctbal) AS low, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS q50, round(quantile_cont(c_acctbal, 0.75), 4) AS q75, max(c_acctbal) AS high FROM customer")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = "c_acctbal"
    row = load(spark, sf_dir, "customer").agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev(x), 4).alias("std"), F.min(x).alias("low"), F.percentile(x, [0.25, 0.5, 0.75]).alias("q"), F.max(x).alias("high"))
    return row.select("n", "mean", "std", "low", *[F.round(F.col("q")[i], 4).alias(f"q{p}") for i, p in enumerate((25, 50, 75))], "high")


# Shapes


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 8) AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pivot_table(load(spark, sf_dir, "events"), ["user_id"], "event_type", TYPES, F.round(F.avg("value"), 8))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.crosstab(load(spark, sf_dir, "events"), "user_id", "event_type", TYPES)


@query("SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (value FOR variable IN (l_quantity, l_discount, l_tax))")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.melt(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("SELECT bin, count(*) AS n FROM (SELECT greatest(0, least(9, CAST(ceil((o_totalprice - lo) / ((hi - lo) / 10)) AS INTEGER) - 1)) AS bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)) GROUP BY 1")
def bins_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.equal_bins(load(spark, sf_dir, "orders"), "o_totalprice", 10).groupBy("bin").agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders) SELECT CAST(o_totalprice > e[1] AS INTEGER) + CAST(o_totalprice > e[2] AS INTEGER) + CAST(o_totalprice > e[3] AS INTEGER) AS bin, count(*) AS n FROM orders, q GROUP BY 1")
def bins_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.quantile_bins(load(spark, sf_dir, "orders"), "o_totalprice", 4).groupBy("bin").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'medium' WHEN p_size > 30 AND p_size <= 45 THEN 'large' END AS band FROM part")
def cut_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", reshape.cut(F.col("p_size"), [0, 10, 30, 45], ["small", "medium", "large"]).alias("band"))


@query("WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT event_id, CAST(coalesce(code, -1) AS INTEGER) AS code FROM events LEFT JOIN f USING (event_type)")
def factorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("kind", F.nullif("event_type", F.lit("view")))
    return reshape.factorize(e, "kind", ["event_id"]).select("event_id", F.col("code").cast("int").alias("code"))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", lines_of(F.col("text")).alias("line"))


@query("SELECT d.day, coalesce(n, 0) AS n FROM (SELECT strftime(unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM events) d LEFT JOIN (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) e USING (day)")
def resample_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.resample(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "day", {"n": F.count("*")})
    return out.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


# Windows


@query(
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, ntile(4) OVER w AS tile, round(percent_rank() OVER p, 6) AS pr, round(cume_dist() OVER p, 6) AS cd,
    rank() OVER p + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0 AS avg_rank
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)"""
)
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, p = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(p).cast("bigint").alias("rk"), F.dense_rank().over(p).cast("bigint").alias("dr"), F.ntile(4).over(w).cast("bigint").alias("tile"),
        F.round(F.percent_rank().over(p), 6).alias("pr"), F.round(F.cume_dist().over(p), 6).alias("cd"), windows.average_rank(["o_custkey"], "o_orderpriority").alias("avg_rank"),
    )


EVENTS_BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


def _by_user() -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query(f"SELECT event_id, lag(value) OVER w AS previous, lead(value, 2) OVER w AS after_next, round(value - lag(value) OVER w, 4) AS change, round(value / nullif(lag(value) OVER w, 0) - 1, 6) AS growth FROM events WINDOW w AS ({EVENTS_BY_USER})")
def win_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_user()
    previous = F.lag("value").over(w)
    return load(spark, sf_dir, "events").select("event_id", previous.alias("previous"), F.lead("value", 2).over(w).alias("after_next"), F.round(F.col("value") - previous, 4).alias("change"), F.round(F.col("value") / F.nullif(previous, F.lit(0.0)) - 1, 6).alias("growth"))


@query(f"SELECT event_id, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS top, count(*) OVER w AS n FROM events WINDOW w AS ({EVENTS_BY_USER} ROWS UNBOUNDED PRECEDING)")
def win_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_user().rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("total"), F.max("value").over(w).alias("top"), F.count("*").over(w).alias("n"))


@query("SELECT event_id, round(sum(value) OVER w, 3) AS total, max(value) OVER w AS top, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def scan_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values over all events in one order, without a key."""
    found = scanned(load(spark, sf_dir, "events"), ["ts", "event_id"], {"total": Scan("sum", F.col("value").cast("decimal(20,6)")), "top": Scan("max", F.col("value")), "n": Scan("count")})
    return found.select("event_id", F.round(F.col("total").cast("double"), 3).alias("total"), "top", "n")


@query(
    """SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS forward, first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward,
    last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS of_type FROM (SELECT *, CASE WHEN event_id % 50 = 0 THEN value END AS v FROM events)"""
)
def scan_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled from both sides over one order, and forward within the few event types."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.when(F.col("event_id") % 50 == 0, F.col("value")).alias("v"))
    filled = scanned(e, ["ts", "event_id"], {"forward": Scan("last", F.col("v")), "backward": Scan("next", F.col("v"))})
    return scanned(filled, ["ts", "event_id"], {"of_type": Scan("last", F.col("v"))}, ["event_type"]).select("event_id", "forward", "backward", "of_type")


@query(f"SELECT event_id, CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 4) END AS rolling FROM events WINDOW w AS ({EVENTS_BY_USER} ROWS 2 PRECEDING)")
def win_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_user().rowsBetween(-2, 0)
    return load(spark, sf_dir, "events").select("event_id", F.when(F.count("value").over(w) == 3, F.round(F.avg("value").over(w), 4)).alias("rolling"))


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_day FROM events")
def win_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("second").rangeBetween(-86400, 0)
    timed = load(spark, sf_dir, "events").withColumn("second", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', date_trunc('second', ts))"))
    return timed.select("event_id", F.count("*").over(w).alias("in_day"))


KNOWN = "CASE WHEN event_id % 3 = 0 THEN value END"


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS forward, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM (SELECT *, {KNOWN} AS v FROM events)")
def win_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select("event_id", windows.fill_forward("v", w).alias("forward"), windows.fill_backward("v", Window.partitionBy("user_id").orderBy(F.desc("event_id"))).alias("backward"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, {KNOWN} AS v FROM events), n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS t0,
    first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS t1 FROM e
    WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL OR v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (event_id - t0) / (t1 - t0) END, 6) AS filled FROM n"""
)
def win_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return e.select("event_id", F.round(windows.interpolated("v", "event_id", ["user_id"]), 6).alias("filled"))


@query(f"SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS ({EVENTS_BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_user().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, sf_dir, "events").select("event_id", F.first("value").over(w).alias("f"), F.last("value").over(w).alias("l"), F.nth_value("value", 2).over(w).alias("second"))


@query(
    """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
    SELECT a.user_id, a.event_id, a.value, round(sum(b.value * pow(0.7, a.n - b.n)) / sum(pow(0.7, a.n - b.n)) FILTER (b.value IS NOT NULL), 6) AS ewm FROM e a JOIN e b ON a.user_id IS NOT DISTINCT FROM b.user_id AND b.n <= a.n GROUP BY ALL"""
)
def win_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = windows.exponential_mean(load(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 0.3)
    return mean.withColumn("ewm", F.round("ewm", 6))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, max(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS top FROM lineitem")
def win_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return windows.over_groups(lines, ["l_suppkey"], ["l_quantity"], 2, 1, F.max("l_extendedprice"), "top").drop("l_quantity", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate) <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), *map(F.asc, ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"))]
    return windows.top_per_group(load(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS above FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) > 50")
def group_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    return load(spark, sf_dir, "customer").withColumn("n", F.count("*").over(w)).withColumn("above", F.round(F.col("c_acctbal") - F.avg("c_acctbal").over(w), 4)).where("n > 50").select("c_custkey", "above")


# Order and limits


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 10")
def sort_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").offset(10).limit(20).select("c_custkey", "c_acctbal")


@query("SELECT c_nationkey, max_by(c_name, c_acctbal) AS richest, min_by(c_name, c_acctbal) AS poorest FROM customer GROUP BY 1")
def arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal balances the one of least key, as DuckDB keeps the first row of a table; rows without a name or balance don't count."""
    known = F.col("c_acctbal").isNotNull() & F.col("c_name").isNotNull()
    most, least = F.when(known, F.struct("c_acctbal", -F.col("c_custkey"))), F.when(known, F.struct("c_acctbal", "c_custkey"))
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_name", most).alias("richest"), F.min_by("c_name", least).alias("poorest"))


# Sets


@query("SELECT c_name AS name, c_acctbal AS bal, NULL::BIGINT AS supplier FROM customer UNION ALL SELECT s_name, s_acctbal, s_suppkey FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("supplier"))
    return rel.union_all([c, s])


@query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT s_name FROM supplier")
def union_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.union_all([load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), load(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"))])


NATIONS = ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier")


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


@query(" UNION ".join(NATIONS))
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.union, _nations(spark, sf_dir)).distinct()


@query(" INTERSECT ALL ".join(NATIONS))
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersectAll(b)


@query(" EXCEPT ALL ".join(NATIONS))
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.exceptAll(b)


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part")
def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_brand", "p_type", "p_size").dropDuplicates()


@query("SELECT c_name, s_name FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) FULL JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) USING (i)")
def concat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = load(spark, sf_dir, "customer").select("c_custkey", "c_name"), load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return rel.beside(c, s, ["c_custkey"], ["s_suppkey"]).select("c_name", "s_name")
