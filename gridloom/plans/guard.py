"""Read-only SQL: a statement runs only if everything in its parsed plan is on a list."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

# What a query may consist of.
NODES = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Union Intersect Except Join SubqueryAlias UnresolvedRelation UnresolvedWith CTE
    UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedInlineTable OneRowRelation Pivot Unpivot Window WithWindowDefinition Generate LateralJoin View
    UnresolvedTableValuedFunction LocalRelation Tail Sample RepartitionByExpression Deduplicate UnresolvedStar""".split()
)
FUNCTIONS = frozenset(
    """abs acos asin atan atan2 ceil ceiling cos cot degrees exp floor ln log log10 log2 mod pmod pi pow power radians rand round bround sign signum sin sqrt tan try_divide
    coalesce if ifnull nullif nvl nvl2 greatest least isnull isnotnull isnan nanvl case when cast try_cast
    concat concat_ws length char_length character_length lower upper initcap trim ltrim rtrim btrim lpad rpad left right substring substr replace split reverse repeat instr locate position
    contains startswith endswith like ilike rlike regexp regexp_like regexp_extract regexp_extract_all regexp_replace regexp_count format_number translate ascii char chr md5 sha2 sha1 hash xxhash64 base64 hex
    count count_if sum avg mean min max first first_value last last_value any_value median percentile percentile_approx approx_percentile approx_count_distinct stddev stddev_samp stddev_pop std
    variance var_samp var_pop skewness kurtosis corr covar_samp covar_pop mode max_by min_by collect_list collect_set array_agg every some any bool_and bool_or grouping grouping_id string_agg listagg
    row_number rank dense_rank ntile percent_rank cume_dist lag lead nth_value
    year quarter month day dayofmonth dayofweek dayofyear weekday weekofyear hour minute second date_trunc trunc date_add date_sub date_diff datediff months_between add_months last_day next_day
    to_date to_timestamp try_to_timestamp try_to_date date_format current_date current_timestamp now make_date make_timestamp unix_timestamp from_unixtime extract date_part window session_window date timestamp
    array map struct named_struct explode explode_outer posexplode size cardinality element_at get array_contains array_distinct array_sort sort_array array_join array_max array_min array_union array_intersect
    array_except arrays_overlap arrays_zip flatten sequence slice transform filter aggregate exists forall zip_with map_keys map_values map_from_arrays map_entries map_concat map_filter
    get_json_object json_tuple from_json to_json schema_of_json parse_json variant_get width_bucket range int bigint double float string boolean decimal stack inline""".split()
)


class NotAllowed(ValueError):
    """The statement holds something that is not on the lists."""


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan, views: set[str], ctes: set[str]) -> None:
    name = plan.getClass().getSimpleName()
    if name == "UnresolvedWith":
        own = _each(plan.cteRelations())
        ctes = ctes | {str(c._1()).lower() for c in own}
        for c in own:
            _walk(c._2(), views, ctes)
    if name not in NODES:
        raise NotAllowed(f"{name} is not allowed in a query")
    if name == "UnresolvedRelation":
        parts = _each(plan.multipartIdentifier())
        if len(parts) != 1 or str(parts[0]).lower() not in views | ctes:
            raise NotAllowed(f"no such table: {'.'.join(map(str, parts))}")
    if name == "UnresolvedTableValuedFunction":
        _function([str(x) for x in _each(plan.name())])
    for e in _each(plan.expressions()):
        _expression(e, views, ctes)
    for child in _each(plan.children()):
        _walk(child, views, ctes)


def _function(parts: list[str]) -> None:
    if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
        raise NotAllowed(f"function {'.'.join(parts)} is not allowed")


def _expression(e, views: set[str], ctes: set[str]) -> None:
    name = e.getClass().getSimpleName()
    if name == "UnresolvedFunction":
        _function([str(x) for x in _each(e.nameParts())])
    if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _walk(e.plan(), views, ctes)
    elif name == "InSubquery":
        _walk(e.query().plan(), views, ctes)
    for child in _each(e.children()):
        _expression(child, views, ctes)


def checked(spark: SparkSession, sql: str, views: list[str]) -> None:
    """Raises :class:`NotAllowed` unless the statement only reads ``views`` by functions that are on the list."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise NotAllowed(f"this is no SQL query: {str(e).splitlines()[0]}") from e
    _walk(plan, {v.lower() for v in views}, set())


def run(spark: SparkSession, sql: str, views: list[str]) -> DataFrame:
    """The checked query's DataFrame."""
    checked(spark, sql, views)
    return spark.sql(sql)


def run_within(spark: SparkSession, sql: str, views: list[str], seconds: float = 5.0) -> list:
    """The rows of a checked query; its jobs are cancelled at the deadline."""
    return rows_within(run(spark, sql, views), seconds)


def rows_within(df: DataFrame, seconds: float) -> list:
    """The rows of ``df``; its jobs are cancelled at the deadline."""
    return within(df.sparkSession, seconds, df.collect)


def within(spark: SparkSession, seconds: float, work: Callable[[], T]) -> T:
    """What ``work`` gives; the jobs it starts are cancelled at the deadline, so it fails then."""
    context, tag, done = spark.sparkContext, f"gridloom-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        wait = seconds
        while not done.wait(wait):  # again and again, as the next job may not have begun
            context.cancelJobsWithTag(tag)
            wait = 0.3

    watcher = threading.Thread(target=stop, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        return work()
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)


def calculate(spark: SparkSession, expression: str, seconds: float = 5.0) -> object:
    """The value of an arithmetic expression: a guarded query without a table."""
    rows = run_within(spark, f"SELECT ({expression}) AS value", [], seconds)
    if len(rows) != 1 or len(rows[0]) != 1:
        raise NotAllowed("this is no single expression")
    return rows[0][0]
