"""Columns, missing values, duplicates and types."""

from __future__ import annotations

from burnish.operators.columns import drop_columns
from burnish.operators.dedupe import duplicate_report, remove_duplicates
from burnish.operators.dtypes import repair_types, type_report
from burnish.operators.missing import fill_missing, missing_report
from queries.registry import ORDER_COLUMNS, query, r, rounded, table, view

PART_KEY = "p_name,p_brand,p_type"


@query("r1_drop_columns", "select o_orderkey, o_orderstatus, o_totalprice, o_orderdate from orders")
def dropped(spark, sf_dir):
    return drop_columns(table(spark, sf_dir, "orders"), "o_custkey, o_orderpriority, no_such_column").df


def filled(strategy: dict[str, str], order_by: str | None = None, source: str = "orders_gaps", round_to: list[str] = ()):
    def run(spark, sf_dir):
        return rounded(fill_missing(view(spark, sf_dir, source), strategy, order_by).df, list(round_to))

    return run


def gaps_sql(price: str = "o_totalprice", priority: str = "o_orderpriority") -> str:
    return f"""select o_orderkey, o_custkey, o_orderstatus, {price} as o_totalprice, o_orderdate,
        {priority} as o_orderpriority from $orders_gaps"""


query(
    "m1_fill_mean",
    gaps_sql(r("coalesce(o_totalprice, (select avg(o_totalprice) from $orders_gaps))", 4)),
)(lambda spark, sf_dir: rounded(fill_missing(view(spark, sf_dir, "orders_gaps"), {"o_totalprice": "fill_mean"}).df, ["o_totalprice"], 4))
query(
    "m2_fill_median", gaps_sql("coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from $orders_gaps))")
)(filled({"o_totalprice": "fill_median"}))
query(
    "m3_fill_mode",
    gaps_sql(
        priority="""coalesce(o_orderpriority, (select o_orderpriority from $orders_gaps where o_orderpriority is not null
        group by o_orderpriority order by count(*) desc, o_orderpriority limit 1))"""
    ),
)(filled({"o_orderpriority": "fill_mode"}))
query("m4_fill_zero", gaps_sql("coalesce(o_totalprice, 0)", "coalesce(o_orderpriority, '0')"))(
    filled({"o_totalprice": "fill_zero", "o_orderpriority": "fill_zero"})
)


def along(direction: str) -> str:
    order = "event_id" if direction == "ffill" else "event_id desc"
    return f"""select event_id, ts, user_id, event_type, last_value(value ignore nulls) over
        (order by {order} rows between unbounded preceding and current row) as value from $events_gaps"""


query("m5_fill_bfill", along("bfill"))(filled({"value": "fill_bfill"}, "event_id", "events_gaps"))
query("m6_fill_ffill", along("ffill"))(filled({"value": "fill_ffill"}, "event_id", "events_gaps"))
query(
    "m1_fill_mean_nan",
    f"""with n as (select event_id, case when event_id % 7 = 0 or event_id % 5 < 2 then null else value end as value from events)
    select event_id, {r("coalesce(value, (select avg(value) from n))", 6)} as value from n""",
)(
    lambda spark, sf_dir: rounded(
        fill_missing(
            table(spark, sf_dir, "events", nan_as_null=False).selectExpr(
                "event_id",
                "case when event_id % 7 = 0 then double('NaN') when event_id % 5 < 2 then null else value end as value",
            ),
            {"value": "fill_mean"},
        ).df,
        ["value"],
    )
)
query(
    "m6_fill_ffill_two_keys",
    """select event_id, user_id, last_value(value ignore nulls) over (order by user_id, event_id
        rows between unbounded preceding and current row) as value from $events_gaps""",
)(
    lambda spark, sf_dir: fill_missing(
        view(spark, sf_dir, "events_gaps").select("event_id", "user_id", "value"), {"value": "fill_ffill"}, ["user_id", "event_id"]
    ).df
)
query(
    "m5_fill_bfill_text_key",
    """select c_name, last_value(acct ignore nulls) over (order by c_name desc
        rows between unbounded preceding and current row) as acct
    from (select c_name, case when c_custkey % 3 = 0 then null else c_acctbal end as acct from customer)""",
)(
    lambda spark, sf_dir: fill_missing(
        table(spark, sf_dir, "customer").selectExpr("c_name", "case when c_custkey % 3 = 0 then null else c_acctbal end as acct"),
        {"acct": "fill_bfill"},
        "c_name",
    ).df
)
query("m7_drop_rows", "select * from $orders_gaps where o_orderpriority is not null")(
    filled({"o_orderpriority": "drop_rows"})
)
query("m8_drop_column", f"select {', '.join(n for n in ORDER_COLUMNS if n != 'o_totalprice')} from $orders_gaps")(
    filled({"o_totalprice": "drop_column"})
)
query(
    "m9_fill_interpolate",
    f"""with placed as (select *, row_number() over (order by event_id) as n from $events_gaps),
    points as (select *, case when value is not null then n end as p from placed),
    around as (select *,
        last_value(value ignore nulls) over up as v0, last_value(p ignore nulls) over up as p0,
        last_value(value ignore nulls) over down as v1, last_value(p ignore nulls) over down as p1 from points
        window up as (order by n rows between unbounded preceding and current row),
            down as (order by n desc rows between unbounded preceding and current row)),
    line as (select *, case when v0 is null then null when v1 is null or p1 = p0 then v0
        else v0 + (v1 - v0) / (p1 - p0) * (n - p0) end as x from around)
    select event_id, ts, user_id, event_type, {r("x")} as value from line""",
)(filled({"value": "fill_interpolate"}, "event_id", "events_gaps", ["value"]))
query("m10_fill_custom", gaps_sql("coalesce(o_totalprice, -1.5)", "coalesce(o_orderpriority, 'UNKNOWN')"))(
    filled({"o_totalprice": "fill_custom:-1.5", "o_orderpriority": "fill_custom:UNKNOWN"})
)


@query(
    "m11_missing_report",
    """with kept as (select * from $orders_gaps where o_orderpriority is not null)
    select 'o_totalprice' as "column", (select count(*) from $orders_gaps where o_totalprice is null) as "before",
        0::bigint as "after"
    union all select 'o_orderpriority', (select count(*) from $orders_gaps where o_orderpriority is null), 0
    union all select '(rows)', (select count(*) from $orders_gaps), (select count(*) from kept)""",
)
def report_missing(spark, sf_dir):
    gaps = view(spark, sf_dir, "orders_gaps")
    after = fill_missing(gaps, {"o_orderpriority": "drop_rows", "o_totalprice": "fill_median"}).df
    return missing_report(gaps, after)


def part_sql(order: str) -> str:
    return f"""select * exclude (n) from (select *, row_number() over
        (partition by {PART_KEY} order by p_partkey {order}) as n from part) where n = 1"""


def deduped(strategy: str):
    return lambda spark, sf_dir: remove_duplicates(table(spark, sf_dir, "part"), strategy, PART_KEY, "p_partkey").df


query("dd1_keep_first", part_sql("asc"))(deduped("keep_first"))
query("dd2_keep_last", part_sql("desc"))(deduped("keep_last"))
query(
    "dd3_drop_all_key",
    f"select * exclude (n) from (select *, count(*) over (partition by {PART_KEY}) as n from part) where n = 1",
)(deduped("drop_all"))


@query("dd3_drop_all_rows", "select * from lineitem where l_orderkey % 10 <> 0")
def drop_all_rows(spark, sf_dir):
    return remove_duplicates(view(spark, sf_dir, "lineitem_dup"), "drop_all").df


@query("dd1_keep_first_rows", "select distinct * from $lineitem_dup")
def keep_first_rows(spark, sf_dir):
    return remove_duplicates(view(spark, sf_dir, "lineitem_dup"), "keep_first").df


@query(
    "dd4_duplicate_report",
    f"""with k as (select count(*) as n from part group by {PART_KEY})
    select 'keep_first' as strategy, sum(n - 1)::bigint as "found", sum(n - 1)::bigint as removed,
        count(*) as rows_after, sum(n - 1)::bigint as rows_removed from k
    union all select 'drop_all', sum(n - 1)::bigint, sum(n - 1)::bigint, count(*) filter (where n = 1),
        (sum(n) - count(*) filter (where n = 1))::bigint from k""",
)
def report_duplicates(spark, sf_dir):
    from pyspark.sql import functions as F

    part = table(spark, sf_dir, "part")
    reports = [duplicate_report(part, s, PART_KEY).withColumn("strategy", F.lit(s)) for s in ("keep_first", "drop_all")]
    return reports[0].unionByName(reports[1])


def repaired(**fixes: str):
    return lambda spark, sf_dir: repair_types(view(spark, sf_dir, "customer_dirty"), fixes).df.select("c_custkey", *fixes)


query("t1_int", "select c_custkey, try_cast(trim(key_text) as bigint) as key_text, acct_text from $customer_dirty")(
    repaired(key_text="int", acct_text="int")
)
query("t2_float", "select c_custkey, try_cast(acct_text as double) as acct_text from $customer_dirty")(
    repaired(acct_text="float")
)


@query(
    "t3_str_and_category",
    "select cast(c_custkey as varchar) as c_custkey, c_mktsegment, cast(c_nationkey as varchar) as c_nationkey from customer",
)
def as_text(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return repair_types(customer, {"c_custkey": "str", "c_mktsegment": "category", "c_nationkey": "str"}).df


query(
    "t4_bool",
    """select c_custkey, case when flag_text = 'yes' then true when flag_text = 'False' then false end as flag_text
    from $customer_dirty""",
)(repaired(flag_text="bool"))


@query(
    "t5_datetime",
    "select o_orderkey, try_strptime(date_text, '%Y-%m-%d') as date_text from $orders_text_dates",
)
def as_datetime(spark, sf_dir):
    dates = view(spark, sf_dir, "orders_text_dates").select("o_orderkey", "date_text")
    return repair_types(dates, {"date_text": "datetime"}).df


SHAPES = """select o_orderkey, substr(cast(o_orderdate as string), 1, 10) as d, case o_orderkey % 9
    when 0 then substr(cast(o_orderdate as string), 1, 10) || 'T03:04:05Z'
    when 1 then substr(cast(o_orderdate as string), 1, 10) || ' 3:04'
    when 2 then replace(substr(cast(o_orderdate as string), 1, 10), '-', '')
    when 3 then substr(cast(o_orderdate as string), 1, 10) || 'T03:04:05.123456789+02:00'
    when 4 then substr(cast(o_orderdate as string), 6, 2) || '/' || substr(cast(o_orderdate as string), 9, 2) || '/'
        || substr(cast(o_orderdate as string), 1, 4)
    when 5 then substr(cast(o_orderdate as string), 9, 2) || ' FEB ' || substr(cast(o_orderdate as string), 1, 4)
    when 6 then 'March ' || substr(cast(o_orderdate as string), 9, 1) || ', ' || substr(cast(o_orderdate as string), 1, 4)
    when 7 then substr(cast(o_orderdate as string), 1, 10) || ' 23:59:59-0530'
    else '2023-13-45 or so' end as date_text from {orders}"""


@query(
    "t5_datetime_shapes",
    f"""select o_orderkey, case o_orderkey % 9
        when 0 then cast(d as timestamp) + interval 3 hour + interval 4 minute + interval 5 second
        when 1 then cast(d as timestamp) + interval 3 hour + interval 4 minute
        when 2 then cast(d as timestamp)
        when 3 then cast(d as timestamp) + interval 1 hour + interval 4 minute + interval 5123456 microsecond
        when 4 then cast(d as timestamp)
        when 5 then try_strptime(substr(d, 9, 2) || ' 02 ' || substr(d, 1, 4), '%d %m %Y')
        when 6 then try_strptime(substr(d, 9, 1) || ' 03 ' || substr(d, 1, 4), '%d %m %Y')
        when 7 then cast(d as timestamp) + interval 29 hour + interval 29 minute + interval 59 second
        end as date_text from ({SHAPES.format(orders="orders")})""",
)
def many_shapes(spark, sf_dir):
    dates = spark.sql(SHAPES, orders=table(spark, sf_dir, "orders")).select("o_orderkey", "date_text")
    return repair_types(dates, {"date_text": "datetime"}).df


query(
    "t6_auto",
    "select c_custkey, cast(nation_text as bigint) as nation_text, acct_text from $customer_dirty",
)(repaired(nation_text="auto", acct_text="auto"))


@query(
    "t7_type_report",
    """select 'acct_text' as "column", 'string' as from_type, 'double' as to_type,
        count(*) filter (where try_cast(acct_text as double) is null) as nulls_after, null::varchar as "error"
    from $customer_dirty
    union all select 'key_text', 'string', 'bigint', count(*) filter (where key_text is null), null from $customer_dirty
    union all select 'flag_text', 'string', 'boolean', count(*) filter (where flag_text = '?'), null from $customer_dirty
    """,
)
def report_types(spark, sf_dir):
    dirty = view(spark, sf_dir, "customer_dirty")
    fixes = {"acct_text": "float", "key_text": "int", "flag_text": "bool"}
    return type_report(dirty, repair_types(dirty, fixes), list(fixes))
