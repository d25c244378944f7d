"""Whole plans and custom steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.operators.validate import results_frame
from burnish.plans.plan import Plan
from burnish.plans.prepare import custom_batches, custom_step, prepare
from queries.registry import query, r, rounded, table, view

PLAN = {
    "summary": "Orders with their customers, made ready for a model of the order value.",
    "target": "o_totalprice",
    "drop": ["o_orderstatus"],
    "duplicates": "drop_keep_first",
    "duplicate_key": "o_orderkey",
    "types": {"balance_text": "float"},
    "missing": {"o_totalprice": "drop_rows", "balance_text": "fill_median", "o_orderpriority": "fill_mode"},
    "dates": {"date_text": "year,month,dayofweek,is_weekend"},
    "text": {"c_name": "length_and_words"},
    "outliers": {"balance_text": "clip_iqr:0.5"},
    "encode": {"o_orderpriority": "label_encode", "c_mktsegment": "frequency_encode"},
    "features": {"per_letter": "ratio:balance_text,c_name_length", "rich": "threshold_above:balance_text,5000"},
    "scale": {"balance_text": "standard", "per_letter": "minmax"},
    "checks": {"min_rows": 10, "target_column": "o_totalprice", "numeric_only": True, "no_infinite": True},
    "order_by": "o_orderkey",
}
MEASURES = ["o_totalprice", "balance_text", "c_mktsegment", "per_letter"]


def raw_orders(spark, sf_dir) -> DataFrame:
    """Orders with gaps, a tenth of them twice, joined to their customers; amounts and dates are dirty text."""
    orders = view(spark, sf_dir, "orders_gaps").withColumn(
        "date_text",
        F.when(F.col("o_orderkey") % 13 == 0, "not a date").otherwise(F.substring(F.col("o_orderdate").cast("string"), 1, 10)),
    )
    twice = orders.unionByName(orders.where(F.col("o_orderkey") % 10 == 0))
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        F.when(F.col("c_custkey") % 9 == 0, "N/A").otherwise(F.col("c_acctbal").cast("string")).alias("balance_text"),
    )
    joined = twice.join(customer, twice["o_custkey"] == customer["c_custkey"])
    return joined.drop("o_custkey", "c_custkey", "o_orderdate")


RAW_SQL = """raw as (select o_orderkey, o_totalprice, o_orderpriority, c_name, c_mktsegment,
        case when o_orderkey % 13 = 0 then null else o_orderdate end as d,
        case when c_custkey % 9 = 0 then null else c_acctbal end as b
    from $orders_gaps join customer on o_custkey = c_custkey where o_totalprice is not null)"""
PLAN_SQL = f"""with {RAW_SQL},
    filled as (select o_orderkey, o_totalprice, c_name, c_mktsegment, d,
        coalesce(b, (select quantile_cont(b, 0.5) from raw)) as b,
        coalesce(o_orderpriority, (select o_orderpriority from raw where o_orderpriority is not null
            group by o_orderpriority order by count(*) desc, o_orderpriority limit 1)) as p from raw),
    q as (select quantile_cont(b, 0.25) as q1, quantile_cont(b, 0.75) as q3 from filled),
    clipped as (select * exclude (b, q1, q3), greatest(least(b, q3 + 0.5 * (q3 - q1)), q1 - 0.5 * (q3 - q1)) as b
        from filled, q),
    codes as (select p, row_number() over (order by p) - 1 as code from (select distinct p from clipped)),
    shares as (select c_mktsegment, count(*) / (sum(count(*)) over ()) as share from clipped group by c_mktsegment),
    made as (select *, length(c_name)::int as len, b / length(c_name) as per_letter from clipped),
    m as (select avg(b) as mean, stddev_pop(b) as std, min(per_letter) as low, max(per_letter) as high from made)
    select o_orderkey, {r("o_totalprice")} as o_totalprice, {r("((b - mean) / std)")} as balance_text,
        year(d)::int as date_text_year, month(d)::int as date_text_month, (isodow(d) - 1)::int as date_text_dayofweek,
        coalesce((isodow(d) >= 6)::int, 0) as date_text_is_weekend, len as c_name_length,
        len(regexp_extract_all(c_name, '\\S+'))::int as c_name_word_count, code as o_orderpriority,
        {r("share")} as c_mktsegment, {r("((per_letter - low) / (high - low))")} as per_letter,
        (b > 5000)::int as rich
    from made join codes using (p) join shares using (c_mktsegment), m"""


@query("g1_end_to_end", PLAN_SQL)
def end_to_end(spark, sf_dir):
    return rounded(prepare(raw_orders(spark, sf_dir), Plan.from_dict(PLAN), materialize=True).df, MEASURES)


@query(
    "g1_end_to_end_checks",
    f"""with {RAW_SQL}
    select 'min_rows' as check_name, count(*) >= 10 as passed, 'expected=10, actual=' || count(*) as detail from raw
    union all select 'target_column', count(*) >= 0, 'nulls=0' from raw
    union all select 'numeric_only', count(*) >= 0, '' from raw
    union all select 'no_infinite', count(*) >= 0, '' from raw""",
)
def end_to_end_checks(spark, sf_dir):
    prepared = prepare(raw_orders(spark, sf_dir), Plan.from_dict(PLAN))
    return results_frame(prepared.df, prepared.checks)


RECORD = {
    "plan_summary": PLAN["summary"],
    "target_column": "o_totalprice",
    "columns_to_drop": "o_orderstatus:known only after the order, when it is too late",
    "missing_value_strategy": "o_totalprice:drop_rows,balance_text:fill_median,o_orderpriority:fill_mode",
    "encoding_strategy": "o_orderpriority:label_encode,c_mktsegment:frequency_encode",
    "scaling_strategy": "balance_text:standard,per_letter:minmax",
    "outlier_strategy": "balance_text:clip_iqr:0.5",
    "feature_engineering": "per_letter:ratio:balance_text,c_name_length,rich:threshold_above:balance_text,5000",
    "text_processing": "c_name:length_and_words",
    "datetime_processing": "date_text:year,month,dayofweek,is_weekend",
    "duplicate_strategy": "drop_keep_first",
    "final_validation_checks": "min_rows:10,target_column:o_totalprice,numeric_only,no_infinite",
    "step_by_step_order": "drop_columns,drop_duplicates,fix_types,handle_missing,datetime,text,outliers,encode,feature_engineering,scaling,validation",
}


@query("g1_plan_of_texts", PLAN_SQL)
def plan_of_texts(spark, sf_dir):
    """The same plan as a record of texts."""
    plan = Plan.from_dict({**RECORD, "duplicate_key": "o_orderkey", "types": "balance_text:float", "order_by": "o_orderkey"})
    return rounded(prepare(raw_orders(spark, sf_dir), plan, materialize=True).df, MEASURES)


def metrics_sql() -> str:
    widths = [
        ("drop", "a", 8, "a", 7), ("duplicates", "a", 7, "k", 7), ("types", "k", 7, "k", 7), ("missing", "k", 7, "c", 7),
        ("dates", "c", 7, "c", 10), ("text", "c", 10, "c", 11), ("outliers", "c", 11, "c", 11),
        ("encode", "c", 11, "c", 11), ("features", "c", 11, "c", 13), ("scale", "c", 13, "c", 13),
        ("validate", "c", 13, "c", 13),
    ]
    counts = """n as (select count(*) filter (where o_orderkey % 10 = 0) + count(*) as a, count(*) as k,
        count(o_totalprice) as c from $orders_gaps join customer on o_custkey = c_custkey)"""
    return f"with {counts} " + " union all ".join(
        f"select '{s}' as step, {x} as rows_before, {i} as columns_before, {y} as rows_after, {j} as columns_after from n"
        for s, x, i, y, j in widths
    )


@query("g2_step_metrics", metrics_sql())
def step_metrics(spark, sf_dir):
    return prepare(raw_orders(spark, sf_dir), Plan.from_dict(PLAN), metrics=True).metrics.drop("detail")


@query(
    "u2_custom_step",
    f"select l_orderkey, l_linenumber, {r('(l_extendedprice * (1 - l_discount))')} as l_net from lineitem",
)
def custom(spark, sf_dir):
    def net(df: DataFrame) -> DataFrame:
        value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return df.select("l_orderkey", "l_linenumber", value.alias("l_net"))

    return rounded(custom_step(table(spark, sf_dir, "lineitem"), net), ["l_net"])


@query(
    "u2_custom_pandas_step",
    f"select l_orderkey, l_linenumber, {r('(l_extendedprice * (1 + l_tax))')} as l_gross from lineitem",
)
def custom_pandas(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")

    def gross(batch):
        batch["l_gross"] = batch["l_extendedprice"] * (1 + batch["l_tax"])
        return batch[["l_orderkey", "l_linenumber", "l_gross"]]

    out = custom_batches(lines, gross, "l_orderkey long, l_linenumber int, l_gross double")
    return rounded(out, ["l_gross"])
