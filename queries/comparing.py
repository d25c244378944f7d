"""Before and after."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators import compare as k
from burnish.operators.encode import encode
from burnish.operators.missing import fill_missing
from burnish.operators.outliers import treat_outliers
from queries.profiling import LINE_COLUMNS
from queries.registry import query, table, view

LIMITS = "(select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)"
INSIDE = "value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)"


def orders_pair(spark, sf_dir):
    """The orders with gaps, and the same filled, encoded and without the incomplete rows."""
    before = view(spark, sf_dir, "orders_gaps")
    after = fill_missing(before, {"o_totalprice": "drop_rows", "o_custkey": "drop_column"}).df
    return before, encode(after, {"o_orderpriority": "ordinal:5-LOW,3-MEDIUM", "o_orderstatus": "onehot"}).df


@query(
    "c1_shape_delta",
    """select count(*) as rows_before, 6 as columns_before, count(o_totalprice) as rows_after, 6 as columns_after
    from $orders_gaps""",
)
def shapes(spark, sf_dir):
    return k.shape_delta(*orders_pair(spark, sf_dir))


@query(
    "c2_schema_diff",
    """with k("column", status, type_before, type_after) as (values
        ('o_orderkey', 'kept', 'bigint', 'bigint'), ('o_custkey', 'removed', 'bigint', null),
        ('o_orderstatus', 'removed', 'string', null), ('o_totalprice', 'kept', 'double', 'double'),
        ('o_orderdate', 'kept', 'timestamp_ntz', 'timestamp_ntz'), ('o_orderpriority', 'retyped', 'string', 'bigint'),
        ('o_orderstatus_O', 'added', null, 'int'), ('o_orderstatus_P', 'added', null, 'int')),
    b as (select count(*) - count(o_totalprice) as price, count(*) - count(o_orderpriority) as priority from $orders_gaps),
    a as (select count(*) filter (where o_orderpriority is null or o_orderpriority not in ('5-LOW', '3-MEDIUM')) as coded
        from $orders_gaps where o_totalprice is not null)
    select "column", status, type_before, type_after,
        case when type_before is null then null when "column" = 'o_totalprice' then price
            when "column" = 'o_orderpriority' then priority else 0 end as nulls_before,
        case when type_after is null then null when "column" = 'o_orderpriority' then coded else 0 end as nulls_after
    from k, a, b""",
)
def schemas(spark, sf_dir):
    return k.schema_diff(*orders_pair(spark, sf_dir))


@query(
    "c2_output_types",
    """select "type", "columns" from (values ('bigint', 2), ('double', 1), ('timestamp_ntz', 1), ('int', 2))
        as t("type", "columns") where (select count(*) from orders) > 0""",
)
def types(spark, sf_dir):
    return k.output_types(orders_pair(spark, sf_dir)[1])


@query(
    "c3_null_totals",
    """select (select 2 * count(*) - count(o_totalprice) - count(o_orderpriority) from $orders_gaps) as nulls_before,
        (select count(*) - count(o_orderpriority) from $orders_gaps where o_totalprice is not null) as nulls_after""",
)
def nulls(spark, sf_dir):
    before = view(spark, sf_dir, "orders_gaps")
    totals = k.null_totals(before, fill_missing(before, {"o_totalprice": "drop_rows"}).df)
    return totals.select(*[F.col(n).cast("long").alias(n) for n in totals.columns])


@query(
    "c4_duplicate_totals",
    f"""select (select sum(n - 1)::bigint from (select count(*) as n from $lineitem_dup group by {", ".join(LINE_COLUMNS)}))
        as duplicates_before, (select count(*) - count(*) from lineitem) as duplicates_after""",
)
def duplicates(spark, sf_dir):
    return k.duplicate_totals(view(spark, sf_dir, "lineitem_dup"), table(spark, sf_dir, "lineitem"))


def shifted(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return k.stat_shifts(events, treat_outliers(events, {"value": "remove_iqr"}).df)


def shift_sql(name: str, fn: str, alias: str) -> str:
    return f"""select '{name}' as "column", round((select {fn}({name}) from events, {LIMITS} where {INSIDE})
        - (select {fn}({name}) from events), 4) as {alias}"""


NUMBERS = ["event_id", "user_id", "value"]

query("c5_mean_shift", " union all ".join(shift_sql(n, "avg", "mean_shift") for n in NUMBERS))(
    lambda spark, sf_dir: shifted(spark, sf_dir).drop("std_shift")
)
query("c6_std_shift", " union all ".join(shift_sql(n, "stddev_samp", "std_shift") for n in NUMBERS))(
    lambda spark, sf_dir: shifted(spark, sf_dir).drop("mean_shift")
)
