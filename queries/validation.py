"""Checks and the quality gate."""

from __future__ import annotations

from burnish.operators.features import add_features
from burnish.operators.missing import fill_missing
from burnish.operators.validate import degenerate_features, quality_gate, row_loss, validate, validation_summary
from queries.profiling import LINE_COLUMNS
from queries.registry import ORDER_COLUMNS, query, table, view

LISTED = "coalesce(string_agg(n || '=' || v, ', ' order by n), '')"


def checked(source: str, **checks):
    def run(spark, sf_dir):
        given = source in ("orders", "lineitem", "part")
        return validate(table(spark, sf_dir, source) if given else view(spark, sf_dir, source), checks)

    return run


def bad_nulls(source: str, columns: list[str], value: str, having: str) -> str:
    return " union all ".join(f"select '{n}' as n, {value.replace('{c}', n)} as v from {source} having {having.replace('{c}', n)}" for n in columns)


NULLS = "count(*) filter (where {c} is null)"
NULL_PCT = f"round({NULLS} * 100.0::double / count(*), 2)"

query(
    "v1_no_nulls",
    f"""select 'no_nulls' as check_name, count(*) = 0 as passed, {LISTED} as detail
    from ({bad_nulls("$orders_gaps", ORDER_COLUMNS, NULLS, NULLS + " > 0")})""",
)(checked("orders_gaps", no_nulls=True))
query(
    "v2_max_null_pct",
    f"""select 'max_null_pct' as check_name, count(*) = 0 as passed, {LISTED} as detail
    from ({bad_nulls("$orders_gaps", ORDER_COLUMNS, NULL_PCT, NULL_PCT + " > 10")})""",
)(checked("orders_gaps", max_null_pct=10))
query(
    "v3_no_duplicates",
    f"""select 'no_duplicates' as check_name, sum(n - 1) = 0 as passed, 'duplicates=' || sum(n - 1)::bigint as detail
    from (select count(*) as n from $lineitem_dup group by {", ".join(LINE_COLUMNS)})""",
)(checked("lineitem_dup", no_duplicates=True))
query(
    "v4_min_rows",
    """select 'min_rows' as check_name, count(*) >= 1000000000 as passed, 'expected=1000000000, actual=' || count(*) as detail
    from lineitem""",
)(checked("lineitem", min_rows=1_000_000_000))
query(
    "v5_expected_columns",
    """select 'expected_columns' as check_name, count(*) = 0 as passed, coalesce(string_agg(n, ', ' order by n), '') as detail
    from (values ('p_partkey'), ('p_weight'), ('p_name'), ('p_colour')) w(n)
    where n not in (select column_name from (describe part))""",
)(checked("part", expected_columns="p_partkey, p_weight, p_name, p_colour"))
query(
    "v6_no_infinite",
    """select 'no_infinite' as check_name, count(*) = 0 as passed,
        case when count(*) > 0 then 'value=' || count(*) else '' end as detail from $events_inf where isinf(value)""",
)(checked("events_inf", no_infinite=True))
query(
    "v7_target_column",
    f"""select 'target_column' as check_name, {NULLS.replace("{c}", "o_orderpriority")} = 0 as passed,
        'nulls=' || {NULLS.replace("{c}", "o_orderpriority")} as detail from $orders_gaps""",
)(checked("orders_gaps", target_column="o_orderpriority"))
query(
    "v8_numeric_only",
    """select 'numeric_only' as check_name, count(*) = 0 as passed, coalesce(string_agg(n, ', ' order by n), '') as detail
    from (select column_name as n, column_type as t from (describe select * from $orders_gaps))
    where t not in ('BIGINT', 'INTEGER', 'DOUBLE') and n <> 'o_orderpriority'
    union all select 'target_column', count(*) filter (where o_orderpriority is null) = 0,
        'nulls=' || count(*) filter (where o_orderpriority is null) from $orders_gaps""",
)(checked("orders_gaps", numeric_only=True, target_column="o_orderpriority"))


@query(
    "v9_summary",
    """with c as (select case column_type when 'BIGINT' then 'bigint' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string'
            when 'TIMESTAMP' then 'timestamp_ntz' else lower(column_type) end as t, count(*) as n
        from (describe select * from $orders_gaps) group by 1),
    g as (select count(*) as n, count(*) filter (where o_totalprice is null or o_orderpriority is null or o_orderkey is null
        or o_custkey is null or o_orderstatus is null or o_orderdate is null) as missing from $orders_gaps)
    select g.missing = 0 and g.n >= 10 as all_passed, g.n as "rows", (select sum(n) from c)::int as "columns",
        (select string_agg(t || '=' || n, ', ' order by t) from c) as types from g""",
)
def summary(spark, sf_dir):
    return validation_summary(view(spark, sf_dir, "orders_gaps"), {"no_nulls": True, "min_rows": 10})


@query(
    "v10_row_loss",
    """select a as rows_before, b as rows_after, round((a - b)::double / a * 100, 2) as lost_pct, (a - b)::double / a <= 0.2 as passed
    from (select count(*) as a, count(o_totalprice) as b from $orders_gaps)""",
)
def loss(spark, sf_dir):
    gaps = view(spark, sf_dir, "orders_gaps")
    return row_loss(gaps, fill_missing(gaps, {"o_totalprice": "drop_rows"}).df)


@query(
    "v11_degenerate_features",
    """select 'flat' as "column", count(distinct l_quantity * 0) as "distinct" from lineitem
    union all select 'nothing', count(l_quantity / nullif(l_quantity * 0, 0)) from lineitem""",
)
def degenerate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    made = add_features(
        lines, {"flat": "formula:l_quantity * 0", "nothing": "formula:1 / (l_quantity * 0)", "fine": "log:l_quantity"}
    )
    return degenerate_features(lines, made.df)


@query(
    "v12_quality_gate",
    f"""with d as (select sum(n - 1)::bigint as x from (select count(*) as n from $lineitem_dup group by {", ".join(LINE_COLUMNS)}))
    select case when x > 0 then 'FAIL' else 'PASS' end as verdict, (x > 0)::int as failed,
        case when x > 0 then 'no_duplicates: duplicates=' || x else '' end as issues from d""",
)
def gate(spark, sf_dir):
    lines = view(spark, sf_dir, "lineitem_dup")
    checks = {
        "no_nulls": True, "no_duplicates": True, "expected_columns": "l_orderkey,l_tax", "no_infinite": True,
        "target_column": "l_returnflag",
    }
    return quality_gate(table(spark, sf_dir, "lineitem"), lines, checks)


@query(
    "v12_quality_gate_pass",
    """with p as (select count(*) as n, count(*) - count(distinct p_partkey) as copies,
        count(*) filter (where isinf(p_retailprice)) as infinite, count(*) filter (where p_brand is null) as missing from part)
    select case when copies + infinite + missing = 0 and n >= 10 then 'PASS' else 'FAIL' end as verdict,
        ((copies > 0)::int + (infinite > 0)::int + (missing > 0)::int + (n < 10)::int) as failed, '' as issues from p""",
)
def gate_passes(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return quality_gate(parts, parts, {"no_duplicates": True, "no_infinite": True, "min_rows": 10, "target_column": "p_brand"})


@query(
    "v12_quality_gate_issues",
    """with b as (select count(*) as n from events),
    a as (select count(*) as n, count(*) filter (where isinf(value)) as infinite,
        count(*) filter (where event_type is null) as missing from
        (select case when event_id % 9 = 0 then null else event_type end as event_type, value from $events_inf where event_id % 3 = 0)),
    i as (select 'no_infinite: value=' || infinite as issue from a where infinite > 0
        union all select 'no_nulls: event_type=' || missing from a where missing > 0
        union all select 'row_loss: lost_pct=' || round((b.n - a.n)::double / b.n * 100, 2) from a, b where b.n - a.n > 0.2 * b.n
        union all select 'target_column: nulls=' || missing from a where missing > 0
        union all select 'min_rows: expected=1000000000, actual=' || n from a where n < 1000000000)
    select 'FAIL' as verdict, count(*)::int as failed, string_agg(issue, '; ' order by issue) as issues from i""",
)
def gate_fails(spark, sf_dir):
    after = view(spark, sf_dir, "events_inf").where("event_id % 3 = 0").selectExpr(
        "event_id", "case when event_id % 9 = 0 then null else event_type end as event_type", "value"
    )
    checks = {"no_nulls": True, "no_infinite": True, "target_column": "event_type", "min_rows": 1_000_000_000}
    return quality_gate(table(spark, sf_dir, "events"), after, checks)
