"""Scaling and outliers."""

from __future__ import annotations

from burnish.operators.outliers import outlier_report, treat_outliers
from burnish.operators.power import FIRST_STEP, HALF_WIDTH, ROUNDS
from burnish.operators.scale import scale, scaling_report
from queries.registry import query, r, rounded, table, view

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def scaled(method: str):
    def run(spark, sf_dir):
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *PRICES)
        return rounded(scale(lines, {"__all_numeric__": method}, "l_orderkey,l_linenumber").df, PRICES)

    return run


def scaled_sql(value: str, fits: str) -> str:
    aggregates = ", ".join(fits.replace("{c}", n) for n in PRICES)
    columns = ", ".join(f"{r(value.replace('{c}', n))} as {n}" for n in PRICES)
    return f"with f as (select {aggregates} from lineitem) select l_orderkey, l_linenumber, {columns} from lineitem, f"


query(
    "n1_standard",
    scaled_sql("(({c} - {c}_m) / coalesce(nullif({c}_s, 0), 1))", "avg({c}) as {c}_m, stddev_pop({c}) as {c}_s"),
)(scaled("standard"))
query(
    "n2_minmax",
    scaled_sql("(({c} - {c}_a) / coalesce(nullif({c}_b - {c}_a, 0), 1))", "min({c}) as {c}_a, max({c}) as {c}_b"),
)(scaled("minmax"))
query(
    "n3_robust",
    scaled_sql(
        "(({c} - {c}_m) / coalesce(nullif({c}_b - {c}_a, 0), 1))",
        "quantile_cont({c}, 0.25) as {c}_a, quantile_cont({c}, 0.5) as {c}_m, quantile_cont({c}, 0.75) as {c}_b",
    ),
)(scaled("robust"))
query("n5_maxabs", scaled_sql("({c} / coalesce(nullif({c}_x, 0), 1))", "max(abs({c})) as {c}_x"))(scaled("maxabs"))


@query("n4_log", f"select c_custkey, {r('ln(1 + greatest(c_acctbal, 0))')} as c_acctbal from customer")
def log(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale(customer, {"c_acctbal": "log"}).df, ["c_acctbal"])


def power_sql() -> str:
    """The same search by grid refinement, one pair of CTEs per round."""

    def transform(x: str, power: str) -> str:
        up = f"case when abs({power}) < 1e-12 then ln(1 + abs({x})) else (pow(1 + abs({x}), {power}) - 1) / {power} end"
        mirrored = f"(2 - {power})"
        down = (
            f"case when abs({mirrored}) < 1e-12 then -ln(1 + abs({x}))"
            f" else -(pow(1 + abs({x}), {mirrored}) - 1) / {mirrored} end"
        )
        return f"case when {x} >= 0 then {up} else {down} end"

    parts = [
        "x as (select c_custkey, c_acctbal as v from customer)",
        "logs as (select sum(sign(v) * ln(1 + abs(v))) as s, count(*) as n from x)",
        "best0 as (select 0.0::double as power)",
    ]
    for i in range(1, ROUNDS + 1):
        step = FIRST_STEP / 10 ** (i - 1)
        parts.append(
            f"grid{i} as (select power + k * {step!r}::double as power"
            f" from best{i - 1}, range(-{HALF_WIDTH}, {HALF_WIDTH + 1}) as t(k))"
        )
        parts.append(
            f"best{i} as (select power from (select power, -any_value(n) / 2.0 * ln(var_pop({transform('v', 'power')}))"
            f" + (power - 1) * any_value(s) as score from x, grid{i}, logs group by power) order by score desc limit 1)"
        )
    parts.append(f"y as (select c_custkey, {transform('v', 'power')} as v from x, best{ROUNDS})")
    return f"""with {", ".join(parts)}
    select c_custkey, {r("((v - (select avg(v) from y)) / (select stddev_pop(v) from y))", 3)} as c_acctbal from y"""


@query("n6_power_yeo", power_sql())
def power(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale(customer, {"c_acctbal": "power_yeo"}).df, ["c_acctbal"], 3)


@query(
    "n7_scaling_report",
    " union all ".join(
        f"""select '{n}' as "column", round(avg({n}), 4) as mean_before, round(stddev_samp({n}), 4) as std_before,
        {r(f"avg(({n} - a) / w)", 4)} as mean_after, round(stddev_samp(({n} - a) / w), 4) as std_after
        from lineitem, (select min({n}) as a, max({n}) - min({n}) as w from lineitem)"""
        for n in PRICES
    ),
)
def report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*PRICES)
    return scaling_report(lines, scale(lines, {"__all_numeric__": "minmax"}).df, PRICES)


EVENT = "event_id, event_type"
QUARTILES = "(select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from {t})"
MOMENTS = "(select avg(value) as m, stddev_samp(value) as s from {t})"


def treated(strategy: str, source: str = "events_gaps", clean: bool = False):
    def run(spark, sf_dir):
        # The given table is known to hold no NaN, so the filter of a removal may go down into the scan.
        events = table(spark, sf_dir, source, nan_as_null=False) if clean else view(spark, sf_dir, source)
        return rounded(treat_outliers(events.select("event_id", "event_type", "value"), {"value": strategy}).df, ["value"])

    return run


def clipped_sql(low: str, high: str, fits: str) -> str:
    value = f"case when value < {low} then {low} when value > {high} then {high} else value end"
    return f"select {EVENT}, {r(f'({value})')} as value from $events_gaps, {fits.replace('{t}', '$events_gaps')}"


query("o1_clip_iqr", clipped_sql("(q1 - 1.5 * (q3 - q1))", "(q3 + 1.5 * (q3 - q1))", QUARTILES))(treated("clip_iqr"))
query(
    "o2_remove_iqr",
    f"""select {EVENT}, value from events, {QUARTILES.replace("{t}", "events")}
    where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""",
)(treated("remove_iqr", "events", clean=True))
query(
    "o2_remove_iqr_narrow",
    f"""select {EVENT}, value from $events_gaps, {QUARTILES.replace("{t}", "$events_gaps")}
    where value between q1 - 0.5 * (q3 - q1) and q3 + 0.5 * (q3 - q1)""",
)(treated("remove_iqr:0.5"))
query("o3_clip_zscore", clipped_sql("(m - 2 * s)", "(m + 2 * s)", MOMENTS))(treated("clip_zscore:2"))
query(
    "o4_remove_zscore",
    f"select {EVENT}, value from $events_gaps, {MOMENTS.replace('{t}', '$events_gaps')} where abs((value - m) / s) <= 2.5",
)(treated("remove_zscore:2.5"))
query(
    "o5_winsorize",
    clipped_sql("a", "b", "(select quantile_cont(value, 0.05) as a, quantile_cont(value, 0.95) as b from {t})"),
)(treated("winsorize"))
query(
    "o6_log_transform",
    f"""select {EVENT}, {r("ln(1 + greatest(value, 0))")} as value from $events_gaps where value is not null
    union all select {EVENT}, null from $events_gaps where value is null""",
)(treated("log_transform"))


def outside_sql(source: str) -> str:
    return f"""(select count(*) from {source}, (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
        from {source}) where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1))"""


@query(
    "o7_outlier_report",
    f"""with kept as (select value from events, {QUARTILES.replace("{t}", "events")}
        where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))
    select 'value' as "column", 'remove_iqr' as strategy, {outside_sql("events")} as outliers_before,
        {outside_sql("kept")} as outliers_after, (select count(*) from events) as rows_before,
        (select count(*) from kept) as rows_after""",
)
def outliers(spark, sf_dir):
    return outlier_report(table(spark, sf_dir, "events"), {"value": "remove_iqr"})
