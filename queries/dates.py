"""Date features."""

from __future__ import annotations

from burnish.operators.dates import date_features, parse_dates, unparsed_dates
from queries.registry import query, table, view

PARSED = "(select o_orderkey, try_strptime(date_text, '%Y-%m-%d') as d from $orders_text_dates)"


def extracted(features: str, source: str = "orders_text_dates", key: str = "o_orderkey", column: str = "date_text"):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source) if source == "events" else view(spark, sf_dir, source)
        return date_features(df.select(key, column), {column: features}).df

    return run


def from_text(name: str, feature: str, expression: str) -> None:
    query(name, f"select o_orderkey, {expression} as date_text_{feature} from {PARSED}")(extracted(feature))


@query("dt1_parse", f"select o_orderkey, d as date_text from {PARSED}")
def parse(spark, sf_dir):
    return parse_dates(view(spark, sf_dir, "orders_text_dates").select("o_orderkey", "date_text"), ["date_text"])


@query("dt1_null_dates", f"""select 'date_text' as "column", count(*) filter (where d is null) as null_dates from {PARSED}""")
def null_dates(spark, sf_dir):
    return unparsed_dates(view(spark, sf_dir, "orders_text_dates"), ["date_text"])


from_text("dt2_year", "year", "year(d)::int")
from_text("dt3_month", "month", "month(d)::int")
from_text("dt4_day", "day", "day(d)::int")
from_text("dt5_dayofweek", "dayofweek", "(isodow(d) - 1)::int")
from_text("dt7_is_weekend", "is_weekend", "coalesce((isodow(d) >= 6)::int, 0)")
from_text("dt8_quarter", "quarter", "quarter(d)::int")
from_text("dt9_week_of_year", "week_of_year", "weekofyear(d)::int")

query("dt6_hour_minute", "select event_id, hour(ts)::int as ts_hour, minute(ts)::int as ts_minute from events")(
    extracted("hour,minute", "events", "event_id", "ts")
)
query(
    "dt10_days_since_earliest",
    "select event_id, date_sub('day', (select min(ts) from events), ts) as ts_days_since_earliest from events",
)(extracted("days_since_earliest", "events", "event_id", "ts"))
query(
    "dt11_time_of_day",
    """select event_id, case when hour(ts) <= 6 then 'night' when hour(ts) <= 12 then 'morning'
        when hour(ts) <= 18 then 'afternoon' else 'evening' end as ts_time_of_day from events""",
)(extracted("time_of_day", "events", "event_id", "ts"))
