"""Profiles."""

from __future__ import annotations

from burnish.operators import profile as p
from burnish.operators.missing import fill_missing
from queries.registry import ORDER_COLUMNS, TABLES, per_column, query, table, view

LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
CORR_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_net", "l_const", "l_qty2"]
PART_TEXTS = ["p_name", "p_brand", "p_type"]
TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ORDER_COLUMNS,
    "lineitem": LINE_COLUMNS,
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
ORDER_TYPES = ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


@query(
    "p1_shape_and_schema",
    f"""select position, "column", "type", (select count(*) from orders) as "rows", 6 as "columns"
    from (values {values([(i, n, t) for i, (n, t) in enumerate(zip(ORDER_COLUMNS, ORDER_TYPES))])})
        as s(position, "column", "type")""",
)
def shape(spark, sf_dir):
    return p.shape(table(spark, sf_dir, "orders"))


@query("p2_null_counts", per_column("$orders_gaps", ORDER_COLUMNS, "count(*) filter (where {c} is null) as nulls"))
def nulls(spark, sf_dir):
    return p.null_counts(view(spark, sf_dir, "orders_gaps"))


NULL_PCT = "round(count(*) filter (where {c} is null) * 100.0::double / count(*), 2) as null_pct"


@query(
    "p3_null_percent",
    per_column("$orders_gaps", ORDER_COLUMNS, f"count(*) filter (where {{c}} is null) as nulls, {NULL_PCT}"),
)
def null_percent(spark, sf_dir):
    return p.null_percents(view(spark, sf_dir, "orders_gaps"))


@query("p4_distinct_counts", per_column("lineitem", LINE_COLUMNS, 'count(distinct {c}) as "distinct"'))
def distinct(spark, sf_dir):
    return p.distinct_counts(table(spark, sf_dir, "lineitem"))


@query("p5_sample_rows", "select * from events order by event_id limit 3")
def sample(spark, sf_dir):
    return p.sample_rows(table(spark, sf_dir, "events"), "event_id")


DESCRIBE = """count({c}) as "count", round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
    round(min({c})::double, 4) as "min", round(max({c})::double, 4) as "max",
    round(quantile_cont({c}::double, 0.25), 4) as q1, round(quantile_cont({c}::double, 0.5), 4) as median,
    round(quantile_cont({c}::double, 0.75), 4) as q3"""


@query("p6_numeric_describe", per_column("lineitem", LINE_NUMBERS, DESCRIBE))
def describe(spark, sf_dir):
    return p.describe_numeric(table(spark, sf_dir, "lineitem"))


def outlier_sql(source: str, column: str) -> str:
    return f"""select '{column}' as "column", count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1))
        as outliers, round(count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1))
        * 100.0::double / count(*), 2) as outlier_pct
    from (select {column}::double as x from {source}),
        (select quantile_cont({column}::double, 0.25) as q1, quantile_cont({column}::double, 0.75) as q3 from {source})
    where q3 > q1 having count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) > 0"""


@query("p7_iqr_outliers", " union all ".join(outlier_sql("events", n) for n in ["event_id", "user_id", "value"]))
def outliers(spark, sf_dir):
    return p.outlier_counts(table(spark, sf_dir, "events"))


PAIRS = [(a, b) for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1 :] if "l_const" not in (a, b)]


def pairs_sql(limit: str) -> str:
    return " union all ".join(
        f"select '{a}' as col1, '{b}' as col2, abs(corr({a}, {b})) as x from $lineitem_corr having abs(corr({a}, {b})) {limit}"
        for a, b in PAIRS
    )


@query("p8_high_correlations", f"select col1, col2, round(x, 4) as correlation from ({pairs_sql('> 0.9')})")
def high_correlations(spark, sf_dir):
    return p.high_correlations(view(spark, sf_dir, "lineitem_corr"))


@query("p9_cardinality", per_column("part", PART_TEXTS, 'count(distinct {c}) as "distinct"'))
def cardinality(spark, sf_dir):
    return p.cardinality(table(spark, sf_dir, "part"))


TOP = """select "column", "value", n, "rank"::int as "rank" from (
    select "column", "value", n, row_number() over (partition by "column" order by n desc, "value") as "rank"
    from (select "column", "value", count(*) as n from (
        {cells}) where "value" is not null group by all)) where "rank" <= 10"""


@query("p10_top_values", TOP.replace("{cells}", per_column("part", PART_TEXTS, '{c} as "value"')))
def top(spark, sf_dir):
    return p.top_categories(table(spark, sf_dir, "part"))


@query("p11_average_length", per_column("documents", ["text", "lang", "source"], "round(avg(length({c})), 1) as avg_length"))
def lengths(spark, sf_dir):
    return p.average_lengths(table(spark, sf_dir, "documents"))


@query(
    "p12_duplicate_rows",
    f"""select sum(n - 1)::bigint as duplicates
    from (select count(*) as n from $lineitem_dup group by {", ".join(LINE_COLUMNS)})""",
)
def duplicates(spark, sf_dir):
    return p.duplicate_count(view(spark, sf_dir, "lineitem_dup"))


@query(
    "p13_constant_columns",
    f"""select * from ({per_column("$lineitem_corr", CORR_COLUMNS, 'count(distinct {c}) as "distinct"')})
    where "distinct" <= 1""",
)
def constant(spark, sf_dir):
    return p.constant_columns(view(spark, sf_dir, "lineitem_corr"))


@query(
    "p14_date_candidates",
    f"""select * from ({per_column("$orders_text_dates", ["date_text", "day_text", "o_orderpriority"],
        "count({c}) as filled, count(try_strptime({c}, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%m/%d/%Y'])) as parsed")})
    where filled > 0 and filled = parsed""",
)
def date_candidates(spark, sf_dir):
    return p.date_candidates(view(spark, sf_dir, "orders_text_dates"))


def inventory_sql(column: str, kind: str) -> str:
    number = kind in ("bigint", "double", "int")
    stats = [
        f"round({fn}({column})::double, 4)" if number else "null::double" for fn in ("min", "max", "avg")
    ]
    mode = (
        "null::varchar"
        if number
        else f"(select cast({column} as varchar) from $orders_gaps where {column} is not null"
        f" group by {column} order by count(*) desc, {column} limit 1)"
    )
    return f"""select '{column}' as "column", '{kind}' as "type", count(distinct {column}) as "distinct",
        count(*) filter (where {column} is null) as nulls,
        round(count(*) filter (where {column} is null) * 100.0::double / count(*), 2) as null_pct,
        count({column}) as filled, {stats[0]} as "min", {stats[1]} as "max", {stats[2]} as mean, {mode} as "mode"
    from $orders_gaps"""


@query("p15_inventory", " union all ".join(inventory_sql(n, t) for n, t in zip(ORDER_COLUMNS, ORDER_TYPES)))
def inventory(spark, sf_dir):
    return p.inventory(view(spark, sf_dir, "orders_gaps"))


def summary_sql(dataset: str, source: str) -> str:
    nulls_sql = " + ".join(f"count(*) filter (where {n} is null)" for n in ORDER_COLUMNS)
    return f"""select '{dataset}' as dataset, count(*) as "rows", {nulls_sql} as nulls, 6 as "columns",
        (select coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from {source}
            group by {", ".join(ORDER_COLUMNS)})) as duplicates from {source}"""


@query(
    "p16_profile_summary",
    summary_sql("original", "$orders_gaps")
    + " union all "
    + summary_sql("output", "(select * from $orders_gaps where o_totalprice is not null)"),
)
def summaries(spark, sf_dir):
    gaps = view(spark, sf_dir, "orders_gaps")
    return p.summaries({"original": gaps, "output": fill_missing(gaps, {"o_totalprice": "drop_rows"}).df})


def rank_sql(name: str) -> str:
    columns = TABLE_COLUMNS[name]
    nulls_sql = " + ".join(f"count(*) filter (where {n} is null)" for n in columns)
    return f"""select '{name}' as dataset, count(*) as "rows", {len(columns)} as "columns",
        round(({nulls_sql}) * 100.0::double / (count(*) * {len(columns)}), 2) as missing_pct, 0 as format_rank from {name}"""


@query("p17_dataset_ranking", " union all ".join(rank_sql(n) for n in TABLES))
def ranking(spark, sf_dir):
    return p.rank_datasets({n: (table(spark, sf_dir, n), "parquet") for n in TABLES})


@query(
    "p18_drop_suggestions",
    f"""select "column", 'constant' as reason
    from ({per_column("$lineitem_corr", CORR_COLUMNS, 'count(distinct {c}) as "distinct"')}) where "distinct" <= 1
    union all select distinct col2, 'correlated' from ({pairs_sql(">= 0.95")})""",
)
def drop_suggestions(spark, sf_dir):
    return p.drop_suggestions(view(spark, sf_dir, "lineitem_corr"))
