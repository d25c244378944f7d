"""Engineered features."""

from __future__ import annotations

from burnish.operators.features import add_features, feature_report
from queries.registry import query, r, rounded, table, view

LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def made(source: str, columns: list[str], definition: str, places: int | None = 6):
    def run(spark, sf_dir):
        df = view(spark, sf_dir, source) if source.endswith("_gaps") else table(spark, sf_dir, source)
        out = add_features(df.select(*columns), {"made": definition}).df
        return rounded(out, ["made"], places) if places else out

    return run


def line_query(name: str, definition: str, expression: str, rounding: bool = True) -> None:
    value = r(f"({expression})") if rounding else expression
    query(name, f"select {', '.join(LINE)}, {value} as made from lineitem")(
        made("lineitem", LINE, definition, 6 if rounding else None)
    )


query("f1_str_len", "select doc_id, text, length(text)::int as made from documents")(
    made("documents", ["doc_id", "text"], "str_len:text", None)
)
query(
    "f2_word_count", r"select doc_id, text, len(regexp_extract_all(text, '\S+'))::int as made from documents"
)(made("documents", ["doc_id", "text"], "word_count:text", None))
query("f3_log", f"select c_custkey, c_acctbal, {r('ln(1 + greatest(c_acctbal, 0))')} as made from customer")(
    made("customer", ["c_custkey", "c_acctbal"], "log:c_acctbal")
)
line_query("f4_ratio", "ratio:l_extendedprice,l_tax", "l_extendedprice / nullif(l_tax, 0)")
query(
    "f5_threshold_above",
    "select o_orderkey, o_totalprice, coalesce((o_totalprice > 250000)::int, 0) as made from $orders_gaps",
)(made("orders_gaps", ["o_orderkey", "o_totalprice"], "threshold_above:o_totalprice,250000", None))
query(
    "f6_threshold_below",
    "select o_orderkey, o_totalprice, coalesce((o_totalprice < 100000)::int, 0) as made from $orders_gaps",
)(made("orders_gaps", ["o_orderkey", "o_totalprice"], "threshold_below:o_totalprice,100000", None))


def bin_sql(columns: list[str], column: str, bins: int, source: str) -> str:
    shares = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"""with edges as (select distinct e from
        (select unnest(quantile_cont({column}::double, [{shares}])) as e from {source}) where e is not null),
    cuts as (select e from edges where e > (select min(e) from edges) and e < (select max(e) from edges))
    select {", ".join(columns)}, case when {column} is not null and (select count(*) from edges) > 1
        then (select count(*) from cuts where e < {column}) end as made from {source}"""


query("f7_bin", bin_sql(LINE, "l_extendedprice", 10, "lineitem"))(made("lineitem", LINE, "bin:l_extendedprice,10", None))
query("f7_bin_with_ties", bin_sql(LINE, "l_discount", 20, "lineitem"))(made("lineitem", LINE, "bin:l_discount,20", None))
query("f7_bin_with_gaps", bin_sql(["o_orderkey", "o_totalprice"], "o_totalprice", 4, "$orders_gaps"))(
    made("orders_gaps", ["o_orderkey", "o_totalprice"], "bin:o_totalprice,4", None)
)
line_query("f8_multiply", "multiply:l_quantity,l_discount", "l_quantity * l_discount")
line_query("f9_add", "add:l_discount,l_tax", "l_discount + l_tax")
line_query("f10_subtract", "subtract:l_discount,l_tax", "l_discount - l_tax")
line_query(
    "u1_formula",
    "formula:(l_extendedprice * (1 - l_discount)) / (l_tax ** 2)",
    "(l_extendedprice * (1 - l_discount)) / nullif(pow(l_tax, 2), 0)",
)
line_query(
    "u1_formula_logic",
    "formula:l_quantity > 25 and not (l_discount <= 0.05 or l_tax == 0)",
    "l_quantity > 25 and not (l_discount <= 0.05 or l_tax = 0)",
    False,
)


@query(
    "f11_feature_report",
    """with f as (select l_extendedprice / nullif(l_tax, 0) as rate, l_quantity * l_discount as off from lineitem)
    select 'rate' as "column", 'created' as status, 'double' as "type", null::varchar as reason,
        count(*) filter (where rate is null) as nulls, round(avg(rate), 4) as mean, round(min(rate), 4) as "min",
        round(max(rate), 4) as "max" from f
    union all select 'off', 'created', 'double', null, count(*) filter (where off is null), round(avg(off), 4),
        round(min(off), 4), round(max(off), 4) from f
    union all select 'lost', 'error', null, 'column not found: no_such_column', null, null, null, null""",
)
def report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    features = {
        "rate": "ratio:l_extendedprice,l_tax",
        "off": "multiply:l_quantity,l_discount",
        "lost": "log:no_such_column",
    }
    return feature_report(lines, add_features(lines, features))
