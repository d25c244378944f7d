"""The registry, the derived views, and small helpers to write both sides alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from burnish.functions.columns import c, round_safe
from burnish.sources.readers import read_parquet

Run = Callable[[SparkSession, str], DataFrame]

_RUNS: dict[str, Run] = {}
_SQL: dict[str, str] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

# The given tables hold no missing values, copies, dirty text or infinities, so these views make some. The
# expressions mean the same in Spark and in the SQL of the check.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "orders_gaps": (
        "orders",
        [
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice",
            "o_orderdate",
            "case when o_orderkey % 11 = 0 then null else o_orderpriority end as o_orderpriority",
        ],
    ),
    "events_gaps": (
        "events",
        ["event_id", "ts", "user_id", "event_type", "case when event_id % 5 < 2 then null else value end as value"],
    ),
    "customer_dirty": (
        "customer",
        [
            "c_custkey",
            "c_mktsegment",
            "case when c_custkey % 9 = 0 then 'N/A' when c_custkey % 13 = 0 then 'n.a. 12'"
            " else cast(c_acctbal as string) end as acct_text",
            "case when c_custkey % 3 = 0 then 'yes' when c_custkey % 3 = 1 then 'False' else '?' end as flag_text",
            "cast(c_nationkey as string) as nation_text",
            "case when c_custkey % 10 = 0 then null else concat(' ', cast(c_custkey as string)) end as key_text",
        ],
    ),
    "orders_text_dates": (
        "orders",
        [
            "o_orderkey",
            "case when o_orderkey % 13 = 0 then 'not a date'"
            " else substr(cast(o_orderdate as string), 1, 10) end as date_text",
            "substr(cast(o_orderdate as string), 1, 10) as day_text",
            "o_orderpriority",
        ],
    ),
    "lineitem_corr": (
        "lineitem",
        [
            "l_orderkey",
            "l_linenumber",
            "l_quantity",
            "l_extendedprice",
            "l_extendedprice * (1 - l_discount) as l_net",
            "1 as l_const",
            "case when l_orderkey % 7 = 0 then null else l_quantity * 2 + 1 end as l_qty2",
        ],
    ),
    "events_inf": (
        "events",
        [
            "event_id",
            "event_type",
            "case when event_id % 1000 = 0 then cast('Infinity' as double) else value end as value",
        ],
    ),
    "part_tags": ("part", ["p_partkey", "p_brand", "replace(p_name, ' ', '|') as tags", "p_retailprice"]),
}
COPIES = "select * from lineitem union all select * from lineitem where l_orderkey % 10 = 0"


def table(spark: SparkSession, sf_dir: str, name: str, nan_as_null: bool = True) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", nan_as_null)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "lineitem_dup":
        lines = table(spark, sf_dir, "lineitem")
        return lines.unionByName(lines.where("l_orderkey % 10 = 0"))
    source, expressions = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*expressions)


def sql(text: str) -> str:
    """Put the views, written as ``$name``, into the text."""
    text = text.replace("$lineitem_dup", f"({COPIES})")
    for name, (source, expressions) in VIEWS.items():
        text = text.replace(f"${name}", f"(select {', '.join(expressions)} from {source})")
    return text.strip()


def query(name: str, check: str | None = None) -> Callable[[Run], Run]:
    """Register a query under a name, with the SQL that checks it."""

    def add(run: Run) -> Run:
        if name in _RUNS:
            raise ValueError(f"registered twice: {name}")
        _RUNS[name] = run
        if check is not None:
            _SQL[name] = sql(check)
        return run

    return add


def registered() -> dict[str, Run]:
    return dict(_RUNS)


def oracle() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    return df.withColumns({n: round_safe(c(n), places) for n in columns})


def r(expression: str, places: int = 6) -> str:
    """SQL twin of ``rounded``."""
    return f"case when abs({expression}) < {0.5 * 10**-places!r} then 0.0 else round({expression}, {places}) end"


def per_column(source: str, columns: Sequence[str], select: str) -> str:
    """One SELECT per column, with ``{c}`` for its name."""
    return " union all ".join(f"select '{n}' as \"column\", {select.replace('{c}', n)} from {source}" for n in columns)
