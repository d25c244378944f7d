"""Categorical encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators.encode import encode, encoding_report, onehot_long
from queries.registry import query, r, rounded, table, view

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def encoded(method: str, places: int | None = None, **options):
    def run(spark, sf_dir):
        gaps = view(spark, sf_dir, "orders_gaps").select("o_orderkey", "o_totalprice", "o_orderpriority")
        out = encode(gaps, {"o_orderpriority": method}, **options).df
        return rounded(out, ["o_orderpriority"], places) if places else out

    return run


LABEL = """with codes as (select {c} as v, row_number() over (order by {c}) - 1 as code
    from (select distinct {c} from {t} where {c} is not null))"""

query(
    "e1_label",
    LABEL.replace("{c}", "o_orderpriority").replace("{t}", "$orders_gaps")
    + " select o_orderkey, o_totalprice, code as o_orderpriority from $orders_gaps left join codes on v = o_orderpriority",
)(encoded("label"))


@query(
    "e1_label_many_values",
    LABEL.replace("{c}", "c_name").replace("{t}", "customer")
    + " select c_custkey, code as c_name from customer left join codes on v = c_name",
)
def label_many(spark, sf_dir):
    return encode(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": "label"}).df


query(
    "e2_onehot",
    "select o_orderkey, o_totalprice, "
    + ", ".join(f"""coalesce((o_orderpriority = '{v}')::int, 0) as "o_orderpriority_{v}\"""" for v in PRIORITIES[1:])
    + " from $orders_gaps",
)(encoded("onehot"))
query(
    "e3_frequency",
    f"""with f as (select o_orderpriority as v, count(*) / (sum(count(*)) over ()) as share from $orders_gaps
        where o_orderpriority is not null group by 1)
    select o_orderkey, o_totalprice, {r("share", 9)} as o_orderpriority
    from $orders_gaps left join f on v = o_orderpriority""",
)(encoded("frequency", 9))


@query(
    "e3_frequency_many_values",
    f"""with f as (select o_custkey as v, count(*) / (sum(count(*)) over ()) as share from orders group by 1)
    select o_orderkey, {r("share", 9)} as o_custkey from orders join f on v = o_custkey""",
)
def frequency_many(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rounded(encode(orders, {"o_custkey": "frequency"}).df, ["o_custkey"], 9)


query(
    "e4_ordinal",
    """select o_orderkey, o_totalprice, case o_orderpriority when '5-LOW' then 0 when '3-MEDIUM' then 1
        when '2-HIGH' then 2 when '1-URGENT' then 3 end::bigint as o_orderpriority from $orders_gaps""",
)(encoded("ordinal:5-LOW,3-MEDIUM,2-HIGH,1-URGENT"))


@query(
    "e5_binary",
    """with flags as (select o_orderkey, case when o_orderkey % 17 = 0 then null when o_orderkey % 3 = 1 then 'odd one'
        else 'usual' end as flag from orders),
    seen as (select flag as v, (row_number() over (order by min(o_orderkey)) - 1)::int as code from flags
        where flag is not null group by flag)
    select o_orderkey, coalesce(code, 0) as flag from flags left join seen on v = flag""",
)
def binary(spark, sf_dir):
    key = F.col("o_orderkey")
    flag = F.when(key % 17 == 0, None).when(key % 3 == 1, "odd one").otherwise("usual")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", flag.alias("flag"))
    return encode(orders, {"flag": "binary"}, order_by="o_orderkey").df


query(
    "e6_target",
    f"""with m as (select o_orderpriority as v, avg(o_totalprice) as mean from $orders_gaps
        where o_orderpriority is not null group by 1)
    select o_orderkey, o_totalprice, {r("mean", 4)} as o_orderpriority
    from $orders_gaps left join m on v = o_orderpriority""",
)(encoded("target:o_totalprice", 4))


@query(
    "e6_target_many_values",
    f"""with m as (select o_custkey as v, avg(o_totalprice) as mean from $orders_gaps group by 1)
    select o_orderkey, {r("mean", 7)} as o_custkey from $orders_gaps join m on v = o_custkey""",
)
def target_many(spark, sf_dir):
    gaps = view(spark, sf_dir, "orders_gaps").select("o_orderkey", "o_custkey", "o_totalprice")
    out = encode(gaps, {"o_custkey": "target:o_totalprice"}).df
    return rounded(out.drop("o_totalprice"), ["o_custkey"], 7)


@query(
    "e2_onehot_long",
    """select o_orderkey, 'o_orderpriority_' || o_orderpriority as "column" from $orders_gaps
    where o_orderpriority > (select min(o_orderpriority) from $orders_gaps)""",
)
def long(spark, sf_dir):
    return onehot_long(view(spark, sf_dir, "orders_gaps"), "o_orderpriority", ["o_orderkey"])


@query(
    "e2_onehot_sparse",
    """with codes as (select c_name as v, row_number() over (order by c_name) - 2 as place,
        (select count(distinct c_name) - 1 from customer) as size from (select distinct c_name from customer))
    select o_orderkey, '(' || size || ',' || case when place < 0 then '[],[]' else '[' || place || '],[1.0]' end || ')' as ones
    from orders join customer on c_custkey = o_custkey join codes on v = c_name""",
)
def sparse(spark, sf_dir):
    """The names of the customers of all orders as sparse vectors, shown as text."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    coded = encode(orders.join(customers, "c_custkey").select("o_orderkey", "c_name"), {"c_name": "sparse"}).df
    return coded.select("o_orderkey", F.col("c_name_onehot").cast("string").alias("ones"))


REPORTED = """select '{c}' as "column", 'done' as status, '{m}' as detail, v::varchar as value, code::double as code from ({s})"""

query(
    "e7_encoding_report",
    " union all ".join(
        [
            REPORTED.format(c=name, m="label", s=f"""select v, row_number() over (order by v) - 1 as code
                from (select distinct {name} as v from {source} where {name} is not null)""")
            for name, source in (("o_orderpriority", "$orders_gaps"),)
        ]
        + [
            REPORTED.format(c="o_custkey", m="frequency", s="""select o_custkey as v,
                round(count(*) / (sum(count(*)) over ()), 9) as code from orders group by 1"""),
            """select 'o_orderstatus', 'skipped', 'not binary: ' || case when count(distinct o_orderstatus) > 2 then 'more than 2'
                else count(distinct o_orderstatus)::varchar end || ' values', null, null from orders""",
            "select 'no_such_column', 'skipped', 'column not found', null, null",
        ]
    ),
)(
    lambda spark, sf_dir: rounded(
        encoding_report(
            spark,
            encode(
                view(spark, sf_dir, "orders_gaps"),
                {"o_orderpriority": "label", "o_custkey": "frequency", "o_orderstatus": "binary", "no_such_column": "label"},
                order_by="o_orderkey",
            ),
        ),
        ["code"],
        9,
    )
)
