"""Readers, catalog, previews and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from burnish.session import cut, scratch_path
from burnish.sources.catalog import file_catalog, preview, preview_summary
from burnish.sources.folder import scan_columns, scan_folder
from burnish.sources.readers import read_csv, read_json_array, read_json_lines, read_parquet, read_text, read_tsv, text_preview
from burnish.sources.sinks import write_csv, write_output
from queries.registry import per_column, query, table, view

ORDER_PLAIN = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
DOCUMENT_ROWS = 5_000


@query("s1_csv_source", f"select {', '.join(ORDER_PLAIN)} from $orders_gaps")
def csv_source(spark, sf_dir):
    path = scratch_path(spark, "csv")
    gaps = view(spark, sf_dir, "orders_gaps").select(*ORDER_PLAIN)
    write_csv(gaps.withColumn("o_orderpriority", F.coalesce("o_orderpriority", F.lit("N/A"))), path)
    return read_csv(spark, path)


@query(
    "s1_csv_line_breaks",
    "select doc_id, lang, replace(text, ' ', case when doc_id % 3 = 0 then chr(10) when doc_id % 3 = 1 then '\", ' else ' ' end) as text"
    " from documents",
)
def csv_line_breaks(spark, sf_dir):
    """Cells with line breaks and quotes, in files that several tasks read in ranges."""
    path = scratch_path(spark, "csv")
    blank = F.when(F.col("doc_id") % 3 == 0, "\n").when(F.col("doc_id") % 3 == 1, '", ').otherwise(" ")
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", F.replace("text", F.lit(" "), blank).alias("text")), path)
    return read_csv(spark, path)


@query("s2_tsv_source", "select c_custkey, nullif(acct_text, 'N/A') as acct_text, flag_text from $customer_dirty")
def tsv_source(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    write_csv(view(spark, sf_dir, "customer_dirty").select("c_custkey", "acct_text", "flag_text"), path, sep="\t")
    return read_tsv(spark, path)


@query("s3_json_lines_source", f"select {', '.join(ORDER_PLAIN)} from $orders_gaps")
def json_lines_source(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    view(spark, sf_dir, "orders_gaps").select(*ORDER_PLAIN).write.json(path)
    return read_json_lines(spark, path)


@query("s4_json_array_source", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def json_array_source(spark, sf_dir):
    path = scratch_path(spark, "json")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    # Documents of a fixed number of keys each, so that more data means more documents, not larger ones.
    numbered = orders.withColumn("document", F.floor(F.col("o_orderkey") / DOCUMENT_ROWS))
    documents = numbered.groupBy("document").agg(
        F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))).alias("value")
    )
    documents.write.partitionBy("document").text(path)
    return read_json_array(spark, path).drop("document")


LIST_ROWS = 1_000_000


@query("s4_json_array_ranges", "select o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def json_array_ranges(spark, sf_dir):
    """Lists of up to a million objects in one file each, which is read in ranges."""
    path = scratch_path(spark, "json")
    orders = table(spark, sf_dir, "orders")
    order = {"status": F.col("o_orderstatus"), "price": F.col("o_totalprice"), "day": F.date_format("o_orderdate", "yyyy-MM-dd")}
    value = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.struct(*[x.alias(n) for n, x in order.items()]).alias("order")))
    lines = orders.select(F.floor(F.col("o_orderkey") / LIST_ROWS).alias("document"), "o_orderkey", value.alias("value"))
    in_file = Window.partitionBy("document").orderBy("o_orderkey")
    before = F.when(F.row_number().over(in_file) == 1, "[").otherwise(",")
    after = F.when(F.lead("value").over(in_file).isNull(), "]").otherwise("")
    lines = lines.select("document", F.concat(before, "value", after).alias("value"))
    lines.write.partitionBy("document").text(path)
    read = read_json_array(spark, path, "key long, order struct<status: string, price: double, day: string>")
    return read.select(
        F.col("key").alias("o_orderkey"),
        F.col("order.status").alias("o_orderstatus"),
        F.col("order.price").alias("o_totalprice"),
        F.col("order.day").alias("day"),
    )


@query("s5_parquet_source", "select * from customer")
def parquet_source(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/customer.parquet")


@query("s6_text_source", "select url as value from pages")
def text_source(spark, sf_dir):
    path = scratch_path(spark, "text")
    table(spark, sf_dir, "pages").select("url").write.text(path)
    return read_text(spark, path)


@query(
    "s6_text_preview",
    """
    with lines as (select regionkey, line, value from (
        select n_regionkey as regionkey, row_number() over (partition by n_regionkey order by n_nationkey) as line,
            n_nationkey || ' ' || n_name as value from nation))
    select cast(regionkey as bigint) as regionkey, cast(line as integer) as line, value from lines where line <= 5
    """,
)
def first_lines(spark, sf_dir):
    """The first five lines of each of several files, one for each region."""
    path = scratch_path(spark, "text")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("regionkey"), "n_nationkey", F.concat_ws(" ", "n_nationkey", "n_name").alias("value")
    )
    nations = nations.repartition("regionkey").sortWithinPartitions("regionkey", "n_nationkey")
    nations.select("regionkey", "value").write.partitionBy("regionkey").text(path)
    seen = text_preview(spark, path)
    return seen.select(F.regexp_extract("file", r"regionkey=(\d+)", 1).cast("long").alias("regionkey"), "line", "value")


@query("s7_file_catalog")
def catalog(spark, sf_dir):
    return file_catalog(spark, sf_dir)


SHOWN_ROWS = 5


def key_ranges(df, key):
    """Rows in key ranges, one for each file that is written of them, so that no task sorts or writes a whole table.

    The first rows of all share a range key, so the first file holds them all, however small the ranges are.
    """
    last = df.select(key).orderBy(key).limit(SHOWN_ROWS).agg(F.max(key)).first()[0]
    return df.repartitionByRange(F.greatest(key, F.lit(last))).sortWithinPartitions(key)


def scanned_tables(spark, sf_dir) -> str:
    """A folder with tables in four formats; those that grow are in several files."""
    path = scratch_path(spark, "folder")
    gaps = view(spark, sf_dir, "orders_gaps").select(*ORDER_PLAIN)
    write_csv(key_ranges(gaps, "o_orderkey"), f"{path}/csv")
    nations = table(spark, sf_dir, "nation").repartitionByRange(1, "n_nationkey").sortWithinPartitions("n_nationkey")
    nations.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("n_name")).write.option(
        "ignoreNullFields", False
    ).json(f"{path}/json-written")
    key_ranges(table(spark, sf_dir, "supplier"), "s_suppkey").write.parquet(f"{path}/parquet")
    regions = table(spark, sf_dir, "region").repartitionByRange(1, "r_regionkey").sortWithinPartitions("r_regionkey")
    regions.select("r_name").write.text(f"{path}/txt")
    return path


@query(
    "s7_folder_scan",
    """
    with few as (select * from $orders_gaps order by o_orderkey limit 5), first_nations as (select * from nation order by n_nationkey limit 5),
    files("type", "rows") as (values ('csv', (select count(*) from orders)), ('json', (select count(*) from nation)),
        ('parquet', (select count(*) from supplier)), ('txt', (select count(*) from region))),
    listed("type", "column", missing) as (
        values ('csv', 'o_orderkey', 0), ('csv', 'o_custkey', 0), ('csv', 'o_orderstatus', 0),
            ('csv', 'o_totalprice', (select count(*) from few where o_totalprice is null)),
            ('csv', 'o_orderpriority', (select count(*) from few where o_orderpriority is null)),
            ('json', 'n_nationkey', 0), ('json', 'n_name', (select count(*) from first_nations where n_nationkey % 2 = 1)),
            ('parquet', 's_suppkey', 0), ('parquet', 's_name', 0), ('parquet', 's_nationkey', 0), ('parquet', 's_acctbal', 0))
    select "type", "rows", "column", cast(missing as bigint) as missing from files left join listed using ("type")
    """,
)
def folder_scan(spark, sf_dir):
    """Rows and columns of files in several formats, from one scan of their folder: the rows of all files of a format,
    and the columns of its first file."""
    scanned = cut(scan_folder(spark, scanned_tables(spark, sf_dir)))
    columns = scan_columns(scanned).drop("position")
    formats = scanned.groupBy("type").agg(F.min("path").alias("path"), F.sum("rows").alias("rows"))
    return formats.select("path", "type", "rows").join(columns, "path", "left").drop("path")


@query("s8_preview", "select * from orders order by o_orderkey limit 5")
def first_rows(spark, sf_dir):
    return preview(table(spark, sf_dir, "orders"), "o_orderkey")


@query(
    "s8_preview_summary",
    """
    with few as (select * from $orders_gaps order by o_orderkey limit 5),
    kinds("column", "type") as (values ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'),
        ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'),
        ('o_orderpriority', 'string')),
    counted as ("""
    + per_column("few", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
                 "count(*) filter (where {c} is null) as nulls")
    + """)
    select "column", "type", nulls, (select count(*) from orders) as "rows" from kinds join counted using ("column")
    """,
)
def first_rows_summary(spark, sf_dir):
    return preview_summary(view(spark, sf_dir, "orders_gaps"), "o_orderkey")


@query("s9_csv_sink", "select * from supplier")
def csv_sink(spark, sf_dir):
    path = scratch_path(spark, "sink")
    write_csv(table(spark, sf_dir, "supplier"), path)
    return read_csv(spark, path, schema="s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("s10_output_sink", "select * from $orders_gaps")
def output_sink(spark, sf_dir):
    path = scratch_path(spark, "output")
    gaps = view(spark, sf_dir, "orders_gaps")
    written = write_output(gaps, path)
    back = read_parquet(spark, path)
    if written != gaps.count():
        raise RuntimeError("the output does not hold all rows")
    return back
