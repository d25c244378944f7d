"""Readers that mark missing values the same way for every format: as NULL."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burnish.functions.columns import INFINITY_SHAPE, MISSING_TOKENS, NUMBER_SHAPE, c, nan_to_null, parse_number
from burnish.operators.quantiles import one_row
from burnish.operators.values import local_frame
from burnish.session import scratch_path
from burnish.sources.ranges import DelimitedLines, JsonObjects, first_lines, scan

PREVIEW_LINES = 5
WHOLE_SHAPE = r"^\s*[+-]?\d{1,18}\s*$"
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet", ".txt": "text"}


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", schema: str | None = None, quoted_newlines: bool | None = None
) -> DataFrame:
    """Delimited text with a header. Missing tokens become NULL; types are found in one pass unless given.

    Types are those of the whole column: long, double, boolean or string. With a ``schema`` no pass is needed.
    All files are split among tasks. Those with line breaks inside quotes take a scan of their ranges first; which they
    are is looked up in one pass over the lines, or told by ``quoted_newlines`` for all files. A file whose last
    quote is never closed is read whole by one task. Lines end with a line feed, with or without a carriage return.
    """
    tokens = delimited_cells(spark, path, sep, quoted_newlines)
    tokens = tokens.select(*[F.when(~c(n).isin(*MISSING_TOKENS), c(n)).alias(n) for n in tokens.columns])
    if schema is not None:
        fields = StructType.fromDDL(schema).fields
        return tokens.select(*[_typed(c(f.name), f.dataType.simpleString()).alias(f.name) for f in fields])
    kinds = infer_types(tokens)
    return tokens.select(*[_typed(c(n), kinds[n]).alias(n) for n in tokens.columns])


def delimited_cells(spark: SparkSession, path: str, sep: str = ",", quoted_newlines: bool | None = None) -> DataFrame:
    """The cells of delimited text with a header, all as text. Columns are those of the first file, by position.

    Where files need a scan, columns made from folder names are left out.
    """
    reader = lambda: spark.read.options(header=True, sep=sep, escape='"', quote='"')
    if quoted_newlines is False:
        return reader().csv(path)
    files = odd_quotes(spark, path)
    spanning = sorted(f for f, odd in files.items() if odd or quoted_newlines)
    if not spanning:
        return reader().csv(path)
    names = reader().option("multiLine", True).csv(_as_path(min(files))).columns
    ranges = scan(spark, [_as_path(f) for f in spanning], DelimitedLines(sep))
    # A scan knows files by a hash of their path.
    hashes = local_frame(spark, [(f,) for f in spanning], "path string").withColumn("file", F.xxhash64("path"))
    left_open = ranges.starts.where("last and left_open").join(F.broadcast(hashes), "file")
    unclosed = sorted(r["path"] for r in left_open.select("path").collect())
    cells = ", ".join(f"_{k} string" for k in range(len(names)))
    read = F.from_csv("value", cells, {"sep": sep, "escape": '"', "quote": '"'})
    parts = []
    if len(unclosed) < len(spanning):
        skipped = ranges.starts.where("last and left_open").select("file")
        records = ranges.records().join(F.broadcast(skipped), "file", "left_anti") if unclosed else ranges.records()
        parts.append(records.where("not first").select(read.alias("read")).select("read.*"))
    if plain := sorted(files.keys() - set(spanning)):
        parts.append(_by_position(reader().csv([_as_path(f) for f in plain]), len(names)))
    if unclosed:
        parts.append(_by_position(reader().option("multiLine", True).csv([_as_path(f) for f in unclosed]), len(names)))
    return reduce(DataFrame.unionAll, parts).toDF(*names)


def _as_path(url: str) -> str:
    """The path of a file, as a reader takes it, from the address that Spark gives: unquoted, and no pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(url))


def _by_position(df: DataFrame, count: int) -> DataFrame:
    """The first columns of a table; missing ones are NULL."""
    have = [c(n) for n in df.columns[:count]]
    return df.select(*have, *[F.lit(None).cast("string").alias(f"_{k}") for k in range(len(have), count)])


def odd_quotes(spark: SparkSession, path: str) -> dict[str, bool]:
    """{file: whether some line holds an odd number of quotes, as the first line of a broken-up cell does}.

    One row for each file reaches the driver, as it does when Spark lists them.
    """
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    odd = quotes % 2 == 1
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), odd.alias("odd"))
    files = lines.groupBy("file").agg(F.bool_or("odd").alias("odd"))
    return {r["file"]: r["odd"] for r in files.collect()}


def infer_types(df: DataFrame) -> dict[str, str]:
    """{column: type} of text columns, from counts of what reads as each type, all in one aggregate."""
    aggs: dict[tuple[str, str], Column] = {}
    for n in df.columns:
        text = c(n)
        aggs[n, "filled"] = F.count(text)
        aggs[n, "bigint"] = F.count_if(text.rlike(WHOLE_SHAPE))
        aggs[n, "double"] = F.count_if(text.rlike(NUMBER_SHAPE) | text.rlike(INFINITY_SHAPE))
        aggs[n, "boolean"] = F.count_if(text.isin("True", "False", "TRUE", "FALSE", "true", "false"))
    values = one_row(df, aggs)
    out = {}
    for n in df.columns:
        fits = [k for k in ("bigint", "double", "boolean") if values[n, k] == values[n, "filled"]]
        out[n] = fits[0] if fits and values[n, "filled"] else "double" if not values[n, "filled"] else "string"
    return out


def _typed(text: Column, kind: str) -> Column:
    if kind == "string":
        return text
    if kind == "double":
        return parse_number(text)
    return F.trim(text).try_cast(kind)


def read_tsv(
    spark: SparkSession, path: str, schema: str | None = None, quoted_newlines: bool | None = None
) -> DataFrame:
    return read_csv(spark, path, "\t", schema, quoted_newlines)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object per line. A given schema saves the pass that finds one."""
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.json(path))


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Documents that are lists of objects, or an object each. A file of any size is cut into ranges for many tasks.

    A given ``schema`` saves a copy of the data: to find one, the objects are written as JSON lines, which are then read.
    Elements that are no objects, and an object that the end of a file cuts off, count as unreadable records.
    """
    records = scan(spark, path, JsonObjects()).records()
    if schema is not None:
        read = F.from_json("value", schema)
        return nan_to_null(records.select(F.coalesce(read, F.struct(*[read[n] for n in StructType.fromDDL(schema).names])).alias("r")).select("r.*"))
    lines = scratch_path(spark, "json-lines")
    records.select(F.regexp_replace("value", r"[\r\n]+", " ").alias("value")).write.text(lines)
    return read_json_lines(spark, lines)


def read_parquet(spark: SparkSession, path: str, nan_as_null: bool = True) -> DataFrame:
    """Parquet. ``nan_as_null=False`` keeps filters on float columns in the scan, for data known to hold no NaN."""
    df = spark.read.parquet(path)
    return nan_to_null(df) if nan_as_null else df


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row per line."""
    return spark.read.text(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Read by file extension."""
    extension = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {
        "csv": read_csv, "tsv": read_tsv, "json": read_json_array, "jsonl": read_json_lines,
        "parquet": read_parquet, "text": read_text,
    }
    if extension not in FORMATS:
        raise ValueError(f"unsupported file type: {extension}")
    return readers[FORMATS[extension]](spark, path)


def text_preview(spark: SparkSession, path: str, lines: int = PREVIEW_LINES) -> DataFrame:
    """(file, line, value): the first lines of each file, from 1, whatever the files hold.

    Only lines from the start of a file are looked at, each task offers no more than ``lines`` of a file, and no file is loaded into a cell.
    """
    reader = lambda: spark.read.option("recursiveFileLookup", True)
    names = reader().format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("name"), F.xxhash64(F.input_file_name()).alias("file"))
    found = first_lines(reader().text(path), lines).join(names, "file")
    return found.select(F.col("name").alias("file"), "line", "value")


def document_preview(spark: SparkSession, path: str, characters: int = 2_000) -> DataFrame:
    """(file, preview): the first characters of each document that is not a table, from its first lines."""
    first = text_preview(spark, path, characters).withColumn("value", F.substring("value", 1, characters))
    lines = F.array_sort(F.collect_list(F.struct("line", "value")))
    text = F.array_join(F.transform(lines, lambda x: x["value"]), "\n")
    return first.groupBy("file").agg(F.substring(text, 1, characters).alias("preview"))
