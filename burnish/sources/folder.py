"""What the files of a folder hold: rows, columns, missing cells and first lines of each file, found in the files."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.columns import MISSING_TOKENS, c
from burnish.sources.ranges import JsonObjects, first_lines, leading, scan

FIRST_ROWS = 5
FIRST_PIECES = 100  # stretches up to a closing brace, among which the first objects of a JSON file are looked for
LINES = ("csv", "tsv", "jsonl", "txt")
SEPARATORS = {"csv": ",", "tsv": "\t"}

COLUMNS = T.ArrayType(T.StructType([T.StructField("column", T.StringType()), T.StructField("missing", T.LongType())]))


def _pattern(kinds: Sequence[str]) -> str:
    """A file name pattern for extensions in any case."""
    return "*.{" + ",".join("".join(f"[{x}{x.upper()}]" for x in kind) for kind in kinds) + "}"


def _file() -> Column:
    return F.col("_metadata.file_path").alias("path")


def _in_order() -> Column:
    """The values of a file's first rows, by line."""
    return F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"])


def columns_of_lines(kind: str, lines: Sequence[str]) -> list[tuple[str, int]]:
    """(column, missing cells) from the first lines of a file; none for text without columns."""
    if kind in SEPARATORS:
        rows = list(csv.reader(lines, delimiter=SEPARATORS[kind]))
        names, cells = (rows[0], rows[1:]) if rows else ([], [])
        return [(n, sum(k >= len(r) or r[k] in MISSING_TOKENS for r in cells)) for k, n in enumerate(names)]
    if kind in ("jsonl", "json"):
        records = _objects("\n".join(lines) if kind == "jsonl" else "}".join(lines) + "}")
        names = dict.fromkeys(n for r in records for n in r)
        return [(n, sum(r.get(n) is None for r in records)) for n in names]
    return []


def _objects(text: str) -> list[dict]:
    """The first objects of a JSON text that are whole, of a list or one after the other."""
    found, at, decoder = [], 0, json.JSONDecoder()
    while len(found) < FIRST_ROWS and (at := text.find("{", at)) >= 0:
        try:
            record, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        found.append(record)
    return found


def _columns(kind: Column, lines: Column) -> Column:
    @F.arrow_udf(COLUMNS)
    def read(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        found = [columns_of_lines(k, t) for k, t in zip(kinds.to_pylist(), texts.to_pylist())]
        rows = [[{"column": n, "missing": m} for n, m in columns] for columns in found]
        return pa.array(rows, pa.list_(pa.struct([("column", pa.string()), ("missing", pa.int64())])))

    return read(kind, lines)


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """One row for each data file below a folder: (path, type, size_kb, rows, columns, preview).

    ``rows`` are lines without the header for csv and tsv, lines for jsonl and txt, list elements for json, and rows for
    parquet. ``columns`` lists each column with its missing cells among the first five rows; txt has none. ``preview``
    is the first five lines, or rows as JSON. All files of a kind are read together, and large ones by many tasks; parquet
    folders are read one after the other, as each has its own schema. Other file types are left out.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("type")
    size = F.round(F.col("_metadata.file_size") / 1024, 2).alias("size_kb")
    found = [_line_files(spark, root, kind, size), _json_files(spark, root, kind, size), *_parquet_files(spark, root, size)]
    return reduce(DataFrame.unionByName, found)


def _reader(spark: SparkSession, kinds: Sequence[str]):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _pattern(kinds))


def _line_files(spark: SparkSession, root: str, kind: Column, size: Column) -> DataFrame:
    raw = _reader(spark, LINES).text(root)
    counted = raw.select(F.xxhash64(F.input_file_name()).alias("file")).groupBy("file").agg(F.count("*").alias("lines"))
    names = _reader(spark, LINES).format("binaryFile").load(root).select(_file(), size, F.xxhash64(F.input_file_name()).alias("file"))
    first = first_lines(raw, FIRST_ROWS + 1).groupBy("file").agg(_in_order().alias("first"))
    files = names.join(counted, "file").join(first, "file").withColumn("type", kind)
    has_header = F.col("type").isin(*SEPARATORS)
    shown = F.slice("first", 1, FIRST_ROWS)
    return files.select(
        "path",
        "type",
        "size_kb",
        (F.col("lines") - F.when(has_header, 1).otherwise(0)).alias("rows"),
        _columns(F.col("type"), F.when(has_header, F.col("first")).otherwise(shown)).alias("columns"),
        F.array_join(shown, "\n").alias("preview"),
    )


def _json_files(spark: SparkSession, root: str, kind: Column, size: Column) -> DataFrame:
    names = _reader(spark, ["json"]).format("binaryFile").load(root).select(_file(), size, F.xxhash64(F.input_file_name()).alias("file"))
    ranges = scan(spark, root, JsonObjects(), _pattern(["json"]))
    records = ranges.records().groupBy("file").agg(F.count("*").alias("rows"))
    starts = ranges.pieces.select("file", "block", F.col("value").cast("string"))
    first = leading(starts, FIRST_PIECES).groupBy("file").agg(_in_order().alias("first"))
    files = names.join(records, "file", "left").join(first, "file", "left")
    files = files.withColumns({"type": kind, "first": F.coalesce("first", F.array().cast("array<string>"))})
    lines = F.split(F.concat(F.array_join("first", "}"), F.lit("}")), "\n")
    return files.select(
        "path",
        "type",
        "size_kb",
        F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
        _columns(F.col("type"), F.col("first")).alias("columns"),
        F.when(F.size("first") > 0, F.substring(F.array_join(F.slice(lines, 1, FIRST_ROWS), "\n"), 1, 2_000)).otherwise("").alias("preview"),
    )


def _parquet_files(spark: SparkSession, root: str, size: Column) -> list[DataFrame]:
    """One table for each folder that holds parquet files; its files have one schema."""
    listed = _reader(spark, ["parquet"]).format("binaryFile").load(root).select(F.col("path").alias("name"))
    folders = listed.select(F.regexp_extract("name", r"^(.*)/[^/]+$", 1).alias("folder")).distinct().collect()
    return [_parquet_folder(spark, folder, size) for folder in sorted(r["folder"] for r in folders)]


def _parquet_folder(spark: SparkSession, folder: str, size: Column) -> DataFrame:
    df = spark.read.option("pathGlobFilter", _pattern(["parquet"])).parquet(folder)
    names = [f.name for f in df.schema.fields]
    counted = df.select(_file(), size).groupBy("path", "size_kb").agg(F.count("*").alias("rows"))
    cells, line = F.struct(*[c(n) for n in names]), F.col("_metadata.row_index")
    first = df.where(line < FIRST_ROWS).select(_file(), cells.alias("value"), line.alias("line"))
    missing = [F.struct(F.lit(n).alias("column"), F.count_if(F.col("value").getField(n).isNull()).alias("missing")) for n in names]
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.to_json("value").alias("text")))), lambda x: x["text"]), "\n")
    first = first.groupBy("path").agg(F.array(*missing).alias("columns"), shown.alias("preview"))
    files = counted.join(first, "path")
    return files.select("path", F.lit("parquet").alias("type"), "size_kb", "rows", "columns", "preview")


def scan_columns(scanned: DataFrame) -> DataFrame:
    """(path, position, column, missing): one row for each column of each file of a scan."""
    listed = scanned.select("path", F.posexplode("columns").alias("position", "found"))
    return listed.select("path", "position", F.col("found.column").alias("column"), F.col("found.missing").alias("missing"))
