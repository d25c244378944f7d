"""Compare the registered queries with their SQL: python check.py [sf_dir] [name prefix...]"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from burnish.session import SETTINGS
from queries import oracle, registered
from queries.registry import TABLES


def session(cores: int = 8, partitions: int = 8) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("burnish")
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(value: object) -> str:
        if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
            return repr([round(float(v), 6) for v in value])
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "NULL"
        if hasattr(value, "item"):
            value = value.item()
        if isinstance(value, bool):
            return str(value)
        if isinstance(value, (int, float)):
            return repr(float(value))
        return str(value)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


# Spark type names and the type names of the checking database.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def differences(result: DataFrame, relation: duckdb.DuckDBPyRelation) -> tuple[str, int]:
    """What differs between the two, empty when nothing does, and the row count."""
    spark_frame, sql_frame = result.toPandas(), relation.df()
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(sql_frame.columns)}", len(spark_frame)
    left, right = canonical(spark_frame), canonical(sql_frame)
    if len(left) != len(right):
        return f"rows {len(left)} against {len(right)}", len(left)
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        return f"{len(unequal)} rows differ, such as\n    {unequal[0][0]}\n    {unequal[0][1]}", len(left)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    mine = {f.name: f.dataType.simpleString() for f in result.schema.fields}
    other = {n: (k, theirs[n]) for n, k in mine.items() if TYPES.get(k, theirs[n]) != theirs[n]}
    return (f"types {other}" if other else ""), len(left)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = tuple(sys.argv[2:])
    spark, connection = session(), database(sf_dir)
    sqls, failures = oracle(), 0
    for name, run in registered().items():
        if wanted and not name.startswith(wanted):
            continue
        started, rows = time.time(), 0
        try:
            result = run(spark, sf_dir)
            if name in sqls:
                problem, rows = differences(result, connection.sql(sqls[name]))
            else:
                problem, rows = "", len(result.toPandas())
        except Exception:
            problem = traceback.format_exc(limit=-3)
        spent = time.time() - started
        label = "FAIL" if problem else "ok" if name in sqls else "rows"
        failures += bool(problem)
        print(f"{label:4}  {name:28} {rows:7} rows {spent:6.2f}s {problem}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(min(1, main()))
