"""The most frequent values without moving all values: bounded summaries, an exact count of the few candidates, and a proof.

Each task keeps a Misra-Gries summary of every column: at most ``KEPT`` values with counts that are too low by no more than
the summary's error. Summaries are merged in a tree. A value that is in none of them occurs no more often than the error says;
so once the candidates have been counted exactly, the k-th count being above the error proves that no other value can
reach it. Where it is not, as in a column of unlike values, values are counted by a short key instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.columns import FLOATING, c
from burnish.operators.tree import merged_by_tree
from burnish.operators.values import local_frame

KEPT = 1_024  # values in a summary
SHORT = 32  # characters; a longer text is known by its digest, which has one more with its mark
TIED = 10_000  # values with equal counts and beginnings that are compared in full


def key_of(df: DataFrame, name: str) -> Column:
    """A short text that tells the values of a column apart: the value as text, or the 128-bit digest of a long one."""
    kind = df.schema[name].dataType
    value = c(name) + F.lit(0.0).cast(kind) if isinstance(kind, FLOATING) else c(name)  # no negative zero
    text = value.cast("string")
    if not isinstance(kind, T.StringType):
        return text
    return F.when(F.length(text) <= SHORT, text).otherwise(F.concat(F.lit("#"), F.md5(text.cast("binary"))))


def keyed_cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(at, key): the place of the column among ``names``, and a key for each value that is not missing."""
    keys = df.select(*[key_of(df, n).alias(f"k{i}") for i, n in enumerate(names)])
    cells = keys.unpivot([], [f"k{i}" for i in range(len(names))], "name", "key").where(F.col("key").isNotNull())
    return cells.select(F.substring("name", 2, 9).cast("int").alias("at"), "key")


class Summary:
    """Misra-Gries over batches: counts that are too low by at most ``error``, and no value that is more frequent left out."""

    def __init__(self, kept: int) -> None:
        self.kept, self.error = kept, 0
        self.counts: dict[str, int] = {}

    def add(self, keys: Sequence[str], counts: Sequence[int]) -> None:
        held = self.counts
        for key, n in zip(keys, counts):
            held[key] = held.get(key, 0) + n
        if len(held) > self.kept:
            # What the first one left out has is taken off all.
            off = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -self.kept - 1)[-self.kept - 1])
            self.counts = {key: n - off for key, n in held.items() if n > off}
            self.error += off


SUMMARY = pa.schema([("grp", pa.int64()), ("at", pa.int32()), ("key", pa.string()), ("n", pa.int64())])
SUMMARY_DDL = "grp long, at int, key string, n long"


def summary_rows(grp: int, at: int, summary: Summary) -> pa.RecordBatch:
    """The values of a summary, and one row without a key for its error."""
    keys, counts = [None, *summary.counts], [summary.error, *summary.counts.values()]
    columns = [pa.array([grp] * len(keys), pa.int64()), pa.array([at] * len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=SUMMARY)


def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held: dict[int, Summary] = {}
    for batch in batches:
        for at in pc.unique(batch.column("at")).to_pylist():
            counted = pc.value_counts(batch.column("key").filter(pc.equal(batch.column("at"), at)))
            summary = held.setdefault(at, Summary(KEPT))
            summary.add(counted.field("values").to_pylist(), counted.field("counts").to_pylist())
    for at, summary in held.items():
        yield summary_rows(TaskContext.get().partitionId(), at, summary)


def merged(key: tuple, rows: pa.Table) -> pa.Table:
    """One summary from those of several tasks; errors add up."""
    out = Summary(KEPT)
    errors = pc.is_null(rows.column("key"))
    out.error = pc.sum(rows.column("n").filter(errors)).as_py() or 0
    rest = rows.filter(pc.invert(errors))
    out.add(rest.column("key").to_pylist(), rest.column("n").to_pylist())
    return pa.Table.from_batches([summary_rows(key[0].as_py(), key[1].as_py(), out)])


def summaries(cells: DataFrame) -> DataFrame:
    """(at, key, n): one summary for each column; a row without a key has its error."""
    return merged_by_tree(cells.mapInArrow(summarised, SUMMARY_DDL), ["at"], merged, SUMMARY_DDL)


def certain_counts(df: DataFrame, names: Sequence[str], k: int) -> tuple[dict[str, list[tuple[str, int]]], list[str]]:
    """({column: [(key, rows)]}, columns without proof): every key that is as frequent as the k-th, counted exactly.

    At most ``KEPT`` keys for each column reach the driver, of at most 33 characters.
    """
    if not names:
        return {}, []
    cells = keyed_cells(df, names)
    kept: dict[int, dict[str, int]] = {i: {} for i in range(len(names))}
    error = dict.fromkeys(kept, 0)
    for r in summaries(cells).collect():
        if r["key"] is None:
            error[r["at"]] = r["n"]
        else:
            kept[r["at"]][r["key"]] = r["n"]

    def kth(counts: dict[str, int]) -> int:
        return sorted(counts.values(), reverse=True)[k - 1] if len(counts) >= k else 0

    candidates = []
    for i, counts in kept.items():
        if error[i]:
            least = kth(counts)
            candidates += [(i, key) for key, n in counts.items() if n + error[i] >= least]
    if candidates:
        exact: dict[int, dict[str, int]] = {i: {} for i, _ in candidates}
        table = local_frame(df.sparkSession, candidates, "at int, key string")
        for r in cells.join(F.broadcast(table), ["at", "key"], "left_semi").groupBy("at", "key").count().collect():
            exact[r["at"]][r["key"]] = r["count"]
        kept |= exact
    unproven = [i for i in kept if error[i] and kth(kept[i]) <= error[i]]
    out = {names[i]: [(key, n) for key, n in counts.items() if n >= kth(counts)] for i, counts in kept.items() if i not in unproven}
    return out, [names[i] for i in unproven]


def _tied_keys(df: DataFrame, name: str, k: int) -> list[tuple[str, int]] | None:
    """Keys as frequent as the k-th, of equal ones those that begin lowest; None if too many begin alike.

    Every value is counted by its key, so that no long text is moved; of each key the start of its value goes along.
    """
    counted = df.where(c(name).isNotNull()).groupBy(key_of(df, name).alias("key"))
    counted = counted.agg(F.count("*").alias("n"), F.min(F.substring(c(name), 1, SHORT)).alias("start"))
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "start")  # each task offers its first k, and ties
    first = counted.withColumn("place", F.rank().over(place)).where(F.col("place") <= k)
    rows = first.select("key", "n").limit(TIED + 1).collect()
    return None if len(rows) > TIED else [(r["key"], r["n"]) for r in rows]


def top_texts(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """(column, value, n, rank): the k most frequent values of each text column, the smaller one first on ties."""
    spark = df.sparkSession
    found, unproven = certain_counts(df, names, k)
    plain = []
    for name in unproven:
        tied = _tied_keys(df, name, k)
        if tied is None:
            plain.append(name)
        else:
            found[name] = tied
    rows = [(name, key, n) for name, entries in found.items() for key, n in entries]
    counted = local_frame(spark, rows, "column string, key string, n long")
    parts = [counted.where(F.length("key") <= SHORT).select("column", F.col("key").alias("value"), "n")]
    for name in sorted({name for name, key, _ in rows if len(key) > SHORT}):
        wanted = counted.where((F.col("column") == name) & (F.length("key") > SHORT))
        whole = df.select(c(name).alias("value"), key_of(df, name).alias("key")).where(F.length("value") > SHORT)
        whole = whole.join(F.broadcast(wanted), "key").groupBy("key", "n").agg(F.min("value").alias("value"))
        parts.append(whole.select(F.lit(name).alias("column"), "value", "n"))
    for name in plain:
        by_value = df.where(c(name).isNotNull()).groupBy(c(name).alias("value")).agg(F.count("*").alias("n"))
        parts.append(by_value.select(F.lit(name).alias("column"), "value", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def modes(df: DataFrame, names: Sequence[str], as_text: bool = False) -> dict[str, object]:
    """{column: its most frequent value, the smallest one on ties; None without values}, from one search for all columns."""
    found, unproven = certain_counts(df, names, 1)
    out: dict[str, object] = dict.fromkeys(names)
    texts = [n for n in unproven if isinstance(df.schema[n].dataType, T.StringType)]
    for name, entries in found.items():
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType) and any(len(key) > SHORT for key, _ in entries):
            texts.append(name)
        elif entries:
            keys = local_frame(df.sparkSession, [(key,) for key, _ in entries], "key string")
            least = F.min_by("key", F.col("key").cast(kind))
            out[name] = keys.agg(least if as_text else least.cast(kind)).first()[0]
    for r in top_texts(df, texts, 1).collect() if texts else []:
        out[r["column"]] = r["value"]
    for name in unproven:
        if name not in texts:  # numbers and times are short: counted as they are
            counted = df.where(c(name).isNotNull()).groupBy(c(name).alias("v")).agg(F.count("*").alias("n"))
            least = F.min_by("v", F.struct(-F.col("n"), F.col("v")))
            out[name] = counted.agg(least.cast("string") if as_text else least).first()[0]
    return out
