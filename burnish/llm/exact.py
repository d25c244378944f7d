"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import SPACES, keep, unused

#: A prime below 2**31, so that products of residues fit 64 bits, and the two bases of the polynomial.
PRIME = 2**31 - 1
BASES = (1_103_515_245, 1_629_267_613)
#: Bytes that are hashed or compared at once.
CHUNK = 65_536


def _powers(base: int) -> np.ndarray:
    out = np.empty(CHUNK, np.uint64)
    value = 1
    for k in range(CHUNK):
        out[k] = value
        value = value * base % PRIME
    return out[::-1].copy()


_POWERS: dict[int, np.ndarray] = {}


def chunk_hash(data: np.ndarray, base: int) -> int:
    """The polynomial over one chunk. Every byte counts one more than its value, so leading zeros count too."""
    if base not in _POWERS:
        _POWERS[base] = _powers(base)
    # At most 2**16 products below 2**40 are added, which stays below 2**64.
    return int(np.dot(data.astype(np.uint64) + np.uint64(1), _POWERS[base][CHUNK - len(data) :])) % PRIME


def joined_hash(left: int, right: int, right_length: int, base: int) -> int:
    """The hash of two stretches put together, from the hash of each: the left one shifts by the right one's length."""
    return (left * pow(base, right_length, PRIME) + right) % PRIME


def fingerprint(data: bytes | memoryview) -> int:
    """62 bits for a text of any length, from hashes of its chunks."""
    array = np.frombuffer(data, np.uint8)
    out = 0
    for base in BASES:
        whole = 0
        for at in range(0, len(array), CHUNK):
            part = array[at : at + CHUNK]
            whole = joined_hash(whole, chunk_hash(part, base), len(part), base)
        out = out << 31 | whole
    return out


def fingerprints(data: Column) -> Column:
    """The fingerprint of each cell of a binary column."""

    @F.arrow_udf("bigint")
    def of(cells: pa.Array) -> pa.Array:
        return pa.array((fingerprint(cell.as_buffer()) for cell in cells), pa.int64())

    return of(data)


def normalised(text: Column) -> Column:
    """A text with each run of white space as one blank; a missing text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _unequal(rows: DataFrame) -> DataFrame:
    """The (fingerprint, size) of groups whose texts differ somewhere.

    Texts are compared chunk by chunk: the least and the greatest chunk at each place of a group must be the same.
    Copies meet in each task before the shuffle, so a group of any size costs one chunk a task.
    """
    place = F.explode(F.sequence(F.lit(0), F.floor((F.greatest("n_bytes", F.lit(1)) - 1) / CHUNK).cast("int")))
    chunks = rows.select("fp", "n_bytes", "data", place.alias("place")).select(
        "fp", "n_bytes", "place", F.substring("data", F.col("place") * CHUNK + 1, F.lit(CHUNK)).alias("chunk")
    )
    ends = chunks.groupBy("fp", "n_bytes", "place").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return ends.where("least <> most").select("fp", "n_bytes").distinct()


def exact_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Which rows have equal texts once runs of white space count as one blank.

    One row per row of ``df``: the id, ``keep_id`` (the id of the row of the group that stays: the one with the
    smallest id), ``group_size``, ``kept``, ``text_sha256`` of the normalised text, and ``row_no``, which tells rows
    of the same id apart.

    Missing texts count as empty, and empty texts are equal to each other. Rows without an id stay only where no row
    of their group has one; of rows with the same id and text one stays. An empty table gives an empty result. Other
    columns are not looked at.

    Rows are grouped by a polynomial fingerprint and the size; where the chunkwise comparison then finds that texts
    of one fingerprint differ, the digest tells them apart.
    """
    texts = df.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("norm"))
    data = texts.select("doc_id", "norm", F.encode("norm", "UTF-8").alias("data"))
    data = data.select("doc_id", "norm", "data", F.octet_length("data").cast("long").alias("n_bytes"))
    data = data.withColumn("fp", fingerprints(F.col("data")))
    rows = keep(
        data.select(
            "doc_id", "fp", "n_bytes", F.sha2("data", 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "fingerprints",
    )
    unequal = keep(_unequal(data), "unequal").withColumn("differ", F.lit(True))
    rows = rows.join(unequal, ["fp", "n_bytes"], "left")
    rows = rows.withColumn("tie", F.when(F.col("differ"), F.col("text_sha256")).otherwise(""))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("first")
    groups = keep(rows.groupBy("fp", "n_bytes", "tie").agg(first, F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["fp", "n_bytes", "tie"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        "text_sha256",
        "row_no",
    )


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` without exact copies, with their columns. See ``exact_duplicates`` for which row stays."""
    row = unused(df, "_row")
    marked = keep(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = keep(exact_duplicates(marked, row, text_column).select(F.col("doc_id").alias("row"), "keep_id"), "copies")
    # Within a group the row with the smallest id stays; of rows with the same id, the first.
    ids = marked.select(F.col(row).alias("row"), F.col(id_column).alias("id"))
    groups = found.join(ids, "row").groupBy("keep_id")
    best = groups.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return marked.join(best.select(F.col("first.row").alias(row)), row, "left_semi").select(*df.columns)
