"""Near-duplicates among embeddings by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import components, keep

#: Vectors drawn for the fit of the index, at any size of the table, and reference points chosen among them.
DRAWN = 2_048
PIVOTS = 256
#: How many of the nearest reference points describe a vector, and how many of those two vectors must share to be
#: compared.
NEAREST = 7
SHARED = 3
#: Vectors of one list that are compared at once. Longer lists are cut into blocks, compared pair by pair of blocks.
BLOCK = 256


def far_apart(units: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the given unit vectors, each as far as can be from those before it.

    Drawn at random, a dense group of vectors would hold many pivots, and which of them are nearest would change with
    the slightest difference; far apart, it holds one or none.
    """
    chosen, near = [0], units @ units[0]
    while len(chosen) < min(count, len(units)):
        at = int(np.argmin(near))
        if near[at] > 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, units @ units[at])
    return units[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first. Equal distances go to the smaller number."""
    near = vectors @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :nearest]


def list_keys(nearest: np.ndarray, shared: int, base: int) -> np.ndarray:
    """For each vector, the numbers of its inverted lists: one for each choice of ``shared`` of its pivots."""
    ordered = np.sort(nearest, axis=1)
    out = np.zeros((len(ordered), 0), np.int64)
    for choice in combinations(range(ordered.shape[1]), shared):
        key = np.zeros(len(ordered), np.int64)
        for k in choice:
            key = key * base + ordered[:, k]
        out = np.column_stack([out, key])
    return out


def first_shared(a: np.ndarray, b: np.ndarray, shared: int, base: int) -> np.ndarray:
    """For pairs of pivot sets, the least key they share: that of the ``shared`` smallest pivots in both."""
    a = np.sort(a, axis=1)
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    place = np.cumsum(both, axis=1)
    key = np.zeros(len(a), np.int64)
    for k in range(1, shared + 1):
        at = np.argmax(both & (place == k), axis=1)
        key = key * base + a[np.arange(len(a)), at]
    return key


def _fitted(vector: list, size: int) -> list:
    return (vector + [0.0] * size)[:size]


def _described(pivots: np.ndarray, nearest: int, shared: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_fitted(x, pivots.shape[1]) for x in batch.column(1).to_pylist()]
            if not rows:
                continue
            near = nearest_pivots(np.array(rows, np.float64), pivots, nearest)
            keys = list_keys(near, shared, PIVOTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(near.tolist(), pa.list_(pa.int32())), pa.array(keys.tolist(), pa.list_(pa.int64()))],
                names=["rep", "near", "keys"],
            )

    return describe


def compare_cell(rows: dict[str, np.ndarray], threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one cell, a block of a list against itself or another block of it.

    For each row: the number of vectors it is linked with by links that belong to this list, and the smallest id it
    reaches within the cell. A pair that meets in several lists belongs to the one with the least key, so it counts
    once; as a pair of blocks is one cell, it also meets in one cell only.
    """
    unit = rows["vector"] / np.linalg.norm(rows["vector"], axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    own, pair = rows["block"], (rows["low"][0], rows["high"][0])
    if pair[0] != pair[1]:
        linked &= own[:, None] != own[None, :]
    i, j = np.nonzero(linked)
    count = np.zeros(len(own), np.int64)
    if len(i):
        mine = first_shared(rows["near"][i], rows["near"][j], shared, PIVOTS) == rows["key"][0]
        np.add.at(count, i[mine], rows["copies"][j[mine]])
    reach = rows["rep"].copy()
    while len(i):
        before = reach.copy()
        np.minimum.at(reach, i, before[j])
        if (reach == before).all():
            break
    return count, reach


FOUND = "rep long, links long, reach long"


def _compared(threshold: float, shared: int):
    """Compares rows that come sorted by cell; a cell may reach over several batches."""

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        out = {n: table.column(n).to_numpy() for n in ("rep", "copies", "key", "block", "low", "high", "dims", "label")}
        n = len(table)
        out["vector"] = np.array(table.column("vector").to_pylist(), np.float64).reshape(n, -1)
        out["near"] = np.array(table.column("near").to_pylist(), np.int64).reshape(n, -1)
        return out

    def result(table: pa.Table) -> pa.RecordBatch | None:
        # A batch holds many small cells; vectors of different length are never in the same one.
        cell = [table.column(n).to_numpy() for n in ("label", "dims", "key", "low", "high")]
        change = np.zeros(len(table), bool)
        for column in cell:
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change), len(table)]
        ids, links, reach = [], [], []
        for a, b in zip(starts, starts[1:]):
            if b - a > 1:
                rows = columns(table.slice(a, b - a))
                count, low = compare_cell(rows, threshold, shared)
                some = (count > 0) | (low != rows["rep"])
                ids += rows["rep"][some].tolist()
                links += count[some].tolist()
                reach += low[some].tolist()
        if not ids:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (ids, links, reach)], names=["rep", "links", "reach"]
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            # All cells but the last are whole.
            cell = [held.column(n).to_numpy() for n in ("label", "dims", "key", "low", "high")]
            last = np.ones(len(held), bool)
            for column in cell:
                last &= column == column[-1]
            whole = len(held) - int(last.sum())
            if whole:
                if (done := result(held.slice(0, whole))) is not None:
                    yield done
                held = held.slice(whole)
        if held is not None and (done := result(held)) is not None:
            yield done

    return compare


def near_vectors(
    df: DataFrame,
    threshold: float = 0.98,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Links between vectors of the same label whose cosine, in double precision, is at least ``threshold``.

    One row per row of ``df``: vec_id, n_links (other rows linked with it), component_id (the smallest vec_id that
    links reach, itself included), kept (vec_id = component_id) and ``row_no``, which tells rows of one id apart.

    Equal vectors of a label are compared as one. Each distinct vector is described by its NEAREST nearest of PIVOTS
    reference points, and two vectors are compared when they share SHARED of them: there is an inverted list for each
    set of SHARED pivots. Reference points are chosen, far from each other, among the DRAWN distinct vectors with the
    smallest hashes; every vector is indexed. Every pair found is tested exactly. Lists of any length are compared whole, block by block.

    Missing, empty or zero vectors, vectors with missing or non-finite components, and rows without a label link with
    nothing; so do vectors of different length. Rows without an id link like others and have no component id smaller
    than an id. Repeated rows link with each other. An empty table gives an empty result. Other columns are not looked
    at.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(label_column).alias("label"),
        F.transform(vector_column, lambda x: x.cast("double")).alias("vector"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~broken & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = keep(rows.withColumn("usable", usable), "vectors")
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row_no")).alias("first")
    same = rows.where("usable").groupBy("label", "vector").agg(first, F.count("*").alias("copies"))
    same = keep(
        same.select(
            F.col("first.row_no").alias("rep"), F.col("first.vec_id").alias("rep_id"), "label", "vector", "copies",
            F.size("vector").alias("dims"),
        ),
        "distinct",
    )
    order = F.xxhash64("vector", F.lit(11))
    # DRAWN rows at most.
    drawn = [r["vector"] for r in same.select("vector").orderBy(order, "vector").limit(DRAWN).collect()]
    if not drawn:
        none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), "row_no")
        return none.withColumn("kept", F.lit(True))
    longest = max(map(len, drawn))
    units = np.array([_fitted(x, longest) for x in drawn], np.float64)
    pivots = far_apart(units / np.linalg.norm(units, axis=1, keepdims=True), PIVOTS)
    nearest = min(NEAREST, len(pivots))
    shared = min(SHARED, nearest)
    index = keep(
        same.select("rep", "vector").mapInArrow(
            _described(pivots, nearest, shared), "rep long, near array<int>, keys array<long>"
        ),
        "index",
    )
    lists = same.select("rep", "label", "dims").join(index, "rep")
    lists = keep(lists.select("rep", "label", "dims", F.explode("keys").alias("key")), "lists")
    on = ["label", "dims", "key"]
    sizes = keep(lists.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cells = lists.join(sizes, on).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = keep(
        cells.select(
            "rep", *on, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        ),
        "cells",
    )
    told = same.select("rep", "vector", "copies").join(index.select("rep", "near"), "rep")
    filled = cells.join(told, "rep")
    at = ["label", "dims", "key", "low", "high"]
    dealt = filled.repartition(*at).sortWithinPartitions(*at)
    found = keep(
        dealt.select("rep", "copies", "block", *at, "vector", "near").mapInArrow(_compared(threshold, shared), FOUND),
        "found",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select("rep", "reach"), "rep", "reach")
    # Components are numbered by rows; the answer is the smallest id among the rows of each.
    named = same.select("rep", "rep_id", "copies").join(
        groups.select(F.col("id").alias("rep"), F.col("component_id").alias("root")), "rep", "left"
    )
    named = keep(named.withColumn("root", F.coalesce("root", "rep")).join(links, "rep", "left"), "named")
    least = named.groupBy("root").agg(F.min("rep_id").alias("component_id"))
    named = named.join(least, "root").select(
        "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    named = keep(same.select("label", "vector", "rep").join(named, "rep"), "named")
    out = rows.join(named, ["label", "vector"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        "row_no",
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
