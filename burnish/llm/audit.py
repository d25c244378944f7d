"""What a chain of filters removes in every order of its filters: an audit from masks, without running the chains."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed value: characters that texts of prose do not hold.
MARKS = re.compile(rb"[#$%&*|]")

#: The filters by letter; the bit of a letter in a mask is set where a document fails that filter.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")


def text_faults(text: str) -> int:
    """Which of the filters A to D a text fails: too few words, too few different words, too many capitals, marks."""
    data = text.encode()
    words = data.split()
    faults = len(words) < 200
    faults |= (100 * len(set(words)) < 50 * len(words)) << 1
    faults |= (100 * (len(data) - len(data.translate(None, CAPITALS))) > 3 * len(text)) << 2
    return faults | (MARKS.search(data) is not None) << 3


@F.arrow_udf(T.IntegerType())
def faults_of(cells: pa.Array) -> pa.Array:
    return pa.array([text_faults(cell.as_py() or "") for cell in cells], pa.int32())


def flagged(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """(part, mask, good, toxic, rows): how many documents share a mask and labels.

    ``mask`` has a bit for each filter that a document fails; the last one is set where some document with a smaller id
    has the same text. A missing text is an empty one, a missing part is the empty one. A document is good or toxic if
    any row of ``labels`` (doc_id, quality, toxic) for its id says so; a row without an id has no label, is no copy and makes no
    other row one. Repeated rows count each, and rows of one id are no copies of each other. Other columns are not looked
    at. Empty tables give no rows.

    Texts move as 256-bit digests only, and equal texts of one part and label are added up in each task, so no text that
    very many documents share gathers in one task.
    """
    one, any_of = F.lit(1), lambda n: F.max(F.coalesce((F.col(n) == 1).cast("int"), F.lit(0))).alias(n)
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    marked = marked.agg(any_of("quality"), any_of("toxic"))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        faults_of(text).alias("mask"),
    )
    # Rows of one id and text first, so that the smallest id of a text can be counted however often it is repeated.
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(one).alias("n"))
    joined = rows.where("id is not null").join(marked, "id", "left").unionByName(
        rows.where("id is null"), allowMissingColumns=True
    )
    cells = joined.groupBy(
        "digest", "part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    ).agg(
        F.sum("n").alias("n"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_without"),
    )
    each = cells.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    firsts = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0) + F.col("n_without")
    split = F.array(
        F.struct(F.col("mask"), firsts.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - firsts).alias("n")),
    )
    counted = each.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    return counted.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("rows"))


AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def order_positions(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of the filters, and for each the step (from 1) at which each filter comes: the inverse permutations."""
    orders = list(permutations(range(filters)))
    return orders, np.argsort(np.array(orders), axis=1) + 1


def removal_steps(fails: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """For each mask (row) and order (column) the step that removes it; one more than there are filters if none does.

    This is the product of the two matrices in which the minimum stands for the sum and the sum for the product: a
    filter that a mask passes adds infinity, and the least position of those it fails is left.
    """
    never = positions.shape[1] + 1
    added = np.where(fails, 0, never)
    return np.minimum((added[:, None, :] + positions[None, :, :]).min(axis=2), never)


def audited(part: str, masks: np.ndarray, rows: np.ndarray, good: np.ndarray, toxic: np.ndarray, letters: str) -> dict:
    """The audit of one part from its masks with their row counts; a dictionary of columns."""
    n = len(letters)
    fails = (masks[:, None] >> np.arange(n)) & 1 == 1
    orders, positions = order_positions(n)
    steps = removal_steps(fails, positions)

    def scattered(weights: np.ndarray) -> np.ndarray:
        """By order and step, the sum of weights of what is removed there."""
        out = np.zeros((len(orders), n + 2), np.int64)
        np.add.at(out, (np.broadcast_to(np.arange(len(orders)), steps.shape), steps), np.broadcast_to(weights[:, None], steps.shape))
        return out[:, 1 : n + 1]

    removed = scattered(rows)
    at = np.array(orders)
    failing = (fails * rows[:, None]).sum(axis=0)[at]
    alone = fails & (fails.sum(axis=1) == 1)[:, None]
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, at, removed)
    names = ["".join(letters[k] for k in order) for order in orders]
    columns = {
        "part": [part] * (len(orders) * n),
        "filter_order": np.repeat(names, n),
        "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
        "kept": rows.sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": failing - removed,
        "unique_fails": (alone * rows[:, None]).sum(axis=0)[at],
        "good_lost": scattered(good),
        "toxic_lost": scattered(toxic),
        "shapley": shapley[at],
    }
    return {name: x.ravel() if isinstance(x, np.ndarray) else x for name, x in columns.items()}


def filter_audit(masks: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """One row for each part, order of filters and step, from rows (part, mask, good, toxic, rows) of any number.

    ``filter_order`` names the order, ``step`` the place in it from 1. Within the part: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (fails its filter, removed earlier), ``unique_fails`` (fails its filter and no other),
    ``good_lost`` and ``toxic_lost`` of the removed, and ``shapley``: what its filter removes, summed over all orders.
    Every order and step is there, with zeros where nothing falls. Rows are added up by mask first: a part has at most
    4 * 2^filters of them, whatever its size, and parts are audited side by side.
    """
    letters = "".join(letters)
    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in AUDIT)
    weight = lambda n: F.sum(F.when(F.col(n) > 0, F.col("rows")).otherwise(0)).alias(n)
    added = masks.groupBy("part", "mask").agg(F.sum("rows").alias("rows"), weight("good"), weight("toxic"))

    def audit(key: tuple, group: pa.Table) -> pa.Table:
        take = lambda n: group.column(n).to_numpy().astype(np.int64)
        return pa.table(audited(key[0].as_py(), take("mask"), take("rows"), take("good"), take("toxic"), letters))

    return added.groupBy("part").applyInArrow(audit, schema)
