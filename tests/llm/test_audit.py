from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest

from burnish.llm.audit import filter_audit, flagged, order_positions, removal_steps, text_faults
from tests.llm.shared import documents, prose

LONG = prose(1, 250)
ROWS = [
    (5, LONG, "a"), (9, LONG, "a"), (9, LONG, "a"), (3, LONG + " #", "a"), (7, None, "a"), (8, "", "a"), (None, "", "a"),
    (11, "one two", "a"), (12, "ONE " * 300, "a"), (13, "ÀÉ " + LONG, "a"), (None, LONG, "a"), (14, "A" * 60_000, "a"),
]
LABELS = [(5, 1, 0), (9, 0, 1), (9, 1, None), (12, 0, 1), (77, 1, 1), (None, 1, 1)]


def labels(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def tables(spark, rows=ROWS):
    docs = documents(spark, rows)
    return docs.selectExpr("*", "if(doc_id = 13, null, if(doc_id < 9, 'x', 'y')) as part_of")


def expected(rows):
    """Each order run filter by filter over (part, faults, good, toxic) of every document."""
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        gone_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                failing = [r for r in here if letter in r[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[1] == {letter} for r in here),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                gone_by[letter] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(gone_by[order[step - 1]])
    return out


def faults(rows):
    """(part, letters failed, good, toxic), one document at a time."""
    good, toxic = {5, 9}, {9, 12}
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = text.split()
        failed = {"A"} if len(words) < 200 else set()
        failed |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        failed |= {"C"} if 100 * sum("A" <= x <= "Z" for x in text) > 3 * len(text) else set()
        failed |= {"D"} if set(text) & set("#$%&*|") else set()
        copies = [j for j, t, _ in rows if (t or "") == text and j is not None and i is not None and j < i]
        failed |= {"E"} if copies else set()
        part = "" if i == 13 else "y" if i is None or i >= 9 else "x"
        out.append((part, failed, i in good, i in toxic))
    return out


def test_audit_agrees_with_running_every_order(spark):
    got = filter_audit(flagged(tables(spark), labels(spark), part_column="part_of")).collect()
    assert len(got) == 3 * 120 * 5
    want = expected(faults(ROWS))
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want


def test_steps_are_the_least_position_of_a_failed_filter():
    orders, positions = order_positions(3)
    fails = np.array([[(m >> k) & 1 for k in range(3)] for m in range(8)], bool)
    steps = removal_steps(fails, positions)
    for m in range(8):
        for o, order in enumerate(orders):
            assert steps[m, o] == next((k for k, f in enumerate(order, 1) if fails[m, f]), 4)


def test_parts_with_nothing_removed_have_zeros(spark):
    masks = spark.createDataFrame([("p", 0, 0, 0, 7)], "part string, mask int, good int, toxic int, rows long")
    got = filter_audit(masks).collect()
    assert len(got) == 600 and {tuple(r)[3:] for r in got} == {(7, 0, 0, 0, 0, 0, 0)}


def test_other_filters_and_empty_tables(spark):
    masks = spark.createDataFrame([("p", 3, 1, 0, 4), ("p", 1, 0, 0, 2)], "part string, mask int, good int, toxic int, rows long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in filter_audit(masks, "XY").collect()}
    assert got == {("XY", 1): (0, 6, 8), ("XY", 2): (0, 0, 4), ("YX", 1): (2, 4, 4), ("YX", 2): (0, 2, 8)}
    empty = tables(spark, [])
    assert filter_audit(flagged(empty, labels(spark), part_column="part_of")).count() == 0
    no_labels = flagged(tables(spark), labels(spark, []), part_column="part_of")
    assert no_labels.where("good + toxic > 0").isEmpty() and no_labels.groupBy().sum("rows").first()[0] == len(ROWS)


def test_copies_of_one_text_are_added_up_in_each_task(spark, plan_of):
    rows = flagged(tables(spark, [(k, "the same text", "a") for k in range(2_000)]), labels(spark), part_column="part_of")
    assert {(r["part"], r["mask"]): r["rows"] for r in rows.groupBy("part", "mask").sum("rows").toDF("part", "mask", "rows").collect()} == {
        ("x", 1): 1, ("x", 17): 8, ("y", 17): 1990, ("", 17): 1
    }


@pytest.mark.parametrize("text, mask", [("", 1), ("a " * 200, 2), ("Ab" * 300, 5), ("\x1cx&", 9), ("é" * 50 + "AB", 5), ("é" * 98 + "AB", 1)])
def test_faults_of_a_text(text, mask):
    assert text_faults(text) == mask
