"""The most frequent values against pandas, and what crosses the shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F

from burnish.operators import heavy
from burnish.operators.heavy import Summary, certain_counts, keyed_cells, modes, top_texts


def expected(values, k):
    counts = {}
    for v in values:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    return sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k]


def columns(seed, rows):
    draw = random.Random(seed)
    long = "x" * 40
    return {
        "few": [draw.choice(["a", "b", "c", None]) for _ in range(rows)],
        "skewed": [f"v{int(draw.paretovariate(0.6))}" for _ in range(rows)],
        "long": [long + f"{int(draw.paretovariate(0.8)):06d}" for _ in range(rows)],
        "unlike": [f"{draw.random():.9f}" * draw.choice([1, 5]) for _ in range(rows)],
        "twice": [f"k{i // 2:07d}" for i in range(rows)],
        "alike": [long * 2 + f"{i:07d}" for i in range(rows)],
        "none": [None] * rows,
    }


@pytest.mark.parametrize("k", [1, 10])
def test_top_texts(spark, k, monkeypatch):
    monkeypatch.setattr(heavy, "TIED", 500)
    data = columns(k, 6_000)
    ddl = ", ".join(f"{n} string" for n in data)
    df = spark.createDataFrame(list(zip(*data.values())), ddl).repartition(40)
    got = {}
    for r in top_texts(df, list(data), k).orderBy("column", "rank").collect():
        got.setdefault(r["column"], []).append((r["value"], r["n"]))
    assert got == {n: expected(v, k) for n, v in data.items() if n != "none"}
    _, unproven = certain_counts(df, list(data), k)
    assert set(unproven) == {"unlike", "twice", "alike"}
    assert modes(df, list(data)) == {n: (expected(v, 1) or [(None,)])[0][0] for n, v in data.items()}


def test_modes_of_other_types(spark):
    rows = [(None if k % 7 == 0 else float(k % 5), k % 3 == 0, k, -0.0 if k % 2 else 0.0, f"2024-01-{1 + k % 9:02d}") for k in range(3_000)]
    df = spark.createDataFrame(rows, "d double, b boolean, i int, z float, t string").selectExpr(
        "d", "b", "i", "z", "date(t) as day", "cast(t as timestamp_ntz) as ts", "cast(d as decimal(9, 2)) as dec"
    )
    df = df.repartition(7)
    pandas = df.toPandas()
    want = {n: min((-k, v) for v, k in pandas[n].dropna().value_counts().items())[1] for n in df.columns}
    assert modes(df, df.columns) == want
    assert modes(df, ["day", "b"], as_text=True) == {"day": "2024-01-01", "b": "false"}
    assert modes(df.limit(0), ["d", "b"]) == {"d": None, "b": None}


def test_summary_is_off_by_no_more_than_its_error():
    draw = random.Random(3)
    values = [f"v{int(draw.paretovariate(0.7))}" for _ in range(20_000)]
    parts = [Summary(50) for _ in range(5)]
    for k, v in enumerate(values):
        parts[k % 5].add([v], [1])
    whole = Summary(50)
    whole.error = sum(p.error for p in parts)
    for p in parts:
        whole.add(list(p.counts), list(p.counts.values()))
    assert len(whole.counts) <= 50 and 0 < whole.error <= 20_000 / 51
    counts = dict(expected(values, len(values)))
    for v, n in counts.items():
        assert n - whole.error <= whole.counts.get(v, 0) <= n


def test_long_texts_do_not_cross_the_shuffle(spark, plan_of):
    """Texts of a kilobyte, a tenth of them one text: tasks send keys of 33 characters at most."""
    df = spark.range(20_000, numPartitions=8).selectExpr("if(id % 10 = 0, repeat('same ', 200), repeat(md5(string(id)), 30)) as t")
    cells = keyed_cells(df, ["t"])
    assert cells.agg(F.max(F.length("key"))).first()[0] == 33
    assert re.search(r"Exchange hashpartitioning\(at#\d+, key#\d+", plan_of(cells.groupBy("at", "key").count()))
    found, unproven = certain_counts(df, ["t"], 1)
    assert not unproven and [n for _, n in found["t"]] == [2_000]
    top = top_texts(df, ["t"], 1)
    assert [(r["value"], r["n"]) for r in top.collect()] == [("same " * 200, 2_000)]
    assert "LeftSemi" in plan_of(top) or "BroadcastHashJoin" in plan_of(top)
