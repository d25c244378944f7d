"""Profiles, checks, comparisons, sources and sinks."""

import json

import numpy as np
import pandas as pd
import pytest

import burnish
from burnish.operators import compare as k
from burnish.operators import gram
from burnish.operators import profile as p
from burnish.operators.validate import quality_gate, validate
from burnish.sources.catalog import file_catalog, preview_summary
from burnish.sources.folder import scan_columns, scan_folder
from burnish.sources.readers import document_preview, odd_quotes, read_any, text_preview


def mixed(spark):
    data = [(1, 1.0, 2.0, "a", "2024-01-01", None), (2, 2.0, 4.1, "a", "2024-02-01", None), (3, None, 6.0, "b", None, None),
            (3, None, 6.0, "b", None, None), (5, 50.0, 100.0, None, "2024-03-01", None)]
    return spark.createDataFrame(data, "id int, x double, y double, t string, d string, n double").repartition(2)


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_profile_like_pandas(spark):
    pandas = mixed(spark).toPandas()
    parts = burnish.profile(mixed(spark), "id")
    missing = by_column(parts["missing"])
    distinct = by_column(parts["distinct"])
    for name in pandas.columns:
        assert missing[name]["nulls"] == pandas[name].isna().sum()
        assert missing[name]["null_pct"] == round(pandas[name].isna().mean() * 100, 2)
        assert distinct[name]["distinct"] == pandas[name].nunique()
    described = by_column(parts["numeric"])
    stats = pandas.select_dtypes("number").describe().round(4)
    for name in ("id", "x", "y"):
        for mine, theirs in [("mean", "mean"), ("std", "std"), ("q1", "25%"), ("median", "50%"), ("q3", "75%"), ("max", "max")]:
            assert described[name][mine] == pytest.approx(stats[name][theirs], abs=1e-4)
    assert described["n"]["count"] == 0 and described["n"]["median"] is None
    corr = pandas[["id", "x", "y"]].corr().abs()
    found = {(r["col1"], r["col2"]): r["correlation"] for r in parts["correlations"].collect()}
    assert found == {(a, b): round(corr.loc[a, b], 4) for a, b in [("id", "x"), ("id", "y"), ("x", "y")] if corr.loc[a, b] > 0.9}
    assert set(by_column(parts["constant"])) == {"n"}
    assert parts["duplicates"].first()[0] == pandas.duplicated().sum()
    assert set(by_column(parts["dates"])) == {"d"}
    assert by_column(parts["lengths"])["t"]["avg_length"] == 1.0
    top = [(r["column"], r["value"], r["n"]) for r in parts["categories"].where("column = 't'").orderBy("rank").collect()]
    assert top == [("t", "a", 2), ("t", "b", 2)]
    assert [r["id"] for r in parts["sample"].collect()] == [1, 2, 3]
    assert parts["shape"].first()["rows"] == 5


def test_profile_of_an_empty_table(spark):
    parts = burnish.profile(mixed(spark).limit(0))
    assert all(r["null_pct"] is None for r in parts["missing"].collect())
    assert parts["duplicates"].first()[0] == 0
    assert parts["outliers"].count() == 0


def test_correlations_with_gaps_on_either_side(spark):
    rng = np.random.default_rng(4)
    pandas = pd.DataFrame(rng.normal(1e6, 1, (200, 4)), columns=list("abcd"))
    pandas["b"] += pandas["a"]
    pandas.loc[rng.random(200) < 0.3, "c"] = np.nan
    pandas.loc[rng.random(200) < 0.3, "d"] = np.nan
    pandas["e"] = 3.0
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in pandas.to_numpy()], ", ".join(f"{n} double" for n in pandas))
    corr = pandas.corr().abs()
    for r in p.correlations(df).collect():
        wanted = corr.loc[r["col1"], r["col2"]]
        assert r["correlation"] is None if np.isnan(wanted) else r["correlation"] == pytest.approx(wanted, rel=1e-6)


def test_distinct_counts_are_summed_before_the_shuffle(spark, plan_of):
    text = plan_of(p.distinct_counts(spark.range(100).selectExpr("id % 3 / 2 as a", "string(id) as b")))
    assert "Expand" in text and "partial_count" in text


def test_close_numbers_and_dates_are_counted_by_bitmaps(spark, plan_of):
    df = spark.range(5_000, numPartitions=6).selectExpr(
        "if(id % 9 = 0, null, id % 40001 - 2500) as a", "cast(id % 7 as tinyint) as b", "date_add(date'1969-12-01', cast(id % 90 as int)) as day",
        "id * 1000003 as wide", "cast(null as int) as none", "id * 40 - 100000 as loose",
    )
    assert p.close_columns(df, df.columns) == ["a", "b", "day", "loose"]
    pandas = df.toPandas()
    assert {n: r["distinct"] for n, r in by_column(p.distinct_counts(df)).items()} == {n: pandas[n].nunique() for n in df.columns}
    text = plan_of(p.bitmap_counts(df, ["a", "day"]))
    exchange = text[text.index("Exchange hashpartitioning(column") :]
    assert "partial_bitmap_construct_agg" in exchange and "value" not in exchange.split("\n")[0]


def test_profile_without_texts_or_numbers(spark):
    numbers = burnish.profile(spark.range(5).selectExpr("id", "id * 2 as v"))
    assert "categories" not in numbers and numbers["dates"].count() == 0
    assert p.cardinality(spark.range(5)).count() == 0
    texts = burnish.profile(spark.range(5).selectExpr("cast(id as string) as t"))
    assert "numeric" not in texts and texts["correlations"].count() == 0


def test_long_texts_are_counted_by_digest(spark):
    df = spark.range(60).selectExpr("concat(repeat('x', 100), id % 7) as long", "concat('k', id % 5) as short")
    assert {n: r["distinct"] for n, r in by_column(p.distinct_counts(df)).items()} == {"long": 7, "short": 5}


def checks(df, **wanted):
    return {r["check_name"]: (r["passed"], r["detail"]) for r in validate(df, wanted).collect()}


def test_checks(spark):
    found = checks(
        mixed(spark), no_nulls=True, max_null_pct=40, no_duplicates=True, min_rows=5, expected_columns="id,zz", no_infinite=True,
        target_column="id", numeric_only=True,
    )
    assert found == {
        "no_nulls": (False, "d=2, n=5, t=1, x=2"), "max_null_pct": (False, "n=100.0"), "no_duplicates": (False, "duplicates=1"),
        "min_rows": (True, "expected=5, actual=5"), "expected_columns": (False, "zz"), "no_infinite": (True, ""),
        "target_column": (True, "nulls=0"), "numeric_only": (False, "d, t"),
    }
    assert checks(mixed(spark), target_column="zz")["target_column"] == (False, "column not found")
    assert checks(mixed(spark), no_nulls=False) == {}
    with pytest.raises(ValueError, match="unknown"):
        validate(mixed(spark), {"no_bugs": True})


def test_gate(spark):
    before = spark.range(10).selectExpr("id", "cast(id as double) as v")
    good = quality_gate(before, before.withColumn("w", before["v"] * 2), {"no_nulls": True, "no_duplicates": True}).first()
    assert (good["verdict"], good["failed"], good["issues"]) == ("PASS", 0, "")
    bad = quality_gate(before, before.where("id < 7").selectExpr("*", "1 as flat"), {"min_rows": 100}).first()
    assert bad["verdict"] == "FAIL"
    assert bad["issues"] == "degenerate_features: flat; min_rows: expected=100, actual=7; row_loss: lost_pct=30.0"
    mild = quality_gate(before, before, {"min_rows": 100}).first()
    assert (mild["verdict"], mild["failed"]) == ("PASS", 1)


def test_comparison(spark):
    before = mixed(spark)
    after = before.where("x is not null").selectExpr("id", "cast(x as int) as x", "y * 2 as y", "1 as z")
    parts = {name: [r.asDict() for r in df.collect()] for name, df in k.compare(before, after).items()}
    assert parts["shape"] == [{"rows_before": 5, "rows_after": 3, "columns_before": 6, "columns_after": 4}]
    status = {r["column"]: r["status"] for r in parts["schema"]}
    assert status == {"id": "kept", "x": "retyped", "y": "kept", "t": "removed", "d": "removed", "n": "removed", "z": "added"}
    assert parts["missing"] == [{"nulls_before": 10, "nulls_after": 0}]
    assert parts["duplicates"] == [{"duplicates_before": 1, "duplicates_after": 0}]
    pandas, left = before.toPandas(), after.toPandas()
    for r in parts["shifts"]:
        assert r["mean_shift"] == pytest.approx(left[r["column"]].mean() - pandas[r["column"]].mean(), abs=1e-4)
        assert r["std_shift"] == pytest.approx(left[r["column"]].std() - pandas[r["column"]].std(), abs=1e-4)


def test_csv_missing_tokens_types_and_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,v,w,b,t\n1,1.5,3,True,"a\nb, ""c"""\n2,NA,nan,False,N/A\n3,,,,null\n4,2e3,7,True,x\n')
    assert list(odd_quotes(spark, str(path)).values()) == [True]
    df = read_any(spark, str(path))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {"id": "bigint", "v": "double", "w": "bigint", "b": "boolean", "t": "string"}
    pandas = pd.read_csv(path)
    out = df.orderBy("id").toPandas()
    assert out["t"].tolist() == ['a\nb, "c"', None, None, "x"]
    for name in ("v", "w"):
        np.testing.assert_equal(out[name].astype("float64").tolist(), pandas[name].tolist())


def test_csv_without_line_breaks_stays_splittable(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('id,t\n1,"a, b"\n2,"say ""hi"""\n')
    assert list(odd_quotes(spark, str(path)).values()) == [False]
    assert [r["t"] for r in burnish.read_csv(spark, str(path)).orderBy("id").collect()] == ["a, b", 'say "hi"']
    typed = burnish.read_csv(spark, str(path), schema="id double, t string", quoted_newlines=False)
    assert typed.orderBy("id").first()["id"] == 1.0


def test_json_tsv_text_and_parquet(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": None, "b": "y"}]
    (tmp_path / "r.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    (tmp_path / "r.tsv").write_text("a\tb\n1\tx\nNA\ty\n")
    (tmp_path / "r.txt").write_text("one\ntwo\n")
    for name in ("r.json", "r.jsonl", "r.tsv"):
        out = read_any(spark, str(tmp_path / name)).orderBy("b").collect()
        assert [(r["a"], r["b"]) for r in out] == [(1, "x"), (None, "y")], name
    assert read_any(spark, str(tmp_path / "r.txt")).count() == 2
    spark.createDataFrame([(float("nan"),), (1.0,)], "v double").write.parquet(str(tmp_path / "n.parquet"))
    assert read_any(spark, str(tmp_path / "n.parquet")).where("v is null").count() == 1
    (tmp_path / "d.json").write_text(json.dumps({"k": "v" * 5_000}))
    assert len(document_preview(spark, str(tmp_path / "d.json")).first()["preview"]) == 2_000
    (tmp_path / "d.md").write_text("".join(f"line {k}\n" for k in range(40)))
    seen = text_preview(spark, str(tmp_path / "d.md")).orderBy("line").collect()
    assert [(r["line"], r["value"]) for r in seen] == [(k + 1, f"line {k}") for k in range(5)]
    assert document_preview(spark, str(tmp_path / "d.md"), 13).first()["preview"] == "line 0\nline 1"
    with pytest.raises(ValueError, match="unsupported"):
        read_any(spark, "x.xyz")


def test_catalog_and_preview(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.csv").write_text("x" * 2_000)
    (tmp_path / "one" / "b.PNG").write_text("y")
    found = {r["file"]: r for r in file_catalog(spark, str(tmp_path)).collect()}
    assert (found["a.csv"]["size_kb"], found["a.csv"]["supported"], found["a.csv"]["folder"]) == (1.95, True, "one")
    assert not found["b.PNG"]["supported"]
    seen = by_column(preview_summary(mixed(spark), "id", 2))
    assert (seen["n"]["nulls"], seen["x"]["nulls"], seen["x"]["rows"]) == (2, 0, 5)


def test_folder_scan(spark, tmp_path):
    for name in ("a", "b/c"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "a" / "x.csv").write_text('k,"t, u"\n1,NA\n2,"p, q"\n3\n')
    (tmp_path / "a" / "y.TSV").write_text("k\tv\n" + "".join(f"{k}\t\n" for k in range(9)))
    (tmp_path / "b" / "z.jsonl").write_text('{"a": 1, "b": null}\n{"a": 2, "c": "}"}\n')
    (tmp_path / "b" / "list.json").write_text(json.dumps([{"a": k, "b": {"c": "}{"}} for k in range(300)], indent=1))
    (tmp_path / "b" / "one.json").write_text(json.dumps({"k": "v" * 5_000}))
    (tmp_path / "b" / "none.json").write_text("[]")
    (tmp_path / "b" / "n.txt").write_text("".join(f"line {k}\n" for k in range(40)))
    (tmp_path / "b" / "p.png").write_text("?")
    for name in ("a", "b/c"):
        spark.range(7 if name == "a" else 3).selectExpr("id", "if(id < 2, null, id) as v").coalesce(1).write.parquet(str(tmp_path / name / "w"))
    scanned = scan_folder(spark, str(tmp_path))
    found = {r["path"].split(str(tmp_path) + "/")[1]: r for r in scanned.collect()}
    found = {k if "part-" not in k else k.rsplit("/", 1)[0]: r for k, r in found.items()}
    got = {k: (r["type"], r["rows"], [tuple(x) for x in r["columns"]]) for k, r in found.items()}
    assert got == {
        "a/x.csv": ("csv", 3, [("k", 0), ("t, u", 2)]), "a/y.TSV": ("tsv", 9, [("k", 0), ("v", 5)]),
        "b/z.jsonl": ("jsonl", 2, [("a", 0), ("b", 2), ("c", 1)]), "b/list.json": ("json", 300, [("a", 0), ("b", 0)]),
        "b/one.json": ("json", 1, [("k", 0)]), "b/none.json": ("json", 0, []),
        "b/n.txt": ("txt", 40, []), "a/w": ("parquet", 7, [("id", 0), ("v", 2)]), "b/c/w": ("parquet", 3, [("id", 0), ("v", 2)]),
    }
    assert found["b/n.txt"]["preview"] == "\n".join(f"line {k}" for k in range(5)) and len(found["b/one.json"]["preview"]) == 2_000
    assert found["a/w"]["preview"].startswith('{"id":0}\n{"id":1}\n{"id":2,"v":2}') and found["a/x.csv"]["size_kb"] == 0.02
    assert scan_columns(scanned).count() == 14
    (tmp_path / "empty").mkdir()
    assert scan_folder(spark, str(tmp_path / "empty")).count() == 0


def test_output(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, None)], "id long, t string")
    assert burnish.write_output(df, str(tmp_path / "p")) == 2
    assert burnish.write_output(df, str(tmp_path / "c"), "csv") == 2
    back = burnish.read_csv(spark, str(tmp_path / "c")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'a,"b"\nc'), (2, None)]


def test_correlations_of_many_columns_go_by_blocks(spark, tmp_path, monkeypatch):
    names = [f"v{k}" for k in range(300)]
    table = spark.range(400, numPartitions=5).selectExpr(*[f"if(id % 11 = {k} % 23, null, sin(id * {k + 1}) + if({k} % 7 = 3, id, 0)) as v{k}" for k in range(300)])
    table.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sums = df.mapInArrow(gram.task_sums([(0, 0), (0, 4)]), gram.PARTS_DDL)
    sizes = {(r["a"], r["b"]): len(r["sums"]) for r in sums.collect()}
    assert sizes == {(0, 0): 8 * 6 * 64 * 64, (0, 4): 8 * 6 * 64 * 44}
    want = df.toPandas()[names].corr(min_periods=2).abs()
    for wave in (512, 4):
        monkeypatch.setattr(gram, "WAVE", wave)
        got = {(r["col1"], r["col2"]): r["correlation"] for r in p.correlations(df).collect()}
        assert len(got) == 300 * 299 // 2
        assert all(abs(v - want.loc[a, b]) < 1e-9 for (a, b), v in got.items())


def test_sums_carry_what_rounding_loses():
    total = gram.Sum()
    for value in (1e16, 1.0, 1.0, -1e16, np.inf, 1.0):
        total.add(np.array([value if np.isfinite(value) else 0.0, value]))
    assert total.value()[0] == 3.0 and total.value()[1] == np.inf


def test_folder_scan_of_tables_in_many_files(spark, tmp_path, plan_of):
    """Growing tables are in several files, none written by one task; the first rows of all stand in the first file."""
    from queries import registered
    from queries.sources import ORDER_PLAIN, scanned_tables

    (tmp_path / "in").mkdir()
    made = {"orders": "id + 1 as o_orderkey, id as o_custkey, 'O' as o_orderstatus, double(id) as o_totalprice, timestamp_ntz'2024-01-01' as o_orderdate, 'p' as o_orderpriority",
            "supplier": "id as s_suppkey, 's' as s_name, int(id) as s_nationkey, 1.5D as s_acctbal",
            "nation": "id as n_nationkey, 'n' as n_name", "region": "id as r_regionkey, 'r' as r_name"}
    for name, columns in made.items():
        spark.range(40 if name in ("orders", "supplier") else 4).selectExpr(*columns.split(", ")).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scanned = scan_folder(spark, scanned_tables(spark, str(tmp_path / "in")))
        files = scanned.groupBy("type").count().collect()
        got = registered()["s7_folder_scan"](spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    count = {r["type"]: r["count"] for r in files}
    assert count["csv"] > 8 and count["parquet"] > 8 and (count["json"], count["txt"]) == (1, 1)
    csv = {r["column"]: (r["rows"], r["missing"]) for r in got if r["type"] == "csv"}
    assert csv == {n: (40, 0) for n in ORDER_PLAIN} and len(got) == 5 + 2 + 4 + 1
    assert {r["rows"] for r in got if r["type"] == "parquet"} == {40}
    assert scanned.where("type = 'csv'").orderBy("path").first()["rows"] >= 5
    # First lines are found without sorting lines.
    assert "row_number" not in plan_of(scanned) and "WindowGroupLimit" not in plan_of(scanned)
