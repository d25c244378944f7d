"""Dates, engineered features and text against pandas."""

import math
import re

import numpy as np
import pandas as pd
import pytest

from burnish import add_features, date_features, repair_types, text_features
from burnish.functions.columns import CLOCK, EITHER, date_mask
from burnish.functions.formula import column_of
from burnish.operators.dates import parse_dates, unparsed_dates
from burnish.operators.features import feature_report
from burnish.operators.text import term_weights, top_terms

STAMPS = ["2021-01-03 00:00:00", "2024-01-07 06:59:59", "2024-02-29 12:00:00", None, "2023-12-31 18:30:00", "2024-01-01 23:59:59.5", "bad"]


def dates(spark):
    return spark.createDataFrame(list(enumerate(STAMPS)), "id int, d string").repartition(2)


def parsed():
    return pd.to_datetime(pd.Series(STAMPS), errors="coerce", format="mixed")


def test_calendar_like_pandas(spark, rows):
    stamp = parsed().dt
    wanted = {
        "year": stamp.year, "month": stamp.month, "day": stamp.day, "dayofweek": stamp.dayofweek, "hour": stamp.hour,
        "minute": stamp.minute, "quarter": stamp.quarter, "week_of_year": stamp.isocalendar().week,
        "is_weekend": (stamp.dayofweek >= 5).astype(int), "days_since_earliest": (parsed() - parsed().min()).dt.days,
    }
    outcome = date_features(dates(spark), {"d": ",".join([*wanted, "time_of_day"])})
    out = rows(outcome.df)
    assert "d" not in out.columns
    for name, values in wanted.items():
        np.testing.assert_equal(out[f"d_{name}"].astype("float64").tolist(), values.astype("float64").tolist(), err_msg=name)
    # The band of each of the stamps above, written out.
    assert [v or None for v in out["d_time_of_day"]] == ["night", "night", "morning", None, "afternoon", "evening", None]


def test_hours_and_their_bands(spark):
    df = spark.range(24).selectExpr("id", "concat('2024-05-01 ', id, ':59:59') as d")
    out = {r["id"]: r["d_time_of_day"] for r in date_features(df, {"d": "time_of_day"}).df.collect()}
    spans = {"night": range(7), "morning": range(7, 13), "afternoon": range(13, 19), "evening": range(19, 24)}
    assert out == {hour: name for name, hours in spans.items() for hour in hours}


@pytest.mark.parametrize(
    "texts, days",
    [
        (["1/2/2023", "13/2/2023", "x"], ["2023-02-01", "2023-02-13", None]),
        (["1/2/2023", "2/13/2023", None], ["2023-01-02", "2023-02-13", None]),
        (["1/2/2023", "3-4-2023"], ["2023-01-02", "2023-03-04"]),
        (["1/2/2023", "13/2/2023", "2/13/2023", "31/4/2023", "13/14/2023"], ["2023-01-02", "2023-02-13", "2023-02-13", None, None]),
        (["25-12-2023 10:00", "1/2/2023"], ["2023-12-25", "2023-02-01"]),
        (["2023-1-5", "2023/1/6", "20230107", "8 jan 2023", "9 JANUARY 2023", "Jan 10, 2023", "january 11, 2023"], [f"2023-01-{d:02d}" for d in range(5, 12)]),
        (["2023-02-30", "2023-1-5T01:02:03Z", "2023", ""], [None, "2023-01-05", None, None]),
        ([None, None], [None, None]),
    ],
)
def test_how_dates_are_written_is_found_in_the_column(spark, texts, days):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, d string").repartition(2)
    got = {r["id"]: r["d"] for r in parse_dates(df, ["d"]).collect()}
    assert [v and str(v.date()) for _, v in sorted(got.items())] == days
    assert unparsed_dates(df, ["d"]).first()["null_dates"] == days.count(None)
    repaired = {r["id"]: r["d"] for r in repair_types(df, {"d": "datetime"}).df.collect()}
    assert repaired == got
    since = {r["id"]: r["d_days_since_earliest"] for r in date_features(df, {"d": "days_since_earliest"}).df.collect()}
    known = [pd.Timestamp(d) for d in days if d]
    assert [since[k] for k in range(len(days))] == [None if d is None else (got[k] - min(v for v in got.values() if v)).days for k, d in enumerate(days)]
    assert known or set(since.values()) == {None}


def test_missing_texts_have_no_shape(spark):
    df = spark.createDataFrame([("2024-01-05", None), (None, None), ("1/2/2024 10:00", "x")], "`a``b` string, t string")
    masks = [tuple(r) for r in df.select(date_mask("a`b"), date_mask("t")).collect()]
    assert masks == [(1, 0), (0, 0), (CLOCK + EITHER, 0)]


def test_only_shapes_that_occur_are_tried(spark, plan_of):
    df = spark.createDataFrame([("2024-01-05",), ("no date",)], "d string")
    text = plan_of(parse_dates(df, ["d"]))
    assert "MMM" not in text and text.count("RLIKE") + text.count("rlike") <= 2


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_days_do_not_depend_on_the_session_zone(spark, rows, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        data = [(1, "2024-03-09 12:00:00"), (2, "2024-03-10 12:00:00"), (3, "2024-03-10 02:30:00"), (4, "2024-03-11 11:59:59")]
        df = spark.createDataFrame(data, "id int, d string")
        out = rows(date_features(df, {"d": "days_since_earliest,hour"}).df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert out["d_days_since_earliest"].tolist() == [0, 1, 0, 1]
    assert out["d_hour"].tolist() == ([12, 12, 2, 11] if zone != "America/New_York" else [12, 12, out["d_hour"][2], 11])


def test_unknown_date_feature(spark):
    with pytest.raises(ValueError, match="unknown"):
        date_features(dates(spark), {"d": "year,century"})
    assert [n.status for n in date_features(dates(spark), {"e": "year"}).notes] == ["skipped"]


def parcels(spark):
    data = [(1, 10.0, 2.0, "A b  c"), (2, 0.0, 0.0, ""), (3, None, 4.0, None), (4, 7.0, -1.0, " ünï\tcode ")]
    return spark.createDataFrame(data, "id int, load double, toll double, label string")


def test_features_like_pandas(spark, rows):
    features = {
        "len": "str_len:label", "words": "word_count:label", "log": "log:toll", "rate": "ratio:load,toll",
        "up": "threshold_above:load,5", "down": "threshold_below:load,5", "mul": "multiply:load,toll",
        "sum": "add:load,toll", "dif": "subtract:load,toll", "twice": "formula:sum * 2",
    }
    out = rows(add_features(parcels(spark), features).df)
    load, toll = out["load"], out["toll"]
    labels = ["A b  c", "", None, " ünï\tcode "]
    wanted = {
        "len": [None if t is None else len(t) for t in labels],
        "words": [None if t is None else len(t.split()) for t in labels],
        "log": np.log1p(toll.clip(lower=0)), "rate": load / toll.replace(0, np.nan),
        "up": (load > 5).astype(int), "down": (load < 5).astype(int), "mul": load * toll, "sum": load + toll,
        "dif": load - toll, "twice": (load + toll) * 2,
    }
    for name, values in wanted.items():
        np.testing.assert_allclose(out[name].astype("float64"), pd.Series(values, dtype="float64"), err_msg=name)


@pytest.mark.parametrize(
    ("values", "bins"),
    [([1, 1, 1, 1, 2, 3], 4), (list(range(17)), 4), ([1, 1, 1], 3), ([5, None, 2, 9, 2], 2), ([None, None], 2), ([], 2)],
)
def test_bins_like_pandas(spark, rows, values, bins):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, v double")
    out = rows(add_features(df, {"b": f"bin:v,{bins}"}).df)["b"].astype("float64")
    filled = [v for v in values if v is not None]
    if len(set(filled)) < 2:
        assert out.isna().all()
    else:
        wanted = pd.qcut(pd.Series(values, dtype="float64"), bins, labels=False, duplicates="drop")
        np.testing.assert_equal(out.tolist(), wanted.tolist())


@pytest.mark.parametrize(
    "formula",
    ["(load + 2) / toll", "load ** 2 - -toll", "load > 5 and not toll == 2", "0 <= load < 8 or toll != 4", "load // 3 + load % 4"],
)
def test_formulas_like_pandas(spark, rows, formula):
    out = rows(add_features(parcels(spark), {"f": f"formula:{formula}"}).df)
    pandas = parcels(spark).toPandas()
    known = pandas["load"].notna() & (pandas["toll"] != 0)
    wanted = pandas.eval(formula)[known]
    np.testing.assert_allclose(out["f"][known].astype("float64"), wanted.astype("float64"))


@pytest.mark.parametrize("formula", ["__import__('os')", "load.mean()", "load[0]", "lambda: 1", "load +"])
def test_formulas_are_arithmetic_only(spark, formula):
    with pytest.raises(ValueError):
        column_of(formula)


def test_feature_errors_do_not_stop_the_rest(spark):
    outcome = add_features(parcels(spark), {"a": "log:nothing", "b": "log:load"})
    report = {r["column"]: r for r in feature_report(parcels(spark), outcome).collect()}
    assert report["a"]["status"] == "error" and "nothing" in report["a"]["reason"]
    assert (report["b"]["type"], report["b"]["nulls"]) == ("double", 1)
    with pytest.raises(ValueError, match="unknown"):
        add_features(parcels(spark), {"a": "cube:load"})


TEXTS = ["The cat sat.", "the DOG sat on the cat", None, "x 3.5 y 7", "a.b.c|d", "  Ünïcode Straße_1 cat ", ""]


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(2)


def test_text_methods(spark, rows):
    def out(method):
        return rows(text_features(texts(spark), {"t": method}).df)

    plain = [t for t in TEXTS if t is not None]
    known = [i for i, t in enumerate(TEXTS) if t is not None]
    counts = out("length_and_words")
    assert counts["t_length"][known].tolist() == [len(t) for t in plain]
    assert counts["t_word_count"][known].tolist() == [len(t.split()) for t in plain]
    for separator in ("|", ".", "at"):
        assert out(f"count_delimiter:{separator}")["t_count"][known].tolist() == [len(t.split(separator)) for t in plain]
    assert out("contains:cat")["t_has_cat"].tolist() == [1, 1, 0, 0, 0, 1, 0]
    numbers = out("extract_numbers")["t_number"]
    assert numbers[3] == 3.5 and numbers[5] == 1.0 and numbers[[0, 1, 2, 4, 6]].isna().all()
    wanted = [re.sub(r"[^a-z0-9\s]", "", t.lower().strip()) for t in plain]
    assert out("clean_and_keep")["t"][known].tolist() == wanted
    hashed = out("hash:8")["t_hash"]
    assert hashed[known].between(0, 7).all() and math.isnan(hashed[2])
    assert out("drop").columns.tolist() == ["id"]


def expected_weights(n, stop, idf):
    tokens = [[w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in stop] for t in TEXTS]
    totals = pd.Series([w for words in tokens for w in words]).value_counts()
    top = sorted(sorted(totals.index, key=lambda w: (-totals[w], w))[:n])
    out = {}
    for i, words in enumerate(tokens):
        weights = {w: words.count(w) for w in top if w in words}
        if idf:
            for w in weights:
                weights[w] *= math.log((1 + len(TEXTS)) / (1 + sum(w in other for other in tokens))) + 1
            length = math.sqrt(sum(v * v for v in weights.values()))
            weights = {w: v / length for w, v in weights.items()}
        out.update({(i, w): v for w, v in weights.items()})
    return top, out


@pytest.mark.parametrize("idf", [True, False])
def test_term_weights(spark, rows, idf):
    top, wanted = expected_weights(4, ["the", "on"], idf)
    assert list(top_terms(texts(spark), "t", 4, ["the", "on"]).terms) == top
    long = term_weights(texts(spark), "t", 4, ["id"], idf, ["the", "on"]).collect()
    assert {(r["id"], r["term"]): r["weight"] for r in long} == pytest.approx(wanted)
    method, prefix = ("tfidf", "t_tfidf_") if idf else ("countvec", "t_count_")
    wide = rows(text_features(texts(spark), {"t": f"{method}:4"}, ["the", "on"]).df)
    assert wide.columns.tolist() == ["id", *[prefix + w for w in top]]
    for i in range(len(TEXTS)):
        for w in top:
            assert wide[prefix + w][i] == pytest.approx(wanted.get((i, w), 0.0))


def test_default_stop_words(spark):
    assert "the" not in top_terms(texts(spark), "t", 50).terms


def test_weights_are_applied_without_a_shuffle(spark, plan_of):
    text = plan_of(text_features(texts(spark), {"t": "tfidf:3"}, []).df)
    assert "hashpartitioning" not in text and "PythonUDF" not in text


def test_no_terms_at_all(spark):
    df = spark.createDataFrame([(1, None), (2, "!")], "id int, t string")
    assert text_features(df, {"t": "tfidf:5"}).df.columns == ["id"]
    assert term_weights(df, "t", 5, ["id"]).count() == 0


def test_unknown_text_method(spark):
    with pytest.raises(ValueError, match="unknown"):
        text_features(texts(spark), {"t": "embed"})
    assert [n.status for n in text_features(texts(spark), {"u": "drop"}).notes] == ["skipped"]
