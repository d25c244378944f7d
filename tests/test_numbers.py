"""Scaling and outliers against hand formulas in numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from burnish import outlier_report, scale, treat_outliers
from burnish.operators import power
from burnish.operators.power import fit_powers

VALUES = [3.0, -1.0, None, 8.5, 100.0, 0.0, 4.0, 4.0, -20.0]


def frame(spark, values=VALUES, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"id int, v {kind}").repartition(2)


def series(values=VALUES):
    return pd.Series(values, dtype="float64")


FORMULAS = {
    "standard": lambda s: (s - s.mean()) / (s.std(ddof=0) or 1),
    "minmax": lambda s: (s - s.min()) / ((s.max() - s.min()) or 1),
    "robust": lambda s: (s - s.median()) / ((s.quantile(0.75) - s.quantile(0.25)) or 1),
    "log": lambda s: np.log1p(s.clip(lower=0)),
    "maxabs": lambda s: s / (s.abs().max() or 1),
}


@pytest.mark.parametrize("method", sorted(FORMULAS))
@pytest.mark.parametrize("values", [VALUES, [5.0, 5.0, 5.0], [0.0, 0.0], [None, None], [7.0]])
def test_scaling(spark, rows, method, values):
    out = rows(scale(frame(spark, values), {"v": method}).df)["v"].astype("float64")
    expected = series(values) if series(values).isna().all() else FORMULAS[method](series(values))
    np.testing.assert_allclose(out, expected, rtol=1e-12, atol=1e-12)


def yeo_johnson(x, power):
    up = np.log1p(x.clip(0)) if abs(power) < 1e-12 else ((x.clip(0) + 1) ** power - 1) / power
    mirrored = 2 - power
    y = (-x).clip(0)
    down = -np.log1p(y) if abs(mirrored) < 1e-12 else -((y + 1) ** mirrored - 1) / mirrored
    return np.where(x >= 0, up, down)


@pytest.mark.parametrize("seed", [1, 2])
def test_power_finds_the_best_exponent(spark, rows, seed):
    values = np.random.default_rng(seed).lognormal(1, 0.8, 300) - seed
    df = frame(spark, values.tolist())
    fitted = fit_powers(df, ["v"])["v"]
    grid = np.arange(-2, 3, 0.001)

    def score(power):
        logs = (np.sign(values) * np.log1p(np.abs(values))).sum()
        return -len(values) / 2 * np.log(yeo_johnson(values, power).var()) + (power - 1) * logs

    assert fitted["power"] == pytest.approx(grid[np.argmax([score(p) for p in grid])], abs=1.1e-3)
    out = rows(scale(df, {"v": "power_yeo"}).df)["v"]
    expected = yeo_johnson(values, fitted["power"])
    np.testing.assert_allclose(out, (expected - expected.mean()) / expected.std(), rtol=1e-9, atol=1e-9)


def test_power_beyond_the_first_grid(spark):
    values = (10 + np.random.default_rng(3).beta(9, 0.6, 400)).tolist()
    assert fit_powers(frame(spark, values), ["v"])["v"]["power"] > 6


def test_power_far_from_zero(spark):
    values = 0.01 * np.random.default_rng(3).beta(9, 0.6, 400)
    grid = np.arange(100, 5_000, 0.5)
    logs = np.log1p(values).sum()
    scores = [-200 * np.log(yeo_johnson(values, p).var()) + (p - 1) * logs for p in grid]
    best = grid[np.argmax(scores)]
    assert 200 < best < 4_900
    assert fit_powers(frame(spark, values.tolist()), ["v"])["v"]["power"] == pytest.approx(best, abs=0.6)


def test_power_of_nothing(spark):
    for values in ([None, None], [3.0, 3.0], []):
        assert scale(frame(spark, values), {"v": "power_yeo"}).df.count() == len(values)


def test_all_numeric_and_exclusions(spark, rows):
    df = spark.createDataFrame([(1, 2.0, "a"), (3, 4.0, "b")], "id int, v double, t string")
    outcome = scale(df, {"__all_numeric__": "minmax"}, "id")
    assert rows(outcome.df)["v"].tolist() == [0.0, 1.0]
    assert rows(outcome.df)["id"].tolist() == [1, 3]
    statuses = {n.column: n.status for n in scale(df, {"id": "standard", "t": "standard", "x": "log"}, ["id"]).notes}
    assert statuses == {"id": "skipped", "t": "skipped", "x": "skipped"}
    with pytest.raises(ValueError, match="unknown"):
        scale(df, {"v": "sqrt"})


def iqr(s, k):
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


@pytest.mark.parametrize("values", [VALUES, [1.0, 1.0, 1.0, 1.0, 50.0], [None, 2.0]])
def test_clips(spark, rows, values):
    s = series(values)
    expected = {
        "clip_iqr": s.clip(*iqr(s, 1.5)),
        "clip_iqr:0.5": s.clip(*iqr(s, 0.5)),
        "winsorize:10,80": s.clip(s.quantile(0.1), s.quantile(0.8)),
        "log_transform": np.log1p(s.clip(lower=0)),
    }
    if s.std() > 0:
        expected["clip_zscore:1"] = s.clip(s.mean() - s.std(), s.mean() + s.std())
    for strategy, wanted in expected.items():
        out = rows(treat_outliers(frame(spark, values), {"v": strategy}).df)["v"].astype("float64")
        np.testing.assert_allclose(out, wanted, rtol=1e-12, err_msg=strategy)


@pytest.mark.parametrize("values", [VALUES, [1.0, 1.0, 1.0, 1.0, 50.0]])
def test_removals(spark, rows, values):
    s = series(values)
    low, high = iqr(s, 1.5)
    assert rows(treat_outliers(frame(spark, values), {"v": "remove_iqr"}).df)["id"].tolist() == s[(s >= low) & (s <= high)].index.tolist()
    kept = s[((s - s.mean()) / s.std()).abs() <= 1.0]
    assert rows(treat_outliers(frame(spark, values), {"v": "remove_zscore:1"}).df)["id"].tolist() == kept.index.tolist()


def test_no_spread_removes_nothing_by_zscore(spark):
    assert treat_outliers(frame(spark, [2.0, 2.0, None]), {"v": "remove_zscore"}).df.count() == 3


def test_a_removal_changes_the_next_fit(spark, rows):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(10)] + [(10, 500.0, 500.0)], "id int, a double, b double")
    out = rows(treat_outliers(df, {"a": "remove_iqr", "b": "winsorize:0,50"}).df)
    assert out["b"].max() == 4.5


def test_report(spark):
    lines = outlier_report(frame(spark), {"v": "remove_iqr", "x": "clip_iqr"}).collect()
    s = series()
    low, high = iqr(s, 1.5)
    before = int(((s < low) | (s > high)).sum())
    left = s[(s >= low) & (s <= high)]
    low, high = iqr(left, 1.5)
    after = int(((left < low) | (left > high)).sum())
    assert [tuple(r) for r in lines] == [("v", "remove_iqr", before, after, len(s), len(left))]


def test_filters_reach_the_scan(spark, plan_of, tmp_path):
    from burnish import read_parquet

    path = str(tmp_path / "v.parquet")
    spark.range(1_000).selectExpr("id", "cast(id as double) as v", "cast(id as string) as other").write.parquet(path)
    df = read_parquet(spark, path, nan_as_null=False).select("id", "v")
    text = plan_of(treat_outliers(df, {"v": "remove_iqr:0.1"}).df)
    assert "PushedFilters: [IsNotNull(v), GreaterThanOrEqual(v" in text
    assert "ReadSchema: struct<id:bigint,v:double>" in text
    scaled = plan_of(scale(df, {"v": "robust"}).df)
    assert "Exchange" not in scaled and "WholeStageCodegen" not in scaled.replace("*(1)", "")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30))
def test_clip_twice_is_clip_once_and_minmax_stays_inside(spark, values):
    df = frame(spark, values)
    limits = iqr(series(values), 1.5)
    once = treat_outliers(df, {"v": "clip_iqr"}).df.toPandas()["v"]
    assert ((once >= limits[0] - 1e-6) & (once <= limits[1] + 1e-6)).all()
    inside = scale(df, {"v": "minmax"}).df.toPandas()["v"]
    assert inside.between(0, 1).all()


def test_exponents_of_many_columns_take_as_many_jobs_as_of_one(spark, monkeypatch):
    draw = np.random.default_rng(8)
    values = np.column_stack([draw.lognormal(0, 0.3 + k / 20, 200) - k % 3 for k in range(12)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in values], ", ".join(f"v{k} double" for k in range(12))).repartition(3)
    calls = []
    inner = power.column_moments
    monkeypatch.setattr(power, "column_moments", lambda *a: calls.append(sorted(a[2])) or inner(*a))
    together = fit_powers(df, df.columns)
    rounds = len(calls)
    alone = {n: fit_powers(df, [n])[n] for n in ("v0", "v7")}
    assert rounds <= 9 and calls[0] == list(range(12))
    assert all(together[n] == pytest.approx(found, rel=1e-9) for n, found in alone.items())
    for k, n in enumerate(df.columns):
        fitted = yeo_johnson(values[:, k], together[n]["power"])
        assert (together[n]["mean"], together[n]["std"]) == pytest.approx((fitted.mean(), fitted.std()), rel=1e-9)
