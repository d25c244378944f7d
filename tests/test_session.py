import pytest

from burnish import fill_missing
from burnish.session import cut, shared_root


class Elsewhere:
    """A session whose executors have disks of their own and that names no shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Elsewhere)
    df = spark.range(3)
    monkeypatch.setattr(type(df), "sparkSession", property(lambda self: Elsewhere))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cut(df)


def test_dates_have_no_zero(spark):
    df = spark.sql("select date'2024-01-01' as d union all select null")
    with pytest.raises(ValueError, match="fill_zero"):
        fill_missing(df, {"d": "fill_zero"})


def test_nan_is_missing_in_every_fill(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 4.0), (3, None)], "id int, v double")
    for how, want in (("fill_mean", [4.0, 4.0, 4.0]), ("fill_zero", [0.0, 4.0, 0.0]), ("fill_bfill", [4.0, 4.0, None]), ("fill_mode", [4.0] * 3)):
        got = fill_missing(df, {"v": how}, order_by="id").df.orderBy("id").collect()
        assert [r["v"] for r in got] == want
    assert fill_missing(df, {"v": "drop_rows"}).df.count() == 1
