"""Every registered query gives what its SQL gives."""

import pytest

from check import database, differences
from queries import oracle, registered

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, connection, name):
    result = registered()[name](spark, SF_DIR)
    if name in oracle():
        problem, _ = differences(result, connection.sql(oracle()[name]))
        assert not problem
    else:
        assert result.count() > 0


def test_catalog_matches_the_folder(spark):
    from pathlib import Path

    result = {r["file"]: r for r in registered()["s7_file_catalog"](spark, SF_DIR).collect()}
    files = {p.name: p for p in Path(SF_DIR).iterdir()}
    assert set(result) == set(files)
    for name, path in files.items():
        assert result[name]["size_kb"] == pytest.approx(path.stat().st_size / 1024, abs=0.006)
        assert result[name]["supported"]
