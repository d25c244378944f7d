from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from burnish.llm.common import components
from burnish.llm.exact import CHUNK, exact_dedup, exact_duplicates, fingerprint
from burnish.llm.shards import best_fit, even_fit, shard_rows
from tests.llm.shared import awkward, documents, reached


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_by_normalised_text(spark):
    rows = awkward()
    got = exact_duplicates(documents(spark, rows)).toPandas()
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(normal(t), []).append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for _, r in got.iterrows():
        ids = digest[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert (r["keep_id"] == min(known)) if known else np.isnan(r["keep_id"])
    assert got.groupby("text_sha256")["kept"].sum().eq(1).all()


def test_exact_dedup_keeps_columns_and_the_smallest_id(spark):
    df = documents(spark, awkward())
    out = exact_dedup(df)
    assert out.columns == df.columns
    kept = out.toPandas()
    assert sorted(kept.text.map(normal)) == sorted({normal(t) for _, t, _ in awkward()})
    assert kept.doc_id.isna().sum() == 1
    assert (kept.doc_id == 18).sum() == 1
    assert exact_dedup(df.limit(0)).count() == 0


def test_fingerprints_join_over_chunks():
    data = bytes(range(256)) * 700
    assert fingerprint(data) == fingerprint(memoryview(data))
    assert fingerprint(data[:CHUNK]) != fingerprint(data)
    assert fingerprint(b"\0") != fingerprint(b"\0\0") != fingerprint(b"")


def test_texts_with_one_fingerprint_are_told_apart(spark, monkeypatch):
    from burnish.llm import exact

    monkeypatch.setattr(exact, "fingerprints", lambda data: exact.F.length(data).cast("long") * 0)
    rows = [(1, "ab", "a"), (2, "ba", "a"), (3, "ab", "a"), (4, "x" * 100_000 + "y", "a"), (5, "x" * 100_001, "a")]
    got = exact_duplicates(documents(spark, rows)).toPandas().sort_values("doc_id")
    assert got.keep_id.tolist() == [1, 2, 1, 4, 5]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_takes_the_tightest_bin(seed):
    random = np.random.default_rng(seed)
    sizes = sorted(random.integers(1, 60, 80).tolist(), reverse=True)
    bins, room = best_fit(sizes, 100, 80), []
    for size, number in zip(sizes, bins):
        fitting = [left for left in room if left >= size]
        if number == len(room):
            assert not fitting
            room.append(100)
        else:
            assert room[number] == min(fitting)
        room[number] -= size
    even = even_fit(sizes, 8)
    loads = np.bincount(even, sizes, 8)
    assert loads.max() - loads.min() <= 4
    assert best_fit([500, 3], 100, 5) == [0, 1]


def test_shards_keep_groups_and_number_rows(spark):
    rows = awkward()
    got = shard_rows(documents(spark, rows), shards=4).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in texts.items() if i is not None}
    size = {i: len((t or "").encode()) + 1 for i, t in texts.items() if i is not None}
    known = got[got.doc_id.notna()]
    assert [crc[i] for i in known.doc_id] == known.text_crc32.tolist()
    assert [size[i] for i in known.doc_id] == known["size"].tolist()
    assert got[got.doc_id == 18].shard.nunique() == 1
    again = shard_rows(documents(spark, rows[::-1]), shards=4).toPandas()
    order = ["doc_id", "size", "text_crc32", "slot"]
    assert got.sort_values(order).shard.tolist() == again.sort_values(order).shard.tolist()


def test_fixed_capacity_and_empty_tables(spark):
    got = shard_rows(documents(spark, [(i, "x" * 9, "a") for i in range(20)] + [(30, "y" * 99, "a")]), capacity=250)
    assert got.toPandas().groupby("shard")["size"].sum().le(250).all()
    assert shard_rows(documents(spark, []), shards=4).count() == 0
    with pytest.raises(ValueError):
        shard_rows(documents(spark, []), shards=4, capacity=9)


def test_components_of_chains_stars_and_rings(spark):
    random = np.random.default_rng(5)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(200, 201), (201, 202), (202, 200)]
    links += [(int(a) + 300, int(b) + 300) for a, b in random.integers(0, 80, (50, 2))] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = reached(400, links)
    touched = {x for a, b in links for x in (a, b) if a != b}
    assert set(got) == touched
    assert all(got[x] == want[x] for x in touched)
