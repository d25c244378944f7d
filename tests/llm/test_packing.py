from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from burnish.llm.packing import Ids, Packer, pack_best_fit, token_pieces
from tests.llm.shared import awkward, documents
from tests.llm.test_tokens import wild

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def slow_best_fit(lengths, capacity, open_bins):
    """The same rule over plain lists: the tightest open bin, and the fullest closes."""
    bins, is_open, out = [], [], []
    for x in lengths:
        fitting = [b for b in is_open if capacity - bins[b] >= x]
        if fitting:
            b = max(fitting, key=lambda b: (bins[b], is_open.index(b)))
        else:
            if len(is_open) >= open_bins:
                is_open.remove(max(is_open, key=lambda b: bins[b]))
            b = len(bins)
            bins.append(0)
            is_open.append(b)
        out.append((bins[b], x))
        bins[b] += x
        if bins[b] == capacity and b in is_open:
            is_open.remove(b)
    return len(bins), out


@pytest.mark.parametrize("open_bins", [1, 3, 50])
def test_packer_follows_the_rule(open_bins):
    draw = random.Random(open_bins)
    lengths = [draw.randint(1, 40) for _ in range(800)]
    packer = Packer(40, open_bins)
    placed = [packer.place(x) for x in lengths]
    count, want = slow_best_fit(lengths, 40, open_bins)
    assert packer.next == count and [(offset, x) for (_, offset), x in zip(placed, lengths)] == want
    assert packer.open == len(packer.still_open()) <= open_bins
    fills = {}
    for (number, offset), x in zip(placed, lengths):
        assert fills.get(number, 0) == offset
        fills[number] = offset + x
    assert max(fills.values()) <= 40
    assert dict(packer.still_open()).items() <= fills.items()


def test_ids_agree_with_the_library():
    texts = [t or "" for _, t, _ in awkward()] + [wild(k) for k in range(200)] + [" " * 2_000_000 + "a", "\n" * 999_999, "<|endoftext|>x"]
    for path in (BYTES, WORDS):
        own, library = Ids(path), Tokenizer.from_file(path)
        assert (own.ranked is not None) == (path == BYTES)
        for text in texts if path == BYTES else texts[:80]:
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def check_sequences(rows, capacity):
    """Gapless offsets and no sequence over the capacity; the number of sequences."""
    ordered = rows.sort_values(["sequence_id", "offset"])
    groups = ordered.groupby("sequence_id").length
    assert ((groups.cumsum() - ordered.length) == ordered.offset).all()
    assert groups.sum().max() <= capacity
    return groups.ngroups


def test_pieces_of_documents(spark):
    rows = awkward()
    got = token_pieces(documents(spark, rows), BYTES, 100, end_id=0).toPandas()
    library = Tokenizer.from_file(BYTES)
    want = []
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first, start = len(ids) % 100 or 100, 0
        for piece, stop in enumerate(range(first, len(ids) + 1, 100)):
            data = np.array(ids[start:stop], "<u4").tobytes()
            want.append((i, piece, start, stop - start, zlib.crc32(data), data))
            start = stop
        assert start == len(ids)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    have = [(None if r[0] != r[0] else int(r[0]), *map(int, r[1:5]), bytes(r[5])) for r in got.itertuples(index=False)]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert token_pieces(documents(spark, [(1, "", "a"), (2, None, "a")]), BYTES, 100).count() == 0


def test_rows_are_packed_over_many_tasks(spark):
    draw = random.Random(4)
    lengths = [draw.choice([draw.randint(1, 64), draw.randint(1, 20), 64]) for _ in range(6_000)]
    df = spark.createDataFrame([(k, x, "b") for k, x in enumerate(lengths)], "id long, length long, base string").repartition(20)
    got = pack_best_fit(df, 64).toPandas()
    assert sorted(got.id) == list(range(6_000)) and list(got.columns) == ["id", "length", "base", "sequence_id", "offset"]
    assert check_sequences(got, 64) <= 1.01 * -(-sum(lengths) // 64)
    small = pack_best_fit(df, 64, open_bins=4, ahead=4).toPandas()
    assert check_sequences(small, 64) <= 1.1 * -(-sum(lengths) // 64)


def test_packing_takes_odd_tables(spark):
    rows = [(1, 5, 9, "s"), (1, 5, 9, "s"), (2, None, 8, "t"), (3, 0, None, None), (None, 10, 1, "u")]
    df = spark.createDataFrame(rows, "doc_id long, length long, offset long, room string")
    got = pack_best_fit(df, 10).toPandas()
    assert sorted(got.columns) == ["doc_id", "length", "offset", "room", "sequence_id"] and len(got) == 5
    assert check_sequences(got[got.length > 0], 10) == 2
    assert got[got.length.isna()].offset.isna().all() and got.sequence_id.nunique() == 4
    assert pack_best_fit(df.limit(0), 10).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        pack_best_fit(df.withColumn("length", F.lit(11)), 10).count()
