from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from burnish.llm import repeats
from burnish.llm.quality import fit_network, keep_good, score_quality
from burnish.llm.repeats import remove_repeats, sorted_blocks
from tests.llm.shared import awkward, documents, prose


def marked(rows, depth):
    """For each row its bytes with those to be removed set to None."""
    order = [(2**63 - 1 if i is None else i) for i, _, _ in rows]
    data = [(t or "").encode() for _, t, _ in rows]
    first: dict[bytes, int] = {}
    for o, t in sorted(zip(order, data)):
        for k in range(len(t) - depth + 1):
            first.setdefault(t[k : k + depth], o)
    out = []
    for o, t in zip(order, data):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - depth + 1):
            if first[t[k : k + depth]] < o:
                gone[k : k + depth] = True
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone]), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum())))
    return out


def compare(spark, rows, depth=50, **options):
    got = remove_repeats(documents(spark, rows).repartition(3), depth, **options).toPandas()
    mine = sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), bytes(r.kept), int(sum(r.ends) - sum(r.starts)), len(r.starts), int(r.n_bytes)) for r in got.itertuples())
    want = sorted((-1 if i is None else i, *m, len((t or "").encode())) for (i, t, _), m in zip(rows, marked(rows, depth)))
    assert mine == want


def passages(seed):
    draw = random.Random(seed)
    shared = [prose(900 + k, 12) for k in range(4)]
    rows = []
    for k in range(30):
        parts = [prose(seed * 50 + k, draw.randint(0, 30))] + draw.choices(shared, k=draw.randint(0, 3))
        draw.shuffle(parts)
        rows.append((k, draw.choice([" ", ""]).join(parts)[draw.randint(0, 9) :], "a"))
    return rows + [(50, "ab" * 200, "a"), (51, "ba" * 90, "a"), (52, "a" * 300, "a"), (53, "a" * 60, "a"), (54, "a" * 49, "a")]


@pytest.mark.parametrize("seed", range(2))
def test_removal_equals_brute_force(spark, seed):
    compare(spark, passages(seed))
    compare(spark, awkward() + passages(seed)[:10], 50, rounds=2)


def test_cuts_and_small_buckets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HASHED", 256)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(repeats, "SORTED", 64)
    compare(spark, passages(3), 40)
    assert remove_repeats(documents(spark, [])).count() == 0


def test_long_strings_are_found_and_short_ones_refused(spark):
    shared = prose(77, 600)
    compare(spark, [(k, prose(k, 30) + shared[200 * k :] + prose(100 + k, 30), "a") for k in range(4)], 600)
    with pytest.raises(ValueError):
        remove_repeats(documents(spark, []), 19)


def lines(count):
    """Texts that share a line with other text around it, and some that share more."""
    line = " the one line that very many of the documents have in common "
    return [(k, prose(k, 8) + line + prose(2_000 + k % (count - 20), 8), "a") for k in range(count)]


def test_a_line_of_many_documents_is_spread_over_buckets(spark, monkeypatch):
    dealt, kept = [], repeats.keep

    def sizes(depth):
        def run(batches):
            for batch in batches:
                for bucket, removal, data in zip(*(c.to_pylist() for c in batch.columns)):
                    many = 0 if removal else repeats.unpacked(data, repeats.SEGMENTS)[-1].size
                    yield repeats.found_batch([bucket], [0], [0], [many])

        return run

    def keep(df, name):
        df = kept(df, name)
        dealt.append(df.toPandas().groupby("order")["length"].sum())
        return df

    monkeypatch.setattr(repeats, "_removed", sizes)
    monkeypatch.setattr(repeats, "keep", keep)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 12_000)
    remove_repeats(documents(spark, lines(600)).repartition(3), 50)
    # The runs of the line's hashes have some 30,000 bytes each.
    assert dealt and max(d.max() for d in dealt) < 3 * 12_000


def test_strings_dealt_one_by_one_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 6_000)
    monkeypatch.setattr(repeats, "HOT_LEAST", 2)
    rows = lines(120) + passages(4) + [(None, lines(120)[0][1], "a"), (7, lines(120)[9][1], "b")]
    texts = documents(spark, rows).selectExpr("doc_id as order", "xxhash64(text) as key", "cast(text as binary) as data")
    assert len(repeats.hot_anchors(texts, 50)[0])
    compare(spark, rows)


def dealt(texts, depth, tasks, hot=None):
    """What several tasks deal into one bucket."""
    rows = []
    for task in range(tasks):
        dealer = repeats.Dealer(depth, 0, 1, 1, hot)
        dealer.add([(k, k, text) for k, text in enumerate(texts) if k % tasks == task])
        rows += dealer.deal()
    names = {"bucket": pa.int64(), "removal": pa.bool_(), "data": pa.binary()}
    return pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], pa.schema(names))


def test_many_buckets_hold_what_one_holds_and_are_filled_together(monkeypatch):
    calls, gathered = [], repeats.gathered
    monkeypatch.setattr(repeats, "gathered", lambda *a: calls.append(1) or gathered(*a))
    texts = [(k, k + 100, prose(k, 300).encode()) for k in range(40)]

    def held(buckets, hot=None):
        out = []
        dealer = repeats.Dealer(50, 0, 1, buckets, hot)
        dealer.add(texts)
        for bucket, removal, data in dealer.deal():
            assert not removal
            hashes, orders, keys, number, offsets, counts, text = repeats.unpacked(data, repeats.SEGMENTS)
            assert set((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)) == {bucket} and len(set(orders)) == len(orders)
            at = 0
            for h, n, o, c in zip(hashes.tolist(), number.tolist(), offsets.tolist(), counts.tolist()):
                out.append((h, orders[n], keys[n], o, c, text[at : at + c + 49].tobytes()))
                at += c + 49
            assert at == len(text)
        return sorted(out)

    one = held(1)
    assert all(t == texts[d][2][o : o + c + 49] and key == d + 100 for _, d, key, o, c, t in one)
    calls.clear()
    assert held(700) == one and len(calls) < 10
    monkeypatch.setattr(repeats, "GATHERED", 3_000)
    hot = np.array(sorted({h for h, *_ in one})[::2], np.uint64)
    assert held(700) == one and held(700, hot) == held(1, hot) and len(held(3, hot)) > len(one)


def test_runs_that_are_equal_are_sorted_once(monkeypatch):
    sorted_ = []

    def blocks(text, starts, depth):
        sorted_.append(len(starts))
        yield from sorted_blocks(text, starts, depth)

    monkeypatch.setattr(repeats, "sorted_blocks", blocks)
    passage = prose(5, 200)
    texts = [(prose(600 + k, 4) + passage + prose(700 + k, 4)).encode() for k in range(40)]
    gone = [np.zeros(len(t), bool) for t in texts]
    for batch in repeats._removed(50)(iter([dealt(texts, 50, len(texts))])):
        for k, _, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            gone[k][start : start + length] = True
    want = marked([(k, t.decode(), "a") for k, t in enumerate(texts)], 50)
    assert [int(g.sum()) for g in gone] == [m[1] for m in want] and sum(m[1] for m in want) >= 39 * len(passage)
    # The passage's inner runs are the same in all texts; only those at its ends differ.
    assert sum(sorted_) < sum(len(t) - 49 for t in texts) / 4


def test_strings_of_equal_hashes_stay_apart():
    # The Thue-Morse word and its complement: any polynomial hash modulo 2**64 with an odd base takes them for equal.
    word = bytes(97 + k.bit_count() % 2 for k in range(1024))
    texts = [word, bytes(195 - c for c in word)]
    valid = np.ones(1024, bool)
    hot = np.sort(np.concatenate([repeats.anchored(np.frombuffer(t, np.uint8), valid, 1024)[2] for t in texts]))
    for known in (None, np.unique(hot)):
        assert not any(dealt(texts, 1024, 1, known).column(1).to_pylist())
        assert dealt([texts[0], texts[0]], 1024, 1, known).column(1).to_pylist().count(True) == 1


def test_equal_hashes_are_compared_byte_by_byte(monkeypatch):
    monkeypatch.setattr(repeats, "mixed", lambda words: np.zeros(len(words), np.uint64))
    texts = [prose(k % 3, 12).encode() for k in range(9)] + [prose(1, 12).encode() + b"x", prose(3, 3).encode()]
    rows = [(k, t.decode(), "a") for k, t in enumerate(texts)]
    gone = [np.zeros(len(t), bool) for t in texts]
    for batch in repeats._removed(50)(iter([dealt(texts, 50, 2)])):
        for k, _, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            gone[k][start : start + length] = True
    assert [int(g.sum()) for g in gone] == [m[1] for m in marked(rows, 50)]


@pytest.mark.parametrize("sought", [64, 2**15, 2**16])
def test_least_places_do_not_depend_on_what_is_sought_at_once(sought, monkeypatch):
    monkeypatch.setattr(repeats, "SOUGHT", sought)
    text = np.frombuffer(("ab" * 60 + "c" * 90 + prose(9, 60)).encode(), np.uint8)
    hashes = repeats.rolling(text, repeats.ANCHOR) >> 16
    want = [k + int(np.argmin(hashes[k : k + 31])) for k in range(len(text) - 49)]
    assert repeats.least_places(text, 50).tolist() == want


@pytest.mark.parametrize("alphabet", [2, 3, 200])
def test_suffixes_come_in_order(alphabet, monkeypatch):
    monkeypatch.setattr(repeats, "SORTED", 500)
    draw = np.random.default_rng(alphabet)
    text = draw.integers(1, 1 + alphabet, 4_000).astype(np.uint8)
    text[1_000:1_400] = text[2_000:2_400]
    text[3_000:3_200] = 1
    padded = np.concatenate([text, np.zeros(90, np.uint8)])
    starts = draw.permutation(len(text) - 50)
    whole, before = [], None
    for at, differs in sorted_blocks(padded, starts, 50):
        for a, d in zip(at.tolist(), differs.tolist()):
            now = padded[a : a + 50].tobytes()
            assert before is None or now >= before
            assert d == (now != before) or before is None or at[0] == a
            whole.append(a)
            before = now
    assert sorted(whole) == sorted(starts.tolist())


def judged(k):
    text = prose(k, 60)
    return text if k % 2 else " ".join(w + "!!" for w in text.upper().split())


def test_quality_is_learned_and_calibrated(spark):
    rows = [(k, judged(k), "a") for k in range(900)] + [(5_000, None, "a"), (5_001, "", "a"), (None, prose(1, 9), "a"), (5, judged(5), "a")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(900)] + [(None, 1, 1), (3, None, 0), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    df = documents(spark, rows)
    scored = score_quality(df, labels)
    got = scored.toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert scored.columns == [*[c for c in df.columns], "held_out", "predicted"]
    known = got[got.doc_id < 900]
    held = known[known.held_out]
    assert (held.held_out == [zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in held.doc_id]).all()
    assert (held.predicted == held.doc_id % 2).mean() > 0.97
    good = keep_good(df, labels)
    assert good.columns == df.columns and (good.toPandas().doc_id.dropna() % 2 == 1).mean() > 0.95


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert score_quality(documents(spark, awkward()), labels).toPandas().score.eq(0.5).all()
    assert score_quality(documents(spark, []), labels).count() == 0


def test_temperature_brings_scores_to_frequencies():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4_000, 5))
    y = (draw.random(4_000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    score = fit_network(x, y).score(x)
    for low in (0.1, 0.4, 0.7):
        part = (score >= low) & (score < low + 0.2)
        assert abs(y[part].mean() - score[part].mean()) < 0.08
