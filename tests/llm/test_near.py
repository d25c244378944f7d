from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from burnish.llm import jaccard
from burnish.llm.embeddings import near_vectors
from burnish.llm.jaccard import TOccurrence, jaccard_components, near_dedup, needed
from tests.llm.shared import awkward, documents, prose, reached


def sets_of(texts, width):
    out = []
    for text in texts:
        w = (text or "").encode().lower().split()
        out.append(set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    return out


def expected(rows, width, share):
    sets = sets_of([t for _, t, _ in rows], width)
    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            lists[x].append(k)
    shared = defaultdict(int)
    for members in lists.values():
        for b, j in enumerate(members):
            for i in members[:b]:
                shared[i, j] += 1
    links = [(i, j) for (i, j), n in shared.items() if 100 * n >= share * (len(sets[i]) + len(sets[j]) - n)]
    root = reached(len(rows), links)
    least = defaultdict(lambda: None)
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = i if least[root[k]] is None else min(i, least[root[k]])
    return sorted((i if i is not None else -1, len(sets[k]), -1 if least[root[k]] is None else least[root[k]]) for k, (i, _, _) in enumerate(rows))


def found(df, width, share):
    got = jaccard_components(df, width, share).toPandas().fillna(-1)
    return sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].astype(int).to_numpy().tolist()))


def corpus(seed, groups=12, members=9):
    """Groups of edited copies of edited copies, around the threshold, with passages that many texts share."""
    draw, rows, number = random.Random(seed), [], 0
    passage = prose(10_000 + seed, 40).split()
    for g in range(groups):
        words = prose(seed * 100 + g, draw.randint(3, 120)).split()
        for _ in range(members):
            number += 1
            copy = list(words)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = f"edit{draw.randint(0, 5)}"
            if draw.random() < 0.3:
                words = copy
            if draw.random() < 0.2:
                copy = copy + passage
            rows.append((number, " ".join(copy), "a"))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "share", "seed"), [(4, 85, 1), (5, 80, 2), (2, 50, 3), (3, 100, 4)])
def test_components_equal_brute_force(spark, width, share, seed):
    rows = corpus(seed)
    assert found(documents(spark, rows).repartition(5), width, share) == expected(rows, width, share)


def test_small_blocks_and_few_frequent_tokens_change_nothing(spark, monkeypatch):
    rows = corpus(7, 4, 40)
    want = expected(rows, 4, 85)
    for block, frequent in ((2, 8), (512, 1)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        monkeypatch.setattr(jaccard, "COUNTED", 500)
        assert found(documents(spark, rows).repartition(3), 4, 85) == want


def test_awkward_rows_and_dedup(spark):
    rows = awkward()
    df = documents(spark, rows)
    assert found(df, 4, 85) == expected(rows, 4, 85)
    out = near_dedup(df)
    assert out.columns == df.columns
    kept = out.toPandas()
    assert 2 in set(kept.doc_id) and not {5, 9} & set(kept.doc_id) and {11, 12, 13} <= set(kept.doc_id)
    assert (kept.doc_id == 18).sum() == 1
    assert found(documents(spark, []), 4, 85) == [] and near_dedup(documents(spark, [])).count() == 0


def test_search_finds_what_brute_force_finds():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**60, 60).astype(np.uint64)
    sets = [np.unique(np.where(draw.random(60) < draw.random() * 0.3, draw.integers(0, 2**60, 60).astype(np.uint64), base)) for _ in range(80)]
    index = TOccurrence(sets, 80)
    for s in sets:
        want = [k for k, o in enumerate(sets) if len(np.intersect1d(s, o)) >= needed(len(s), len(o), 80)]
        assert sorted(index.search(s)) == want


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep long, key long")


def linked(rows, threshold):
    n, count, links = len(rows), [0] * len(rows), []
    unit = []
    for _, v, label in rows:
        good = v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if good else None
        unit.append(x / np.linalg.norm(x) if good else None)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] >= threshold:
                    count[i] += 1
                    count[j] += 1
                    links.append((i, j))
    root = reached(n, links)
    return [(rows[k][0], count[k], min(rows[m][0] for m in range(n) if root[m] == root[k])) for k in range(n)]


def test_vectors_equal_brute_force(spark, monkeypatch):
    from burnish.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", 16)
    draw = np.random.default_rng(2)
    rows = []
    for g in range(25):
        center = draw.normal(size=24)
        for _ in range(int(draw.integers(1, 30))):
            rows.append((len(rows), (center + draw.normal(size=24) * 0.08 * draw.random()).tolist(), g % 3))
    rows += [(1_000 + k, rows[0][1], 0) for k in range(20)]
    rows += [(2_000, None, 1), (2_001, [], 1), (2_002, [0.0] * 24, 1), (2_003, [float("nan")] + [1.0] * 23, 1), (2_004, [None] + [1.0] * 23, 1)]
    rows += [(2_005, rows[0][1], None), (2_006, rows[0][1][:10], 0), (2_007, [x * 2 for x in rows[0][1]], 0)]
    got = near_vectors(vectors(spark, rows), 0.98).toPandas().sort_values("vec_id")
    want = sorted(linked(rows, 0.98))
    mine = list(zip(got.vec_id, got.n_links, got.component_id))
    assert all(m[1] <= w[1] for m, w in zip(mine, want))
    assert sum(m[1] for m in mine) >= 0.99 * sum(w[1] for w in want)
    assert np.mean([m[2] == w[2] for m, w in zip(mine, want)]) > 0.97
    assert (got.kept == (got.vec_id == got.component_id)).all()
    assert near_vectors(vectors(spark, [])).count() == 0
    assert near_vectors(vectors(spark, [(1, None, 1)])).toPandas().n_links.tolist() == [0]


def test_a_worker_forgets_what_other_operators_remembered():
    from burnish.llm import common, jaccard, quality

    common.alone("quality", quality._known.clear)
    quality.buckets("some words")
    common.alone("quality", quality._known.clear)
    assert quality._known
    common.alone("jaccard", jaccard._known.clear)
    assert not quality._known
    jaccard.shingles("some more words of a text", 2)
    common.alone("quality", quality._known.clear)
    assert not jaccard._known
