from __future__ import annotations

import random

import numpy as np
import pytest

from burnish.llm.runs import Agreement, candidates, periodic_runs, runs_of, suffix_tree
from tests.llm.shared import awkward, documents


def slow_runs(words, periods=4, least=6):
    """Every period, every maximal stretch; only the smallest period of a stretch counts."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            smaller = any(all(words[s + k] == words[s + k + d] for k in range(length - d)) for d in range(1, q))
            if length >= max(least, periods * q) and not smaller:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def looping(draw, letters, size):
    words = []
    while len(words) < size:
        root = [draw.randrange(letters) for _ in range(draw.randint(1, 5))]
        words += (root * 9)[: draw.randint(1, 9 * len(root))]
    return words


@pytest.mark.parametrize("periods, least", [(4, 6), (2, 2), (3, 10)])
def test_runs_agree_with_brute_force(periods, least):
    draw = random.Random(periods)
    for _ in range(400):
        letters = draw.randint(1, 4)
        docs = [looping(draw, letters, draw.randint(0, 50)) for _ in range(draw.randint(1, 4))]
        words = np.array([w for d in docs for w in d], np.int64)
        parts = np.array([k for k, d in enumerate(docs) for _ in d], np.int64)
        starts = np.cumsum([0, *map(len, docs)])
        want = [[s + at, length, q] for at, d in zip(starts, docs) for s, length, q in slow_runs(d, periods, least)]
        assert runs_of(words, parts, periods, least).tolist() == want


def test_tree_and_agreement():
    draw = random.Random(2)
    for _ in range(100):
        symbols = [draw.randrange(3) for _ in range(draw.randint(1, 60))] + [9]
        start, end, suffix, branch = suffix_tree(symbols)
        assert sorted(x for x in suffix if x >= 0) == list(range(len(symbols)))
        agree = Agreement(symbols)
        assert agree.leaves.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
        a, b = (x[np.newaxis, :].ravel() for x in np.triu_indices(len(symbols), 1))
        want = [next(k for k in range(len(symbols)) if j + k >= len(symbols) or symbols[i + k] != symbols[j + k]) for i, j in zip(a, b)]
        assert not len(a) or agree(a, b).tolist() == want


def test_candidates_leave_out_no_run():
    words = np.array([7, 1, 2, 1, 2, 1, 2, 1, 2, 8, 5, 5, 5, 9, 1, 2], np.int64)
    assert candidates(words, np.zeros(16, np.int64)) == [(1, 9)]
    assert candidates(words, np.array([0] * 5 + [1] * 11, np.int64)) == []
    assert candidates(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


def test_texts(spark):
    texts = [*awkward(), (30, " a b\ta  b a b a\nb a x x x x x x x ", "r"), (31, "z " * 50_000, "r"), (32, "é \x1c é \x1c é \x1c é \x1c", "r")]
    df = documents(spark, texts)
    got = periodic_runs(df.withColumnsRenamed({"row": "runs", "key": "owner"})).collect()
    assert len(got) == len(texts) and "score" in got[0].asDict()
    by_id = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got}
    assert by_id[30] == ([(0, 9, 2), (9, 7, 1)], "a b x")
    assert by_id[31] == ([(0, 50_000, 1)], "z")
    assert by_id[32] == ([(0, 8, 2)], "é \x1c")
    assert by_id[11] == by_id[12] == by_id[13] == ([], "")
    assert by_id[14] == ([], "one two") and by_id[9] == ([], " ".join(texts[2][1].split()))
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs(df, periods=1)
