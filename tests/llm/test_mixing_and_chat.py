from __future__ import annotations

import numpy as np
import pytest

from burnish.llm.chat import maximal_conversations
from burnish.llm.mixing import mix, mixed_documents, source_targets
from tests.llm.shared import awkward, documents, prose


def shares(sizes, weights, most):
    """Targets by sharing the excess again and again."""
    total, target = sum(sizes), [0.0] * len(sizes)
    free = [k for k in range(len(sizes))]
    rest = float(total)
    while free:
        level = rest / sum(weights[k] for k in free)
        full = [k for k in free if level * weights[k] >= most * sizes[k]]
        if not full:
            for k in free:
                target[k] = level * weights[k]
            break
        for k in full:
            target[k] = most * sizes[k]
            rest -= target[k]
        free = [k for k in free if k not in full]
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_share_the_excess(spark, seed):
    random = np.random.default_rng(seed)
    sizes = (random.pareto(1, 11) * 100).astype(int).tolist() + [0]
    names = [f"s{k:02}" for k in range(11)] + [None]
    table = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
    got = source_targets(table).toPandas().sort_values("source_no")
    want = shares(sizes, [(5, 2, 1)[k % 3] for k in range(12)], 3)
    assert np.allclose(got.target, want)


def test_mix_comes_near_its_targets(spark):
    rows = [(k, prose(k, 20 + k % 50), "abcdefg"[min(6, k % 13)]) for k in range(600)]
    taken, pieces = mix(documents(spark, rows), slots=2**12)
    got = taken.toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 20).all()
    assert (got.taken <= 3 * got["size"]).all()
    again = mix(documents(spark, rows[::-1]), slots=2**12)[0].toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    # The schedule is spread: every tenth of it has about a tenth of each source.
    plan = pieces.toPandas()
    large = plan[plan.source_no == 0]
    counts = np.histogram(large.slot, 10, weights=large.words)[0]
    assert counts.max() < 1.1 * counts.min()


def test_mix_takes_exactly_what_is_due_of_every_source(spark):
    # Fewer slots than sources are asked for, one source is large, and shares are below half a document.
    rows = [(k, prose(k, 90), f"s{k:03}") for k in range(60)] + [(k, prose(k, 300), "large") for k in range(100, 130)]
    taken, pieces = mix(documents(spark, rows), slots=8)
    got = taken.toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (by.taken == np.maximum(np.floor(by.target + 0.5), 1)).all()
    plan = pieces.toPandas()
    assert plan.words.sum() == got.taken.sum() and plan.groupby("slot").words.sum().max() <= 256
    order = plan[["slot", "source_no", "block"]].drop_duplicates().sort_values("slot")
    assert order.slot.tolist() == list(range(len(order)))
    assert all(g.block.tolist() == list(range(len(g))) for _, g in order.groupby("source_no"))
    few = [(k, prose(k, 90), f"s{k:03}") for k in range(60)]
    out = mixed_documents(documents(spark, few), slots=8, weights=(50, 1)).toPandas()
    assert set(out.source) == {s for _, _, s in few}


def test_mix_takes_awkward_rows(spark):
    rows = awkward()
    got = mix(documents(spark, rows))[0].toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    assert (got[got["size"] == 0].taken == 0).all()
    out = mixed_documents(documents(spark, rows))
    assert out.columns == documents(spark, []).columns
    assert {12, 13, 11} <= set(out.toPandas().doc_id.dropna().astype(int))
    assert mix(documents(spark, []))[0].count() == 0 and mixed_documents(documents(spark, [])).count() == 0
    nothing = documents(spark, [(1, None, None), (2, "", "a")])
    assert mix(nothing)[0].toPandas().target.tolist() == [0.0, 0.0]


SCHEMA = "conv_id long, turn long, role string, text string, key string, place int, part int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def test_prefixes_go_and_the_rest_is_rendered(spark):
    a, b, c = ("user", "hello"), ("assistant", "hi"), ("user", "bye")
    logged = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, c], 5: [b], 6: [a, b, c], 7: [("user", None)], 8: [("user", "")], 9: [(None, "hello")]}
    rows = [(k, n, r, t) for k, turns in logged.items() for n, (r, t) in enumerate(turns)]
    got = maximal_conversations(chats(spark, rows)).toPandas().sort_values("conv_id")
    assert got.conv_id.tolist() == [3, 4, 5, 7, 8, 9]
    assert got.n_copies.tolist() == [2, 1, 1, 1, 1, 1]
    text = got.set_index("conv_id").text
    assert text[4] == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert text[7] == text[8] and text[9].startswith("<|im_start|>unknown\n")


def test_chat_takes_ties_missing_ids_and_long_conversations(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "user", "y"), (1, None, "user", "z"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    rows += [(2, k, "user", str(k)) for k in range(3_000)] + [(3, k, "user", str(k)) for k in range(2_000)]
    got = maximal_conversations(chats(spark, rows)).toPandas()
    assert sorted(got.conv_id.dropna()) == [1, 2, 2, 2] and got.conv_id.isna().sum() == 1
    long = got[got.conv_id == 2].sort_values("part")
    assert "".join(long.text) == "".join(f"<|im_start|>user\n{k}<|im_end|>\n" for k in range(3_000))
    assert got[got.conv_id == 1].n_turns.tolist() == [3]
    assert maximal_conversations(chats(spark, [])).count() == 0


def test_native_operators_run_no_python(spark, plan_of):
    for df in (mix(documents(spark, awkward()))[0], maximal_conversations(chats(spark, [(1, 0, "user", "x")]))):
        assert not any(x in plan_of(df) for x in ("Python", "Pandas", "Arrow"))
