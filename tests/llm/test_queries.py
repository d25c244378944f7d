"""Every registered query of the corpus operators on the smallest tables, against SQL, the library or brute force."""

from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from burnish.llm.queries import oracle, registered
from check import database, differences
from tests.llm.shared import reached
from tests.llm.test_near import expected
from tests.llm.test_runs import slow_runs

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"select doc_id, text, source from read_parquet('{SMALL}/documents.parquet')").fetchall()
    return sorted((i, t or "", s) for i, t, s in rows)


def run(spark, name):
    return registered()[name](spark, SMALL)


def by_doc(spark, name):
    return {r["doc_id"]: r for r in run(spark, name).collect()}


def sha(text) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def as_bytes(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", sorted(oracle()))
def test_queries_with_sql(spark, name):
    problem, rows = differences(run(spark, name), database(SMALL).sql(oracle()[name]))
    assert not problem and rows


def test_every_query_is_tested_here(spark):
    here = {n.removeprefix("test_") for n in globals()}
    for name in registered():
        assert name in oracle() or name.split("_")[0] in here or name == "pipeline", name  # the pipeline has tests of its own


def test_op1(spark, documents):
    want = {i: (n, c) for i, n, c in expected(documents, 4, 85)}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_doc(spark, "op1_ngram_jaccard_join").items()} == want


def test_op2(spark, documents):
    rows = by_doc(spark, "op2_sharding")
    assert len(rows) == len(documents) and {r["law"] for r in rows.values()} == {"bytes"}
    shards, slots, copies = {}, {}, {}
    for i, text, _ in documents:
        r = rows[i]
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        shards[r["shard"]] = shards.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        copies.setdefault(text, set()).add(r["shard"])
    assert set(shards) <= set(range(16)) and all(len(s) == 1 for s in copies.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(rows[i]["size"] for i, _, _ in documents)
    assert max(shards.values()) - min(shards.values()) <= largest


def test_op3(spark, documents):
    first = {}
    for i, text, _ in documents:
        data = text.encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    rows = by_doc(spark, "op3_repeated_bytes")
    for i, text, _ in documents:
        data = text.encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        assert tuple(rows[i])[:5] == (i, len(data), int(gone.sum()), spans, sha(kept))


def test_op4(spark):
    rows = duckdb.sql(f"select vec_id, embedding, label from read_parquet('{SMALL}/embeddings.parquet') order by vec_id").fetchall()
    vectors = np.array([v for _, v, _ in rows], float)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    labels = np.array([-1 if x is None else x for _, _, x in rows])
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels) & (labels >= 0)[:, None] & ~np.eye(len(rows), dtype=bool)
    roots = reached(len(rows), np.argwhere(linked).tolist())
    want = {rows[k][0]: (int(linked[k].sum()), rows[roots[k]][0]) for k in range(len(rows))}
    got = {r["vec_id"]: r for r in run(spark, "op4_embedding_near_dedup").collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_op6(spark, documents):
    rows = by_doc(spark, "op6_quality")
    assert sorted(rows) == [i for i, _, _ in documents]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    quality = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{SMALL}/labels.parquet')").fetchall())
    held = [r["predicted"] == quality[i] for i, r in rows.items() if r["held_out"] and i in quality]
    assert np.mean(held) >= 0.85


def test_op7(spark, documents):
    library, rows = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), by_doc(spark, "op7_bpe")
    for i, text, _ in documents:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(rows[i])[:4] == (i, len(ids), sha(as_bytes(ids)), sha(decoded))


def test_op8(spark, documents):
    library, rows = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), by_doc(spark, "op8_token_records")
    start = 0
    for i, text, _ in documents:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert tuple(rows[i])[:4] == (i, start, len(ids), zlib.crc32(as_bytes(ids)))
        start += len(ids)
    assert len(rows) == len(documents)


def test_op9(spark, documents):
    rows = by_doc(spark, "op9_mixing")
    sizes, sources = {i: len(WORD.findall(t.encode())) for i, t, _ in documents}, {i: s for i, _, s in documents}
    order = sorted({s for s in sources.values() if s is not None}) + ([None] if None in sources.values() else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(n for i, n in sizes.items() if sources[i] == s) for s in order}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        for s in full or open_:
            target[s] = float(3 * total[s]) if full else share[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = dict.fromkeys(order, 0)
    for i, r in rows.items():
        assert (r["size"], r["source_size"]) == (sizes[i], total[sources[i]]) and 0 <= r["taken"] <= 3 * sizes[i]
        assert r["target"] == pytest.approx(target[sources[i]])
        taken[sources[i]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(1, 0.01 * target[s]) for s in order)


def test_op12(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences, tokens = {}, {}, 0
    for r in run(spark, "op12_best_fit_packing").collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text, _ in documents:
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(as_bytes(part)))
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids) and (len(ids) > 2048 or len(pieces[i]) == 1)
        tokens += at
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(pieces) == len(documents) and len(sequences) <= 1.01 * -(-tokens // 2048) + 1


def test_op13(spark, documents):
    rows = by_doc(spark, "op13_periodic_runs")
    looped = 0
    for i, text, _ in documents:
        words, h = WORD.findall(text.encode()), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            looped += 1
        if n > 3_000:
            continue  # brute force takes the square of the words
        runs = slow_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        left = b" ".join(w for k, w in enumerate(words) if k not in dropped)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        assert tuple(rows[i]) == (i, len(runs), *best, milli, sha(listed), sha(left))
    assert looped and len(rows) == len(documents)
