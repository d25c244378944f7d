from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from burnish.llm import bpe, records
from burnish.llm.bpe import ByteBpe, decode_documents, encode_documents
from burnish.llm.records import PieceEncoder, framed, read_record, read_records, read_shuffled, write_records
from tests.llm.shared import awkward, documents

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def wild(seed: int) -> str:
    draw = random.Random(seed)
    pools = ["etaoin shrdlu", "aaaaab", "0123456789", " \t\n\x0b\x1c\x1f\x85  　", "éüñßΣς", "日本語한국", "😀👩‍👧🏽", "'sS'll'RE", "̸́", "İıſK"]
    return "".join(draw.choice(draw.choice(pools)) for _ in range(draw.randint(0, 400)))


@pytest.fixture(scope="module")
def texts():
    return [t or "" for _, t, _ in awkward()] + [wild(k) for k in range(300)] + ["a" * 5_000, " " * 99, "<|endoftext|>" * 3]


def test_bpe_agrees_with_the_library(texts):
    library, own = Tokenizer.from_file(BYTES), ByteBpe(BYTES)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [own.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_memory_of_words_is_bounded_and_changes_nothing(texts, monkeypatch):
    library = Tokenizer.from_file(BYTES)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = ByteBpe(BYTES)
    for text in [*texts[:80], "q" * 500, "q" * 500, "nul\0 and\0\0 nul"]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.older and not any(len(w) > bpe.LONG for w in [*own.known, *own.older])
    monkeypatch.setattr(records, "REMEMBERED_BYTES", 2_000)
    library, pieces = Tokenizer.from_file(WORDS), PieceEncoder(WORDS)
    for text in texts[:80]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(pieces.encode([text.encode()])[0], f"<u{pieces.width}").tolist() == want
    assert pieces.older


def test_other_vocabularies_go_through_the_library(texts, tmp_path):
    """One whose tokens may reach across white space is not cut there, and one without merge order is merged by its pairs."""
    spec = json.loads(open(WORDS, encoding="utf-8").read())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[^.]+|\."}
    (tmp_path / "w.json").write_text(json.dumps(spec))
    own, library = PieceEncoder(str(tmp_path / "w.json")), Tokenizer.from_file(str(tmp_path / "w.json"))
    assert not own.by_pieces
    some = ["two words. and  more", "", "x y"]
    assert [np.frombuffer(x, f"<u{own.width}").tolist() for x in own.encode([t.encode() for t in some])] == [
        library.encode(t, add_special_tokens=False).ids for t in some
    ]
    spec = json.loads(open(BYTES, encoding="utf-8").read())
    vocabulary = spec["model"]["vocab"]
    vocabulary["he"], vocabulary["in"] = vocabulary["in"], vocabulary["he"]
    (tmp_path / "b.json").write_text(json.dumps(spec))
    own, library = ByteBpe(str(tmp_path / "b.json")), Tokenizer.from_file(str(tmp_path / "b.json"))
    assert own.ranked is None
    want = [e.ids for e in library.encode_batch(texts[:60], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts[:60])] == want


def test_speculation_and_exact_merging_agree():
    own = ByteBpe(BYTES)
    words = [w for k in range(200) for w in own.split.findall(wild(k))] + ["the", " understandable", "zzzzzzzz", "a" * 200]
    exact = [own.ids[own.exact(w.encode())].astype("<u4").tobytes() for w in words]
    assert own.encode_words(words) == exact
    proposed = [own.propose(w.encode()) for w in words]
    assert any(own.ids[p].astype("<u4").tobytes() == e for p, e in zip(proposed, exact))
    assert any(own.ids[p].astype("<u4").tobytes() != e for p, e in zip(proposed, exact))


def test_pairs_are_compatible_where_merging_leaves_them(spark):
    own = ByteBpe(BYTES)
    draw = np.random.default_rng(3)
    names = np.array(sorted(own.tokens.values()))
    a, b = draw.choice(names, 3_000), draw.choice(names, 3_000)
    data = {k: t for t, k in own.tokens.items()}
    want = [own.exact(data[x] + data[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert own.compatible(a, b).tolist() == want


def test_documents_round_trip(spark):
    df = documents(spark, awkward())
    coded = decode_documents(encode_documents(df, BYTES), BYTES)
    assert coded.columns == [*df.columns, "ids", "decoded"]
    assert all((r["text"] or "") == r["decoded"] for r in coded.collect())
    assert encode_documents(df.limit(0), BYTES).count() == 0


def test_pieces_agree_with_the_library(texts):
    library, own = Tokenizer.from_file(WORDS), PieceEncoder(WORDS)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, f"<u{own.width}").tolist() for x in own.encode([t.encode() for t in texts])] == want


def test_records_read_back_in_order(spark):
    rows = awkward()
    manifest = write_records(documents(spark, rows), WORDS, end_id=2)
    got = read_records(spark, manifest).toPandas().sort_values("start", ignore_index=True)
    library = Tokenizer.from_file(WORDS)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows if i is not None}
    assert len(got) == len(rows)
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all()
    assert got.doc_id.dropna().is_monotonic_increasing and got.doc_id.isna().tolist()[:2] == [True, True]
    for _, r in got[got.doc_id.notna()].iterrows():
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]]
    drawn = [read_shuffled(spark, manifest, seed).toPandas() for seed in (1, 2, 1)]
    assert all(sorted(map(bytes, d.ids)) == sorted(map(bytes, got.ids)) for d in drawn)
    assert list(drawn[0].ids) == list(drawn[2].ids) != list(drawn[1].ids)
    empty = write_records(documents(spark, []), WORDS)
    assert read_records(spark, empty).count() == 0


def test_damage_is_found():
    import io

    record = framed(b"payload")
    assert read_record(io.BytesIO(record)) == b"payload" and read_record(io.BytesIO(b"")) is None
    for k in range(len(record)):
        broken = bytearray(record)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            read_record(io.BytesIO(bytes(broken)))
    with pytest.raises(ValueError):
        read_record(io.BytesIO(record[:-2]))


def test_new_pieces_are_encoded_many_to_a_text(monkeypatch):
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces = [f"{a}é{k}{b}" for k in range(300) for a, b in (("Wor", "ß!"), ("<|endoftext|>", "x"))] + ["a\x01b", "\x01", "ﬁ\x01", "plain", "It's", " é"]
    want = [np.array(encoder.tokenizer.encode(p, add_special_tokens=False).ids, "<u2").tobytes() for p in pieces]
    sent, library = [], encoder._library
    monkeypatch.setattr(encoder, "_library", lambda texts: sent.extend(texts) or library(texts))
    assert encoder.encode([p.encode() for p in pieces]) == want
    alone = sum(records.MARK in p.encode() for p in pieces)
    assert len(sent) <= alone + len(pieces) // records.PIECES + 1
