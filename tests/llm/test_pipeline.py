from __future__ import annotations

import hashlib
import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.shared import awkward, documents, prose
from tests.llm.test_near import expected

SMALL = "/root/testdata/sf0.001"


def test_every_stage_keeps_the_columns_and_does_its_work(spark):
    docs = corpus_pipeline.read(spark, SMALL, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SMALL))
        seen[name] = docs.toPandas()
        if name != "tokens":
            assert docs.columns == columns
    normal = seen["quality"].text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t))
    first = seen["quality"].assign(n=normal).sort_values("doc_id").drop_duplicates("n")
    assert sorted(first.doc_id) == sorted(seen["exact"].doc_id)
    rows = [(i, t, "a") for i, t in zip(seen["exact"].doc_id, seen["exact"].text)]
    assert sorted(seen["near"].doc_id) == sorted({c for _, _, c in expected(rows, 5, 80)})
    assert set(seen["mixing"].doc_id) <= set(seen["near"].doc_id)
    assert seen["mixing"].doc_id.value_counts().max() <= 3
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids, n in zip(seen["tokens"].text, seen["tokens"].ids, seen["tokens"].n_tokens):
        want = library.encode(text, add_special_tokens=False).ids
        assert n == len(want) and bytes(ids) == b"".join(x.to_bytes(4, "little") for x in want)


def test_tokens_are_decoded_again(spark):
    texts = [prose(1, 50), "日本語    x\x1cy don't", "", None]
    rows = corpus_pipeline.tokens(spark, documents(spark, [(k, t, "a") for k, t in enumerate(texts)]), SMALL).collect()
    got = {r["doc_id"]: r["decoded_sha256"] for r in rows}
    assert got == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in enumerate(texts)}


def test_stages_take_odd_rows_and_empty_tables(spark):
    """Rows without ids, texts or sources, empty and repeated ones, a very long one, and columns of clashing names."""
    rows = awkward()
    odd = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SMALL)
        more = [] if name != "tokens" else ["ids", "decoded_sha256", "n_tokens"]
        assert got.columns == [*odd.columns, *more], name
        kept = [(r["doc_id"], r["text"], r["source"]) for r in got.collect()]
        assert set(kept) <= set(rows), name
        assert name not in ("exact", "near") or sum(t is None or not t.split() for _, t, _ in kept) >= 1
        assert stage(spark, odd.limit(0), SMALL).count() == 0, name
    exact = [r["doc_id"] for r in corpus_pipeline.exact(spark, odd, SMALL).collect()]
    assert 9 not in exact and 5 in exact and exact.count(18) == 1 and exact.count(None) == 1 and sorted(exact, key=str).count(11) == 1
    assert len(corpus_pipeline.tokens(spark, odd, SMALL).collect()) == len(rows)
