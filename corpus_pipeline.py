"""From raw documents to token ids: the corpus operators, one after the other.

Each stage takes the session, the rows that the stage before it kept, and the folder of the tables, and returns rows that
are written as Parquet before the next stage reads them. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.bpe import decode_documents, encode_documents
from burnish.llm.common import keep, read
from burnish.llm.exact import exact_dedup
from burnish.llm.jaccard import near_dedup
from burnish.llm.mixing import mixed_documents
from burnish.llm.quality import keep_good

#: No SQL expresses a trained classifier; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, fitted on the labels, rejects.

    A missing text is scored as an empty one; repeated rows have one score. Rows keep their columns, whatever these are; an
    empty table gives an empty one.
    """
    return keep_good(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, keep the one with the smallest id.

    Missing and empty texts are equal. A row without an id stays only where no equal one has an id; of repeated rows one
    stays. An empty table gives an empty one.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles with a similarity of 0.8 or more, keep the one with the smallest id.

    Texts shorter than five words are one shingle each; those without words are linked with nothing and stay. A row
    without an id stays only where no row that it is linked with has one. An empty table gives an empty one.
    """
    return near_dedup(docs, width=5, share=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that sources have their target weights.

    Rows without a source are one source, the last one. Rows without words have nothing to repeat and stay once. An
    empty table gives an empty one.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the token ids, little-endian unsigned 32-bit numbers in one cell, their number, and the digest of the text
    that they decode to. A missing or empty text has no ids and decodes to the empty text; repeated rows are encoded each."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = decode_documents(encode_documents(docs, path), path, text_column="decoded_sha256")
    return decoded.withColumns(
        {
            "n_tokens": F.floor(F.octet_length("ids") / 4).cast("long"),
            "decoded_sha256": F.sha2("decoded_sha256", 256),
        }
    )


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
