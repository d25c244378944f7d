"""Text columns: counts, flags, cleaning, hashing and term weights."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.columns import c, flag
from burnish.functions.text import SHORTEST_TOKEN, cleaned, first_number, hash_bucket, piece_count, tokens, word_count
from burnish.operators.steps import Found, Note, Outcome, Step, run

METHODS = (
    "length_and_words", "count_delimiter", "tfidf", "countvec", "contains", "extract_numbers",
    "clean_and_keep", "hash", "drop",
)
TERMS, COUNTS = "__terms", "__counts"
SPREAD_ROWS = 2_000  # fewer rows are not worth a shuffle


def text_features(df: DataFrame, configs: Mapping[str, str], stop_words: Sequence[str] | None = None) -> Outcome:
    """Process text columns.

    Methods: length_and_words, count_delimiter:<separator>, tfidf:<n>, countvec:<n>, contains:<pattern>,
    extract_numbers, clean_and_keep, hash:<buckets>, drop. All but ``contains`` and ``clean_and_keep`` drop the
    source column. ``stop_words`` defaults to Spark's English list.
    """
    late: list[Note] = []
    steps, notes = text_steps(df, df.columns, configs, stop_words, late)
    out = run(df, steps)
    return Outcome(out, tuple([*notes, *late]))


def text_steps(
    df: DataFrame,
    names: Sequence[str],
    configs: Mapping[str, str],
    stop_words: Sequence[str] | None = None,
    late: list[Note] | None = None,
) -> tuple[list[Step], list[Note]]:
    late = late if late is not None else []
    steps, notes = [], []
    for name, method in configs.items():
        word, _, arg = method.partition(":")
        if word in ("keep", "none"):
            continue
        if word not in METHODS:
            raise ValueError(f"unknown text method for {name}: {method}")
        if name not in names:
            notes.append(Note("text", name, "skipped", "column not found"))
        elif word in ("tfidf", "countvec"):
            steps.append(_terms_step(name, word, int(arg), stop_words, late))
        else:
            steps.append(_step(name, word, arg))
            notes.append(Note("text", name, "dropped" if word == "drop" else "done", method))
    return steps, notes


def _step(name: str, word: str, arg: str) -> Step:
    one = frozenset({name})
    if word == "drop":
        return Step(drops=(name,))
    text = c(name).cast("string")
    columns: dict[str, Column] = {
        "length_and_words": lambda: {f"{name}_length": F.length(text), f"{name}_word_count": word_count(text)},
        "count_delimiter": lambda: {f"{name}_count": piece_count(text, arg)},
        "contains": lambda: {f"{name}_has_{arg}": flag(text.rlike(f"(?i){arg}"))},
        "extract_numbers": lambda: {f"{name}_number": first_number(text)},
        "clean_and_keep": lambda: {name: cleaned(text)},
        "hash": lambda: {f"{name}_hash": hash_bucket(text, int(arg))},
    }[word]()
    keeps = word in ("contains", "clean_and_keep")
    return Step(
        reads=one, writes=frozenset(columns), project=lambda df, found: columns, drops=() if keeps else (name,)
    )


def _terms_step(name: str, word: str, n: int, stop_words: Sequence[str] | None, late: list[Note]) -> Step:
    one = frozenset({name})

    def transform(df: DataFrame, found: Found) -> DataFrame:
        vocabulary = top_terms(df, name, n, stop_words)
        prefix = f"{name}_tfidf_" if word == "tfidf" else f"{name}_count_"
        late.append(Note("text", name, "done", ", ".join(prefix + t for t in vocabulary.terms[:5])))
        if not vocabulary.terms:
            return df.drop(name)
        weighted = with_weights(df, name, vocabulary, word == "tfidf")
        kept = [c(x) for x in df.columns if x != name]
        return weighted.select(*kept, *[F.col(COUNTS)[i].alias(prefix + t) for i, t in enumerate(vocabulary.terms)])

    return Step(fit_reads=one, reads=one, writes=one, transform=transform, opens_columns=True)


def stop_list(stop_words: Sequence[str] | None) -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else list(stop_words)


@dataclass(frozen=True)
class Vocabulary:
    """The chosen terms in term order, the rows that hold each, the rows of the table, and how to spread them."""

    terms: tuple[str, ...]
    rows_with: tuple[int, ...]
    rows: int
    spread_over: int | None = None

    def idf(self) -> list[float]:
        return [math.log((1 + self.rows) / (1 + n)) + 1 for n in self.rows_with]


def top_terms(df: DataFrame, name: str, n: int, stop_words: Sequence[str] | None = None) -> Vocabulary:
    """The n most frequent terms. One pass counts uses and rows per term, summed per task before the shuffle."""
    rows, spread_over = _layout(df)
    listed = _spread(df.select(c(name)), spread_over).select(tokens(c(name).cast("string")).alias("all"))
    twice = listed.select(F.posexplode(F.array("all", F.array_distinct("all"))).alias("once", "some"))
    words = twice.select("once", F.explode("some").alias("term"))
    words = words.where((F.length("term") >= SHORTEST_TOKEN) & ~F.col("term").isin(*stop_list(stop_words)))
    counted = words.groupBy("term").agg(
        F.count_if(F.col("once") == 0).alias("uses"), F.count_if(F.col("once") == 1).alias("rows")
    )
    found = sorted(counted.orderBy(F.desc("uses"), "term").limit(n).collect(), key=lambda r: r["term"])
    return Vocabulary(tuple(r["term"] for r in found), tuple(r["rows"] for r in found), rows, spread_over)


def _layout(df: DataFrame) -> tuple[int, int | None]:
    """Rows of the table, and over how many tasks to spread them if they lie in fewer than half as many as could run.

    Cutting text into words is bound by the processor. A source that cannot be split, such as one large compressed
    file, would leave most of the cluster idle; a source of many splits is left as it is.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    parts, rows = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return rows, cores if parts * 2 <= cores and rows >= SPREAD_ROWS else None


def _spread(df: DataFrame, over: int | None) -> DataFrame:
    return df.repartition(over) if over else df


def with_weights(df: DataFrame, name: str, vocabulary: Vocabulary, idf: bool) -> DataFrame:
    """Add the array of term weights per row. A row is weighted by itself, so nothing is shuffled and no id is needed.

    With ``idf``: count times ln((1 + N) / (1 + df)) + 1, scaled to unit length over the vocabulary.
    """
    counted = _count_terms(_spread(df, vocabulary.spread_over), name, vocabulary.terms)
    if not idf:
        return counted.withColumn(COUNTS, F.transform(COUNTS, lambda x: x.cast("long")))
    weighted = counted.withColumn(COUNTS, F.zip_with(COUNTS, F.lit(vocabulary.idf()), lambda x, w: x * w))
    length = F.sqrt(F.aggregate(COUNTS, F.lit(0.0), lambda total, x: total + x * x))
    weighted = weighted.withColumn("__length", length)
    scaled = F.transform(COUNTS, lambda x: F.when(F.col("__length") > 0, x / F.col("__length")).otherwise(0.0))
    return weighted.withColumn(COUNTS, scaled).drop("__length")


def _count_terms(df: DataFrame, name: str, vocabulary: Sequence[str]) -> DataFrame:
    """Add the array of counts per row. Stop words and single characters are not in the vocabulary."""
    listed = df.withColumn(TERMS, tokens(c(name).cast("string")))
    model = CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol=TERMS, outputCol="__vector")
    counted = model.transform(listed).withColumn(COUNTS, vector_to_array("__vector"))
    return counted.drop(TERMS, "__vector")


def term_weights(
    df: DataFrame, name: str, n: int, keep: Sequence[str], idf: bool = True, stop_words: Sequence[str] | None = None
) -> DataFrame:
    """Long form: the kept columns, term and weight, for the terms that a row has."""
    vocabulary = top_terms(df, name, n, stop_words)
    kept = [c(k) for k in keep]
    if not vocabulary.terms:
        return df.select(*kept, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    weighted = with_weights(df.select(*kept, c(name)), name, vocabulary, idf)
    pairs = F.arrays_zip(F.lit(list(vocabulary.terms)).alias("term"), F.col(COUNTS).alias("weight"))
    # A row has few of the terms: the others never become rows.
    pairs = F.filter(pairs, lambda x: x["weight"] > 0)
    return weighted.select(*kept, F.inline(pairs)).toDF(*keep, "term", "weight")
