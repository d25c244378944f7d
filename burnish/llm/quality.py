"""A quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import alone, keep

#: Buckets that words are hashed to, numbers in a word vector, and the places of a bucket's index vector that are not
#: zero. These bound the model: it has BUCKETS * DIMENSIONS numbers whatever the size of the corpus.
BUCKETS = 16_384
DIMENSIONS = 48
FILLED = 4
#: A word's neighbours: this many on either side.
REACH = 2
#: Labelled documents that the network is fitted on at most, drawn by hash.
LABELLED = 12_000
HIDDEN = 32
SEED = 20_240_817

#: Runs of letters, of digits, or of other marks.
TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Tokens that go through the vectorised counting at once, and words whose bucket a worker remembers.
TOGETHER = 500_000
REMEMBERED = 400_000

_known: dict[str, int] = {}


def buckets(text: str) -> np.ndarray:
    tokens = TOKENS.findall(text)
    if len(_known) > REMEMBERED:
        _known.clear()
    for token in set(tokens):
        if token not in _known:
            _known[token] = zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS
    return np.fromiter(map(_known.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its index vector that are filled, and whether with 1 or -1."""
    random = np.random.default_rng(SEED)
    places = np.argsort(random.random((BUCKETS, DIMENSIONS)), axis=1)[:, :FILLED]
    return places, random.choice([-1, 1], (BUCKETS, FILLED))


def add_contexts(sums: np.ndarray, words: np.ndarray, document: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to each word's sum the index vectors of its neighbours in the same document."""
    for step in range(1, REACH + 1):
        same = document[step:] == document[:-step]
        left, right = words[:-step][same], words[step:][same]
        for word, near in ((left, right), (right, left)):
            for k in range(FILLED):
                at = word * DIMENSIONS + places[near, k]
                sums += np.bincount(at, signs[near, k], BUCKETS * DIMENSIONS)


CONTEXTS = "bucket int, seen long, context array<long>"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    sums, seen = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            words = np.concatenate(held)
            document = np.repeat(np.arange(len(held)), [len(h) for h in held])
            add_contexts(sums, words, document, places, signs)
            np.add(seen, np.bincount(words, minlength=BUCKETS), out=seen)
        held, size = [], 0

    alone("quality", _known.clear)
    for batch in batches:
        for cell in batch.column(0):
            words = buckets(cell.as_py() or "")
            held.append(words)
            size += len(words)
            if size > TOGETHER:
                flush()
    flush()
    used = np.flatnonzero(seen)
    rows = sums.reshape(BUCKETS, DIMENSIONS)[used].astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(used.astype(np.int32)),
            pa.array(seen[used]),
            pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * DIMENSIONS), pa.array(rows.ravel())),
        ],
        names=["bucket", "seen", "context"],
    )


def word_vectors(df: DataFrame, text_column: str = "text") -> np.ndarray:
    """The vector of each bucket, learned from all texts: its index vector, and the sum of its neighbours' index
    vectors brought to length 1. Every task sums its own texts; the sums of all tasks are added by a grouping."""
    parts = df.select(text_column).mapInArrow(_contexts, CONTEXTS)
    sums = [F.sum(F.col("context")[k]).alias(f"d{k}") for k in range(DIMENSIONS)]
    # BUCKETS rows at most.
    table = parts.groupBy("bucket").agg(*sums).toPandas()
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMENSIONS))
    np.put_along_axis(own, places, signs, axis=1)
    context = np.zeros((BUCKETS, DIMENSIONS))
    if len(table):
        context[table["bucket"].to_numpy(np.int64)] = table[[f"d{k}" for k in range(DIMENSIONS)]].to_numpy(float)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    context = np.divide(context, length, out=context, where=length > 0)
    return np.hstack([own / np.sqrt(FILLED), context]).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """One document: the mean vector of its words, that of its distinct words, its length and its share of distinct
    words. All are zero for a text without words."""
    words = buckets(text)
    if not len(words):
        return np.zeros(2 * vectors.shape[1] + 2, np.float32)
    different, counts = np.unique(words, return_counts=True)
    rows = vectors[different]
    mean, plain = counts @ rows / len(words), rows.mean(axis=0)
    return np.concatenate([mean, plain, [np.log1p(len(words)), len(different) / len(words)]]).astype(np.float32)


@dataclass
class Network:
    """Two layers on standardised inputs; the logit is divided by a temperature before it becomes a probability."""

    middle: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.middle) / self.spread @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 2e-3) -> Network:
    """Fit by Adam on four fifths of the rows; the rest decides the epoch to keep and the temperature.

    With rows of one label only, or none, every score is that label's share, or one half.
    """
    random = np.random.default_rng(SEED)
    width = x.shape[1]
    spread = x.std(axis=0) + 1e-6 if len(x) else np.ones(width)
    middle = x.mean(axis=0) if len(x) else np.zeros(width)
    net = Network(middle, spread, np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(set(y.tolist())) < 2:
        net.b2 = float(np.clip((y.mean() - 0.5) * 100, -50, 50)) if len(y) else 0.0
        return net
    order = random.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, used = order[:cut], order[cut:]
    net.w1 = random.normal(0, np.sqrt(2 / width), (width, HIDDEN))
    net.w2 = random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    parts = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    scaled = (x - middle) / spread
    best, kept, step = np.inf, None, 0
    for _ in range(epochs):
        for at in np.array_split(random.permutation(used), max(1, len(used) // batch)):
            rows, want = scaled[at], y[at]
            hidden = np.maximum(rows @ parts[0] + parts[1], 0)
            slope = (1 / (1 + np.exp(-np.clip(hidden @ parts[2] + parts[3], -50, 50))) - want) / len(at)
            back = np.outer(slope, parts[2]) * (hidden > 0)
            slopes = [rows.T @ back + 1e-4 * parts[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * parts[2], [slope.sum()]]
            step += 1
            for p, g, m, v in zip(parts, slopes, first, second):
                m += 0.1 * (np.asarray(g) - m)
                v += 0.001 * (np.asarray(g) ** 2 - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
        loss = log_loss(net.logits(x[held]), y[held])
        if loss < best:
            best, kept = loss, [p.copy() for p in parts]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    logits = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.2, 10, 200), key=lambda t: log_loss(logits / t, y[held])))
    return net


def is_held_out(doc_id):
    """Whether a document is kept from the fit: the checksum of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fitted_score(
    df: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    label_id_column: str = "doc_id",
) -> Column:
    """The score of each row of ``df``, 0 to 1, as a column; see ``score_quality``."""
    spark = df.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(df, text_column))
    marks = labels.select(F.col(label_id_column).alias("id"), F.col(label_column).cast("double").alias("label"))
    marks = marks.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    marks = marks.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    # At most LABELLED ids and labels.
    marks = keep(marks.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(LABELLED), "labels")
    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    drawn = texts.join(F.broadcast(marks), "id").select("id", "label", "text")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("quality", _known.clear)
        for batch in batches:
            rows = [pooled(x.as_py() or "", vectors.value).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "label", "x"]
            )

    kind = dict(drawn.dtypes)["id"]
    # A repeated id is fitted on once.
    fitted = drawn.mapInArrow(pool, f"id {kind}, label int, x binary").toPandas()
    fitted = fitted.drop_duplicates("id").sort_values("id", ignore_index=True)
    width = 2 * 2 * DIMENSIONS + 2
    x = np.frombuffer(b"".join(fitted["x"]), np.float32).reshape(-1, width).astype(np.float64)
    network = spark.sparkContext.broadcast(fit_network(x, fitted["label"].to_numpy(float)))

    @F.arrow_udf("double")
    def score(cells: pa.Array) -> pa.Array:
        alone("quality", _known.clear)
        out = []
        for at in range(0, len(cells), 1_000):
            rows = [pooled(x.as_py() or "", vectors.value) for x in cells.slice(at, 1_000)]
            out += network.value.score(np.array(rows, np.float64)).tolist()
        return pa.array(out, pa.float64())

    return score(F.col(text_column).cast("string"))


def score_quality(
    df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """Score every row: the columns of ``df`` and ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    Word vectors come from all texts. The network is fitted on at most LABELLED documents with a label, drawn by the
    hash of their id from those that are not held out; nothing but the text enters a score. A document with several
    labels takes the more frequent one, 1 on a tie; a missing label is none. A missing text is empty, and empty texts
    get a score too. Without labels every score is one half. Repeated rows get equal scores. An empty table gives an
    empty result. Columns of ``df`` named like the new ones are replaced.
    """
    score = fitted_score(df, labels, id_column, text_column, **options)
    scored = df.withColumns({"held_out": is_held_out(F.col(id_column)), "score": score})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` whose score is at least one half, with their columns. See ``score_quality``."""
    return df.where(fitted_score(df, labels, **options) >= 0.5)
