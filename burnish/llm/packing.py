"""Best-fit packing of token sequences with a bounded number of open bins, and the pieces that it packs."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.llm.bpe import PATTERN, rank_encoder
from burnish.llm.common import keep, unused

#: Bins that stay open at once, and rows that a task looks at together, longest first. Looking further ahead than there are
#: open bins fills bins less well: the longest rows would close one another before any short row comes.
OPEN_BINS = 4_096
AHEAD = 4_096
#: Tasks whose open bins are brought together in one round.
FAN_IN = 8
#: Bytes of ids that are handed to Spark at once.
BATCH_BYTES = 4 << 20


class Packer:
    """Places lengths one after the other into bins of a fixed capacity.

    Open bins stand under their free space; bit f of ``free`` tells whether there is one with f places left, so the
    tightest bin that a length fits is the lowest bit from that length on. When a bin has to be opened and too many are
    open, the fullest one closes.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS, first: int = 0) -> None:
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.free, self.open = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, room: int) -> int:
        bins = self.bins[room]
        number = bins.pop()
        if not bins:
            self.free ^= 1 << room
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of one length, which must be from 1 to the capacity."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
            number, room = self.next, self.capacity
            self.next += 1
        left = room - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - room

    def still_open(self) -> list[tuple[int, int]]:
        """(bin, tokens in it) of the bins that have room, the fullest first."""
        return [(number, self.capacity - room) for room, bins in enumerate(self.bins) for number in bins]


class Ids:
    """Token ids of whole texts under a vocabulary file of byte-level BPE whose ids stand in the order of its merges.

    Texts go through the merge-rank encoder; what its splitter can't hold (very long stretches of white space) goes
    through the library that the file was made for. A file of another kind goes through that library altogether.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            self.ranked = rank_encoder(json.load(file), PATTERN)

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is not None:
            try:
                return np.asarray(self.ranked.encode_to_numpy(text, allowed_special="all"), "<u4")
            except ValueError:
                pass
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    return Ids(path)


PIECE = [
    ("doc_id", "long", pa.int64()), ("piece", "int", pa.int32()), ("start", "long", pa.int64()),
    ("length", "long", pa.int64()), ("ids_crc32", "long", pa.int64()), ("ids", "binary", pa.binary()),
]


def token_pieces(
    df: DataFrame,
    path: str,
    capacity: int,
    end_id: int | None = None,
    with_ids: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Every document's token ids, cut into pieces of at most ``capacity``.

    Rows (doc_id, piece, start, length, ids_crc32, ids): ``start`` ids of the document stand before the piece, and
    ``ids`` are little-endian unsigned 32-bit numbers. Only documents that are longer than the capacity are cut; all their
    pieces are full except the first. A missing text counts as empty. A document without ids, which there is only without
    an end id, has no piece. Repeated rows and rows without an id give their pieces each. Other columns are not looked at.
    """
    fields = PIECE if with_ids else PIECE[:-1]
    schema = pa.schema([(n, t) for n, _, t in fields])
    end = np.array([] if end_id is None else [end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size = ids_of(path).encode, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) else []
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    data = ids[a:b].tobytes()
                    held.append((doc.as_py(), piece, a, b - a, zlib.crc32(data), data)[: len(fields)])
                    size += 64 + (len(data) if with_ids else 0)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    rows = df.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return rows.mapInArrow(cut, ", ".join(f"{n} {t}" for n, t, _ in fields))


#: A task's bins are numbered from its own number times this on.
TASK = 1 << 40


def pack_best_fit(
    df: DataFrame, capacity: int, length_column: str = "length", open_bins: int = OPEN_BINS, ahead: int = AHEAD
) -> DataFrame:
    """Place rows, each with a length, into sequences of at most ``capacity``.

    Adds ``sequence_id`` (any numbers) and ``offset``: the place of the row in its sequence, gapless from 0. Every task
    packs its own rows as they come, ``ahead`` of them at a time with the longest first, into at most ``open_bins`` open
    bins; the fullest closes when there would be more. What is open when a task ends is packed once more, as one row of
    that length, together with the open bins of ``FAN_IN`` - 1 other tasks, and so on until one group is left: memory is
    bounded by the constants, and no task reads more rows as the table grows.

    Rows of length 0 get the offset 0 of a sequence of their own, as does each row without a length (its offset is
    missing too); a length below 0 or above the capacity is an error. An empty table gives an empty one. Columns of the
    same names are replaced; others stay as they are, and repeated rows are placed each.
    """
    spark, room = df.sparkSession, unused(df, "room")
    df = df.drop("sequence_id", "offset")
    at = df.columns.index(length_column)
    fields = [*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields]]
    fields += [T.StructField(n, T.LongType(), True) for n in ("sequence_id", "offset", room)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, open_bins, TaskContext.get().partitionId() * TASK)
        columns = None
        for batch in batches:
            for low in range(0, len(batch), ahead):
                part = batch.slice(low, ahead)
                columns = part.schema
                lengths = part.column(at).to_pylist()
                bins, offsets = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
                for k in sorted(range(len(part)), key=lambda k: -(lengths[k] or 0)):
                    if lengths[k]:
                        if not 0 < lengths[k] <= capacity:
                            raise ValueError(f"a length of {lengths[k]} does not fit {capacity}")
                        bins[k], offsets[k] = packer.place(lengths[k])
                    else:
                        bins[k], offsets[k] = packer.next, 0
                        packer.next += 1
                missing = np.array([x is None for x in lengths], bool)
                added = [pa.array(bins), pa.array(offsets, mask=missing), pa.nulls(len(part), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*columns.names, "sequence_id", "offset", room])
        still = packer.still_open()
        if still:
            bins, filled = (pa.array(x, pa.int64()) for x in zip(*still))
            blank = [pa.nulls(len(still), t) for t in columns.types]
            yield pa.RecordBatch.from_arrays([*blank, bins, pa.nulls(len(still), pa.int64()), filled], names=[*columns.names, "sequence_id", "offset", room])

    packed = keep(df.mapInArrow(pack, T.StructType(fields)), "packed")
    rows = packed.where(F.col(room).isNull()).drop(room)
    bins = packed.where(F.col(room).isNotNull()).select(F.col("sequence_id").alias("bin"), F.col(room).alias("filled"))
    moved = _joined(bins, capacity, open_bins)
    if moved is None:
        return rows
    bin_, to, base = (unused(rows, n) for n in ("bin", "to", "base"))
    moved = moved.select(F.col("bin").alias(bin_), F.col("to").alias(to), F.col("base").alias(base))
    return rows.join(moved, F.col("sequence_id") == F.col(bin_), "left").select(
        *[F.col(n) for n in df.columns],
        F.coalesce(to, "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce(base, F.lit(0))).alias("offset"),
    )


JOINED = "bin long, to long, base long, filled long, still boolean"


def _joined(bins: DataFrame, capacity: int, open_bins: int) -> DataFrame | None:
    """(bin, to, base): where the contents of each bin go, for the bins that tasks left open; None if no task did.

    A round packs the open bins of ``FAN_IN`` groups as rows of that length. A bin that takes others in keeps its number.
    """
    group = F.floor(F.col("bin") / TASK)
    now = bins.select("bin", F.col("bin").alias("to"), F.lit(0).cast("long").alias("base"), "filled", F.lit(True).alias("still"))
    now = now.withColumn("grp", group)
    last = now.agg(F.max("grp")).first()[0]
    if last is None:
        return None
    done, tops = None, now.select("bin", "filled", "grp")
    while last > 0:
        last //= FAN_IN
        tops = tops.withColumn("grp", F.floor(F.col("grp") / FAN_IN))
        packed = keep(tops.groupBy("grp").applyInArrow(_packs(capacity, open_bins), f"grp long, {JOINED}"), "joined")
        step = packed.select("bin", "to", "base")
        done = step if done is None else _followed(done, step)
        tops = packed.where("still").select("bin", "filled", "grp")
    return done


def _followed(done: DataFrame, step: DataFrame) -> DataFrame:
    """Where bins stand after one more round: a bin that moved goes on with the bin that it is in."""
    step = step.select(F.col("bin").alias("to"), F.col("to").alias("on"), F.col("base").alias("by"))
    on = done.join(step, "to", "left")
    return keep(on.select("bin", F.coalesce("on", "to").alias("to"), (F.col("base") + F.coalesce("by", F.lit(0))).alias("base")), "joined")


def _packs(capacity: int, open_bins: int):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        bins, filled = rows.column("bin").to_numpy(), rows.column("filled").to_numpy()
        order = np.lexsort((bins, -filled))
        packer, taken_by, out = Packer(capacity, open_bins), {}, []
        for k in order.tolist():
            number, offset = packer.place(int(filled[k]))
            to = taken_by.setdefault(number, int(bins[k]))
            out.append([int(bins[k]), to, offset, None, False])
        left = {taken_by[number]: full for number, full in packer.still_open()}
        for row in out:
            if row[0] in left:
                row[3], row[4] = left[row[0]], True
        grp = pa.array([key[0].as_py()] * len(out), pa.int64())
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        return pa.table([grp, *columns], names=["grp", "bin", "to", "base", "filled", "still"])

    return pack
