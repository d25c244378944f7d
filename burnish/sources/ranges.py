"""Records that may span lines, found in byte ranges: a file is read by many tasks, and none of them reads all of it.

Spark's text source cuts a file into byte ranges at a separator character, which need not end a record: it may stand in
quotes or inside a nested object. What it means depends on what comes before the range. So a first pass finds, for each
range, how it would end if it began outside of quotes and how if inside; composing these from the start of a file on tells
how each range really begins. With that, every range cuts its own whole records, and a record that crosses ranges is put
together from its fragments.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.session import cut

QUOTE = 34
OPEN, CLOSE = 123, 125
ESCAPED = re.compile(rb"\\.", re.DOTALL)
MARK = b"\xef\xbb\xbf"  # the byte order mark that some files begin with
BLANKS = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
RETURN = 13
BETWEEN = b" \t\r\n,[]" + MARK  # what stands between the objects of a list


@dataclass
class State:
    """What a place in a file is inside of: quotes, and so many open objects."""

    quoted: bool = False
    depth: int = 0

    @property
    def open(self) -> bool:
        return self.quoted or self.depth > 0


@dataclass
class Ends:
    """How a stretch ends, by how it begins: outside of quotes or inside."""

    quoted: tuple[bool, bool] = (False, True)
    depth: tuple[int, int] = (0, 0)

    def then(self, other: Ends) -> Ends:
        return Ends(
            (other.quoted[self.quoted[0]], other.quoted[self.quoted[1]]),
            (self.depth[0] + other.depth[self.quoted[0]], self.depth[1] + other.depth[self.quoted[1]]),
        )


class JsonObjects:
    """The outermost objects of a JSON document. Every record ends with a closing brace, which is the separator."""

    separator, sized = "}", True

    def ends(self, pieces: pa.Array) -> Ends:
        text = b"}".join(pieces.to_pylist()) + b"}"
        if b"\\" in text:
            text = ESCAPED.sub(b"", text)
        parts = text.split(b'"')
        depths = []
        for first in (0, 1):
            plain = b"".join(parts[first::2])
            depths.append(plain.count(b"{") - plain.count(b"}"))
        odd = len(parts) % 2 == 0
        return Ends((odd, not odd), tuple(depths))

    def cut(self, text: bytes, state: State) -> tuple[list[tuple[int, int]], State]:
        """Where records lie in ``text``, which begins in ``state``; a record that began before starts at 0, one
        that goes on ends after the text. Elements that are no objects count as records, so that nothing is lost."""
        plain = ESCAPED.sub(b"__", text) if b"\\" in text else text
        codes = np.frombuffer(plain, np.uint8)
        at = np.flatnonzero((codes == QUOTE) | (codes == OPEN) | (codes == CLOSE))
        kind = codes[at]
        quote = kind == QUOTE
        inside = (np.cumsum(quote) - quote + state.quoted) % 2 == 1
        brace = ~quote & ~inside
        at, step = at[brace], np.where(kind[brace] == OPEN, 1, -1)
        level = state.depth + np.cumsum(step)
        if len(level) and level.min() < 0:
            raise ValueError("a closing brace without an opening one")
        starts = at[(step > 0) & (level == 1)].tolist()
        stops = (at[(step < 0) & (level == 0)] + 1).tolist()
        if state.open:
            starts.insert(0, 0)
        end = State(bool((state.quoted + int(quote.sum())) % 2), int(level[-1]) if len(level) else state.depth)
        if end.open:
            stops.append(len(text) + 1)
        spans = []
        for low, high in pairwise([0, *(x for span in zip(starts, stops) for x in span), len(text)]):
            record = len(spans) % 2 == 1
            spans.append((low, high) if record or text[low:high].strip(BETWEEN) else None)
        return [span for span in spans if span], end

    def value(self, record: bytes) -> bytes:
        return record.strip(BETWEEN)


class DelimitedLines:
    """Lines of delimited text. A quote opens a cell at its start only, doubled quotes stay inside, and a line break
    inside quotes belongs to the cell."""

    separator, sized = "\n", False

    def __init__(self, sep: str) -> None:
        self.sep = sep.encode()

    def _line(self, line: bytes, quoted: bool) -> bool:
        """Whether the line ends inside quotes."""
        if len(self.sep) > 1:
            return self._line_by_cells(line, quoted)
        # Of quotes in a row only their parity counts: at the start of a cell two of them are an empty cell, and inside
        # quotes they stand for one that does not close.
        line, opening, at = line.replace(b'""', b""), self.sep + b'"', 0
        if not quoted and line.startswith(b'"'):
            quoted, at = True, 1
        while True:
            if quoted:
                at = line.find(b'"', at) + 1
                if not at:
                    return True
            at = line.find(opening, at)
            if at < 0:
                return False
            quoted, at = True, at + 2

    def _line_by_cells(self, line: bytes, quoted: bool) -> bool:
        at, size, sep = 0, len(line), self.sep
        while True:
            if not quoted and line.startswith(b'"', at):
                quoted, at = True, at + 1
            if quoted:
                close = line.find(b'"', at)
                while close >= 0 and line.startswith(b'"', close + 1):
                    close = line.find(b'"', close + 2)
                if close < 0:
                    return True
                quoted, at = False, close + 1
            at = line.find(sep, at)
            if at < 0 or at >= size:
                return False
            at += len(sep)

    def _quoted(self, lines: pa.Array) -> Iterator[tuple[int, bytes]]:
        """The lines that hold quotes, with their places; only these can change what a line is inside of."""
        codes, offsets = buffers(lines)
        at = np.searchsorted(offsets, np.flatnonzero(codes == QUOTE), "right") - 1
        at = at[np.diff(at, prepend=-1) != 0]
        for k, low, high in zip(at.tolist(), offsets[at].tolist(), offsets[at + 1].tolist()):
            yield k, codes[low:high].tobytes()

    def ends(self, pieces: pa.Array) -> Ends:
        outside, inside = False, True
        for _, line in self._quoted(pieces):
            same = outside == inside
            outside = self._line(line, outside)
            inside = outside if same else self._line(line, inside)
        return Ends((outside, inside))

    def stops(self, lines: pa.Array, quoted: bool) -> tuple[np.ndarray, bool]:
        """After which lines a record ends, counted from 1, and whether the last line ends inside quotes."""
        at, states = [0], [quoted]
        for k, line in self._quoted(lines):
            at.append(k)
            states.append(self._line(line, states[-1]))
        inside = np.repeat(np.array(states), np.diff([*at, len(lines)]))
        return np.flatnonzero(~inside) + 1, states[-1]

    def value(self, record: bytes) -> bytes:
        return record.removesuffix(b"\n").removesuffix(b"\r")


def buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and where each begins, with the end of the last."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    codes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return codes[offsets[0] : offsets[-1]], offsets - offsets[0]


Kind = JsonObjects | DelimitedLines


def pieces(spark: SparkSession, paths: str | list[str], kind: Kind, names: str = "*") -> DataFrame:
    """(file, block, size, value): a file's text between separators, with the byte its range starts from.

    Lines may be short and very many: functions of the file being read cost less for each than its metadata does. The
    size is only given where it matters whether the last separator is there.
    """
    reader = spark.read.options(lineSep=kind.separator, recursiveFileLookup=True, pathGlobFilter=names)
    raw = reader.text(paths)
    return raw.select(
        F.xxhash64(F.input_file_name()).alias("file"),
        F.expr("input_file_block_start()").alias("block"),
        (F.col("_metadata.file_size") if kind.sized else F.lit(None).cast("long")).alias("size"),
        F.col("value").cast("binary").alias("value"),
    )


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Parts of batches that lie in one range, and whether the range begins with the part."""
    last = None
    for batch in batches:
        file, block = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("file", "block"))
        edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        for a, b in pairwise([0, *edges.tolist(), len(batch)]):
            if a < b:
                here = file[a], block[a]
                yield here != last, batch.slice(a, b - a)
                last = here


def leading(rows: DataFrame, n: int) -> DataFrame:
    """(file, line, value): of rows (file, block, value) the first ``n`` of each file, from 1. A task meets the rows of a
    range in their order, so none are sorted or held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = 0
        for begins, part in by_block(batches):
            line = 0 if begins else line
            part = part.slice(0, n - line)
            if len(part):
                lines = pa.array(range(line + 1, line + 1 + len(part)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("file"), lines, part.column("value")], names=["file", "line", "value"])
                line += len(part)

    return rows.where("block = 0").select("file", "block", "value").mapInArrow(run, "file long, line int, value string")


def first_lines(raw: DataFrame, n: int) -> DataFrame:
    """(file, line, value): the first lines of each file of a text source, whose paths stand as hashes."""
    at = F.expr("input_file_block_start()").alias("block")
    return leading(raw.select(F.xxhash64(F.input_file_name()).alias("file"), at, "value"), n)


SUMMARY = pa.schema([
    ("file", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("quoted0", pa.bool_()),
    ("quoted1", pa.bool_()), ("depth0", pa.int64()), ("depth1", pa.int64()),
])
SUMMARY_DDL = "file long, block long, size long, bytes long, quoted0 boolean, quoted1 boolean, depth0 long, depth1 long"


def summarise(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each range: both outcomes, and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ends = None, Ends()

        def done() -> pa.RecordBatch:
            values = {"quoted0": ends.quoted[0], "quoted1": ends.quoted[1], "depth0": ends.depth[0], "depth1": ends.depth[1]}
            return pa.RecordBatch.from_pylist([row | values], SUMMARY)

        for begins, part in by_block(batches):
            if begins:
                if row:
                    yield done()
                row = {n: part.column(n)[0].as_py() for n in ("file", "block", "size")} | {"bytes": 0}
                ends = Ends()
            values = part.column("value")
            row["bytes"] += (pc.sum(pc.binary_length(values)).as_py() or 0) + len(values)
            ends = ends.then(kind.ends(values))
        if row:
            yield done()

    return run


STARTS = "file long, block long, quoted boolean, depth long, last boolean, unended boolean, left_open boolean"


def compose(rows: pa.Table) -> pa.Table:
    """How each range of one file begins: the outcomes of those before it, composed."""
    rows = rows.sort_by("block").to_pylist()
    out, now = [], Ends()
    for row in rows:
        out.append({"file": row["file"], "block": row["block"], "quoted": now.quoted[0], "depth": now.depth[0]})
        now = now.then(Ends((row["quoted0"], row["quoted1"]), (row["depth0"], row["depth1"])))
    # A file that does not end with a separator counts one more byte than it has.
    unended = rows[0]["size"] is not None and sum(row["bytes"] for row in rows) > rows[0]["size"]
    for k, row in enumerate(out):
        row |= {"last": k == len(out) - 1, "unended": unended, "left_open": now.quoted[0]}
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    return pa.Table.from_pylist(out, pa.schema([(n, kinds[t]) for n, t in (x.split() for x in STARTS.split(", "))]))


RECORD = "file long, block long, part int, opens boolean, first boolean, value binary"
RECORD_ARROW = pa.schema([
    ("file", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("opens", pa.bool_()), ("first", pa.bool_()), ("value", pa.binary())
])


def batch_of(rows: list[tuple]) -> list[pa.RecordBatch]:
    if not rows:
        return []
    return [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), RECORD_ARROW.types)], schema=RECORD_ARROW)]


class Cutter:
    """Cuts one range after the other. Yields whole records, part 2, or fragments of those that cross ranges, or both.

    A range has two fragments at most: the end of a record that began before, and the start of one that goes on.
    """

    def __init__(self, kind: Kind, fragments: bool | None) -> None:
        self.kind, self.whole, self.fragments = kind, fragments is not True, fragments is not False
        self.row: dict | None = None

    def begin(self, row: dict) -> None:
        self.row, self.state = row, State(row["quoted"], row["depth"])
        self.begun_before, self.held, self.last, self.seen = self.state.open, [], None, 0

    def _row(self, value: bytes, part: int) -> tuple:
        first = self.row["block"] == 0 and self.seen == 0
        return (self.row["file"], self.row["block"], part, part == 1, first, value.removeprefix(MARK) if first else value)


class ObjectCutter(Cutter):
    def add(self, values: pa.Array) -> list[pa.RecordBatch]:
        """The last piece waits, as the end of a file need not be a separator."""
        pieces = values.to_pylist()
        if self.last is not None:
            pieces = [self.last, *pieces]
        self.last = pieces.pop()
        return batch_of(self._cut(b"}".join(pieces) + b"}")) if pieces else []

    def finish(self) -> list[pa.RecordBatch]:
        if self.row is None:
            return []
        ended = not (self.row["last"] and self.row["unended"])
        out = self._cut(self.last + b"}" if ended else self.last)
        if self.held and self.fragments:
            out.append(self._row(b"".join(self.held), 0 if self.begun_before else 1))
        self.row = None
        return batch_of(out)

    def _cut(self, text: bytes) -> list[tuple]:
        out = []
        spans, self.state = self.kind.cut(text, self.state)
        for a, b in spans:
            self.held.append(text[a:b])
            if b > len(text):
                continue
            value = b"".join(self.held)
            self.held = []
            if self.begun_before:
                if self.fragments:
                    out.append(self._row(value, 0))
                self.begun_before = False
            elif value.strip():
                if self.whole:
                    out.append(self._row(self.kind.value(value), 2))
                self.seen += 1
        return out


class LineCutter(Cutter):
    """Most lines hold no quotes, so records are put together from lines by Arrow, many at a time."""

    def add(self, values: pa.Array) -> list[pa.RecordBatch]:
        lines = values.cast(pa.binary())
        stops, quoted = self.kind.stops(lines, self.state.quoted)
        self.state = State(quoted)
        if not len(stops):
            self.held.append(_joined(lines))
            return []
        out, low, high = [], 0, int(stops[-1])
        if self.held or self.begun_before:
            low, stops = int(stops[0]), stops[1:]
            value = b"\n".join([*self.held, _joined(lines[:low])])
            self.held = []
            if self.begun_before:
                if self.fragments:
                    out += batch_of([self._row(value + b"\n", 0)])
                self.begun_before = False
            else:
                out += self._records(pa.array([value], pa.binary()))
        if len(stops):
            # Records of the lines between one stop and the next.
            parts = pa.ListArray.from_arrays(pa.array(np.append(low, stops), pa.int32()), lines)
            out += self._records(pc.binary_join(parts, pa.scalar(b"\n", pa.binary())))
        if high < len(lines):
            self.held.append(_joined(lines[high:]))
        return out

    def finish(self) -> list[pa.RecordBatch]:
        if self.row is None:
            return []
        out = []
        if self.held and self.fragments:
            out = batch_of([self._row(b"\n".join(self.held) + b"\n", 0 if self.begun_before else 1)])
        self.row = None
        return out

    def _records(self, values: pa.Array) -> list[pa.RecordBatch]:
        """Whole records, without blank ones and without a carriage return at the end."""
        codes, offsets = buffers(values)
        filled = offsets[1:] > offsets[:-1]
        keep = filled.copy()
        for k in np.flatnonzero(filled)[np.isin(codes[offsets[:-1][filled]], BLANKS)].tolist():
            keep[k] = bool(values[k].as_py().strip())
        ends = offsets[1:][keep]
        if not keep.all():
            values = values.filter(pa.array(keep))
        if (codes[ends - 1] == RETURN).any():
            values = pa.array([x.removesuffix(b"\r") for x in values.to_pylist()], pa.binary())
        if not len(values):
            return []
        out = []
        if self.row["block"] == 0 and self.seen == 0:
            if self.whole:
                out += batch_of([self._row(values[0].as_py(), 2)])
            self.seen, values = 1, values[1:]
        self.seen += len(values)
        if not self.whole or not len(values):
            return out
        same = [pa.repeat(pa.scalar(x, t), len(values)) for x, t in zip(self._row(b"", 2)[:-1], RECORD_ARROW.types)]
        return [*out, pa.RecordBatch.from_arrays([*same, values], schema=RECORD_ARROW)]


def _joined(lines: pa.Array) -> bytes:
    return b"\n".join(lines.to_pylist())


def cutting(
    kind: Kind, fragments: bool | None = None, starts: Broadcast | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts ranges into whole records or, with ``fragments``, into fragments of those that cross ranges; by default, both.

    How ranges begin is looked up in ``starts``, or stands in columns beside the values.
    """

    def start(part: pa.RecordBatch) -> dict:
        if starts is None:
            return {n: part.column(n)[0].as_py() for n in ("file", "block", "quoted", "depth", "last", "unended")}
        table, file, block = starts.value, part.column("file")[0].as_py(), part.column("block")[0].as_py()
        at = np.flatnonzero((table["file"].to_numpy() == file) & (table["block"].to_numpy() == block))
        if not len(at):
            raise RuntimeError("a file was cut into other ranges than before; read it again")
        return table.slice(int(at[0]), 1).to_pylist()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = (LineCutter if isinstance(kind, DelimitedLines) else ObjectCutter)(kind, fragments)
        for begins, part in by_block(batches):
            if begins:
                yield from cutter.finish()
                cutter.begin(start(part))
            yield from cutter.add(part.column("value"))
        yield from cutter.finish()

    return run


@dataclass
class Ranges:
    """The ranges of some files, scanned once, and how each begins."""

    pieces: DataFrame
    starts: DataFrame
    kind: Kind

    def records(self) -> DataFrame:
        """(file, first, value): every record as a text, in no order; ``first`` marks the first one of its file.

        Records are cut once and written, as most readers pass over them twice: to find types, and for the rows.
        The starts, one short row for each range of a file, are sent to every task: 100 TB in ranges of 128 MB have
        some 800,000, about 30 MB.
        """
        starts = self.starts.sparkSession.sparkContext.broadcast(self.starts.toArrow())
        found = self.pieces.drop("size").mapInArrow(cutting(self.kind, starts=starts), RECORD)
        found = cut(found.withColumn("value", F.col("value").cast("string")))
        whole = found.where("part = 2").select("file", "first", "value")
        # A record is its opening fragment and those up to the next one; there are two fragments a range at most.
        numbered = found.where("part < 2").selectExpr(
            "*", "sum(int(opens)) over (partition by file order by block, part rows between unbounded preceding and current row) as number"
        )
        joined = numbered.groupBy("file", "number").agg(
            F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "part", "value"))).alias("parts")
        )
        value = F.array_join(F.transform("parts", lambda x: x["value"]), "")
        if self.kind.separator == "\n":
            value = F.regexp_replace(value, r"\r?\n$", "")
        return whole.unionByName(joined.select("file", "first", value.alias("value")).where(F.trim("value") != ""))


def scan(spark: SparkSession, paths: str | list[str], kind: Kind, names: str = "*") -> Ranges:
    """The first pass, over the files whose names fit a pattern. Its result is one row for each range."""
    found = pieces(spark, paths, kind, names)
    summaries = found.mapInArrow(summarise(kind), SUMMARY_DDL)
    return Ranges(found, cut(summaries.groupBy("file").applyInArrow(compose, STARTS)), kind)
