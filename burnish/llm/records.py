"""Token ids in length-delimited binary records with checksums, and an index of offsets beside each file.

A record: the payload's length (8 bytes), the masked checksum of those 8 bytes (4), the payload, the masked checksum of
the payload (4). Numbers are little-endian. A payload: one byte that tells whether there is a document id, the id (8
bytes), and the token ids, 2 or 4 bytes each as the vocabulary needs. The index has 8 bytes for each record: where it
starts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnish.llm.bpe import byte_letters
from burnish.llm.common import fresh_path, keep

HEAD, TAIL, ID = "<QI", "<I", "<Bq"
HEAD_BYTES, TAIL_BYTES, ID_BYTES = (struct.calcsize(x) for x in (HEAD, TAIL, ID))
#: Bytes of records that are handed to Spark, or written, at once.
BATCH_BYTES = 4 << 20
#: Bytes of pieces, their ids and what holds them that a Python worker remembers before it starts afresh; it keeps the
#: pieces from before that until then, so those that come again are not lost.
REMEMBERED_BYTES = 96 << 20
#: A word that stands after each piece where many are encoded in one text, and pieces in such a text.
MARK = b"\x01"
BETWEEN = b" \x01 "
PIECES = 256

# Fixed value: the pattern by which a vocabulary of words with end marks cuts a text in lower case.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for printable ASCII, and a byte that no printable text holds, which stands for the end of a word.
WORDS_OF = re.compile(WORD_PATTERN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall
PRINTABLE = re.compile(rb"[!-~]+").fullmatch
WORD_END = b"\0"


def masked(data: bytes) -> int:
    """A CRC-32, rotated and shifted by a constant, so that checksums of data that holds checksums stay sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(TAIL, masked(length)), payload, struct.pack(TAIL, masked(payload))))


def read_record(file) -> bytes | None:
    """The next payload; None at the end of the file. A wrong checksum or a cut record is an error."""
    head = file.read(HEAD_BYTES)
    if not head:
        return None
    if len(head) < HEAD_BYTES or masked(head[:8]) != struct.unpack(HEAD, head)[1]:
        raise ValueError("damaged record length")
    length = struct.unpack(HEAD, head)[0]
    payload, tail = file.read(length), file.read(TAIL_BYTES)
    if len(payload) < length or len(tail) < TAIL_BYTES or masked(payload) != struct.unpack(TAIL, tail)[0]:
        raise ValueError("damaged record")
    return payload


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PieceEncoder:
    """Token ids of texts under a vocabulary file of the tokenizers library.

    If the file is of the kind whose tokens never reach across white space (words cut by ``WORD_PATTERN``, lower case, with
    a mark at each word's end), texts are split at ASCII white space and only pieces that the worker has not seen lately
    are encoded: those of printable ASCII by merge ranks, all of a batch together, others by the library. A file of any other kind goes
    through the library text by text.
    """

    def __init__(self, path: str) -> None:
        # Spark runs a worker on each core; threads of the library would only wait for one another.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 2**16 else 4
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        with open(path, encoding="utf-8") as file:
            self._prepare(json.load(file))

    def _prepare(self, spec: dict) -> None:
        model, splits = spec["model"], spec.get("pre_tokenizer") or {}
        steps = [(x.get("type"), x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("use_regex")) for x in splits.get("pretokenizers", [])]
        words = steps == [("Split", {"Regex": WORD_PATTERN}, "Removed", True, None), ("ByteLevel", None, None, None, False)]
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        marks = spec.get("added_tokens", [])
        plain = not any(t[k] for t in marks for k in ("single_word", "lstrip", "rstrip", "normalized")) and all("<|" in t["content"] for t in marks)
        self.by_pieces = model["type"] == "BPE" and words and normal == ["NFC", "Replace", "Lowercase"] and plain
        end, vocabulary, letters = model.get("end_of_word_suffix"), model["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else list(m) for m in model.get("merges", [])]
        made = [vocabulary.get(a + b, -1) for a, b in merges]
        # A mark is one token, and other texts do not have it.
        told = self._library([MARK])[0]
        self.mark = told[0] if len(told) == 1 and model["vocab"].get(self.tokenizer.id_to_token(told[0])) == told[0] else None
        self.ranked = None
        if not (self.by_pieces and end and made == sorted(set(made)) and len(vocabulary) == 512 + len(made) and made[0] >= 512):
            return
        ranks = {}
        for token, i in vocabulary.items():
            inner = token.removesuffix(end)
            ranks[bytes(letters[x] for x in inner) + WORD_END * (inner != token)] = i
        import tiktoken

        self.ranked_mark = ranks[MARK + WORD_END]
        self.ranked = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_pieces:
            done = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, f"<u{self.width}").tobytes() for e in done]
        pieces = [text.split() for text in texts]
        if self.held > REMEMBERED_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        known, older = self.known, self.older
        new = set(chain.from_iterable(pieces)).difference(known)
        ready = {p: older[p] for p in new if p in older}
        if len(ready) < len(new):
            ready |= self._new([p for p in new if p not in ready])
        known.update(ready)
        self.held += sum(map(len, ready)) + sum(map(len, ready.values())) + 120 * len(ready)
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in pieces]

    def _new(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        if self.ranked is None:
            return self._by_library(pieces)
        plain, others = [], []
        for p in pieces:
            (plain if PRINTABLE(p) and b"<|" not in p else others).append(p)
        out = self._by_library(others)
        if plain:
            # All pieces in one text, the mark as a word of its own after each.
            text = BETWEEN.join([*plain, b""]).lower().decode()
            ids = np.asarray(self.ranked.encode_to_numpy("\0".join(WORDS_OF(text)) + "\0"))
            out.update(self._cut(plain, ids, self.ranked_mark))
        return out

    def _cut(self, pieces: list[bytes], ids: np.ndarray, mark: int) -> Iterator[tuple[bytes, bytes]]:
        """The ids of each piece, after which a mark stands."""
        ends = np.flatnonzero(ids == mark)
        if len(ends) != len(pieces):
            raise RuntimeError("a mark between pieces was lost")
        whole, width = ids.astype(f"<u{self.width}").tobytes(), self.width
        cuts = (ends * width).tolist()
        return ((p, whole[a:b]) for p, a, b in zip(pieces, [0, *(x + width for x in cuts)], cuts))

    def _by_library(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Many pieces to a text, as tokens do not reach across the white space between; those that hold the mark by themselves."""
        out, together = {}, []
        for p in pieces:
            if self.mark is None or MARK in p:
                out[p] = np.array(self._library([p])[0], f"<u{self.width}").tobytes()
            else:
                together.append(p)
        groups = [together[k : k + PIECES] for k in range(0, len(together), PIECES)]
        for group, ids in zip(groups, self._library([BETWEEN.join([*group, b""]) for group in groups])):
            out.update(self._cut(group, np.array(ids), self.mark))
        return out

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


MANIFEST = "file_no int, path string, width int, n_records long, n_tokens long, n_bytes long"


def writer(folder: str, vocabulary: str, end_id: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """Writes the rows of a task, in their order, to one record file and its index, and yields its manifest row.

    File names are new for each attempt, and only files named in the manifest count; so a task that is lost or run
    twice leaves nothing that is read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, encode = TaskContext.get().partitionId(), encoder(vocabulary)
        width = encode.width
        end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        path = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}"
        system, local = opened(path)
        system.create_dir(local.rsplit("/", 1)[0], recursive=True)
        offsets, at, tokens = [], 0, 0
        with system.open_output_stream(local + ".rec") as out:
            for batch in batches:
                names, texts = batch.column(0), batch.column(1)
                for low in range(0, len(batch), 64):
                    docs = names.slice(low, 64).to_pylist()
                    raw = [(x or "").encode() for x in texts.slice(low, 64).to_pylist()]
                    for doc, ids in zip(docs, encode.encode(raw)):
                        record = framed(struct.pack(ID, doc is not None, doc or 0) + ids + end)
                        out.write(record)
                        offsets.append(at)
                        at += len(record)
                        tokens += (len(ids) + len(end)) // width
        with system.open_output_stream(local + ".idx") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "file_no": number, "path": path, "width": width, "n_records": len(offsets), "n_tokens": tokens,
                    "n_bytes": at,
                }
            ],
            pa.schema([(n, pa.int32() if t == "int" else pa.string() if t == "string" else pa.int64())
                       for n, t in (x.split() for x in MANIFEST.split(", "))]),
        )

    return write


def write_records(
    df: DataFrame,
    vocabulary: str,
    end_id: int | None = None,
    folder: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode every text and write it as a record, documents in ascending order of id over all files.

    ``folder`` must be one that the driver and all executors see; by default it is a new one below the shared folder.
    The result is the manifest: one row per file, with the first token's place among all (``start``). A missing or
    empty text is a record with the end id alone, or with no ids. Rows without an id come first; rows of one id stand in
    the order of a hash of their text. An empty table gives an empty manifest. Other columns are not looked at.
    """
    folder = folder or fresh_path(df.sparkSession, "records")
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    manifest = keep(rows.mapInArrow(writer(folder, vocabulary, end_id), MANIFEST).where("n_records > 0"), "manifest")
    # One row for each file.
    before = Window.partitionBy(F.lit(0)).orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return keep(manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


RECORD = "doc_id long, start long, n_tokens long, ids binary"
RECORD_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def parsed(payload: bytes, start: int, width: int) -> tuple:
    has_id, doc = struct.unpack_from(ID, payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=ID_BYTES)
    return (doc if has_id else None, start, len(ids), ids.astype("<u4").tobytes())


def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), RECORD_ARROW.types)], schema=RECORD_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), RECORD_ARROW.types)], schema=RECORD_ARROW)


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records of the files of a manifest: doc_id, ``start`` (token ids before it), n_tokens, and ids as
    little-endian 32-bit numbers. Each file is streamed by one task; every checksum is tested."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for entry in batch.to_pylist():
                    system, local = opened(entry["path"])
                    start = entry["start"]
                    with system.open_input_stream(local + ".rec", buffer_size=1 << 20) as file:
                        while (payload := read_record(file)) is not None:
                            row = parsed(payload, start, entry["width"])
                            start += row[2]
                            yield row

        yield from batched(rows())

    files = manifest.select("file_no", "path", "width", "start")
    return files.repartitionByRange(max(1, manifest.count()), "file_no").mapInArrow(read, RECORD)


def read_shuffled(spark: SparkSession, manifest: DataFrame, seed: int) -> DataFrame:
    """All records in an order drawn by ``seed``, each read on its own at the offset that the index names.

    ``start`` is missing here, as a record read alone does not know what comes before it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for entry in batch.to_pylist():
                    system, local = opened(entry["path"])
                    with system.open_input_file(local + ".idx") as index:
                        offset = int.from_bytes(index.read_at(8, entry["record"] * 8), "little")
                    with system.open_input_file(local + ".rec") as file:
                        file.seek(offset)
                        row = parsed(read_record(file), 0, entry["width"])
                        yield (row[0], None, row[2], row[3])

        yield from batched(rows())

    records = manifest.withColumn("record", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1)))
    records = records.withColumn("draw", F.xxhash64("file_no", "record", F.lit(seed)))
    records = records.repartitionByRange("draw").sortWithinPartitions("draw")
    return records.select("path", "width", "record").mapInArrow(read, RECORD)
