"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import bytes_of, keep

#: A difference cover: modulo 13, every difference occurs between two of these residues.
MODULUS = 13
COVER = (0, 1, 3, 9)
#: Suffixes that are sorted at once, bytes of text that one bucket of suffixes brings together, and rounds in which the
#: buckets are worked through. A round's shuffle holds that part of all suffixes.
SORTED = 2**20
BUCKET_BYTES = 6 << 20
ROUNDS = 4
#: Length of the strings by whose least hash suffixes are dealt into buckets.
ANCHOR = 20
#: A least hash whose runs would fill half a bucket is hot; its strings are dealt one by one. Hashes that a task sees
#: less often than this in the texts it deals out at once are not counted for that.
HOT_LEAST = 32
#: Bytes of text that are hashed at once, and that a task deals out at once; stretches that are compared at once.
HASHED, DEALT = 512 << 10, 24 << 20
COMPARED = 2**15
#: Bytes of stretches that are brought together at once.
GATHERED = 2 << 20
#: Starts whose least hashes are sought at once (small enough for the processor's cache). Places within them and the hash
#: share 32 bits.
SOUGHT = 2**15

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_32 = 0x9E3779B1
LAST = np.iinfo(np.int64).max


def shifts() -> np.ndarray:
    """For two residues, the least shift that brings both into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(d for d in range(MODULUS) if inside[a + d] and inside[b + d])
    return out


def cover_ranks(words: np.ndarray, size: int, depth: int) -> np.ndarray:
    """The rank, among the positions in the cover, of the string of at least ``depth`` bytes that starts there."""
    at = np.flatnonzero(np.isin(np.arange(size) % MODULUS, COVER))
    one, two = words[at], words[at + 8]
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.ones(len(at), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    # Only what ties so far is sorted by the next word.
    for k in range(2, -(-depth // 8)):
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        own = order[tied]
        word = words[at[own] + 8 * k]
        sort = np.lexsort((word, np.cumsum(new)[tied]))
        order[tied], word = own[sort], word[sort]
        new[tied[1:]] |= word[1:] != word[:-1]
    ranks = np.zeros(size + MODULUS, np.int32)
    ranks[at[order]] = np.cumsum(new)
    return ranks


def resolve(at: np.ndarray, group: np.ndarray, ranks: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Sort positions that tie on their first MODULUS bytes, group by group, by the ranks of the cover.

    Each position is compared with the first of its group: both move on by the shift that brings them into the cover,
    and the ranks there decide. Smaller ones, equal ones and larger ones become groups of their own, until all that are
    left in a group are equal.
    """
    at, own, open_ = at.copy(), group, np.arange(len(at))
    while len(open_):
        pos = at[open_]
        first = np.ones(len(pos), bool)
        first[1:] = own[1:] != own[:-1]
        pivot = pos[first][np.cumsum(first) - 1]
        move = shift[pos % MODULUS, pivot % MODULUS]
        side = np.sign(ranks[pos + move].astype(np.int64) - ranks[pivot + move])
        key = own * 3 + side + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        at[open_] = pos[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        own = np.cumsum(new) - 1
        left = (key % 3 != 1) & (np.bincount(own)[own] > 1)
        open_, own = open_[left], own[left]
    return at


def sorted_blocks(text: np.ndarray, starts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes at ``starts`` in the order of at least their first ``depth`` bytes, one bucket after the other.

    Yields the starts in order, and where a suffix differs within ``depth`` bytes from the one before it. The text
    must have ``depth`` + 24 bytes after the last start.
    """
    size = len(text) - 8
    words = np.zeros(size, np.uint64)
    for k in range(8):
        words |= text[k : k + size].astype(np.uint64) << np.uint64(56 - 8 * k)
    size -= 8 * -(-depth // 8)
    ranks, shift = cover_ranks(words, size, depth), shifts()
    heads = words[starts]
    count = max(1, -(-len(starts) // SORTED))
    some = np.sort(heads[:: max(1, len(heads) // (64 * count))])
    cuts = np.unique(some[[len(some) * k // count for k in range(1, count)]]) if count > 1 else np.zeros(0, np.uint64)
    block = np.searchsorted(cuts, heads, side="right")
    for k in range(len(cuts) + 1):
        at = starts[block == k]
        if not len(at):
            continue
        one, two = words[at], words[at + 8]
        order = np.lexsort((two, one))
        at, one, two = at[order], one[order], two[order]
        new = np.ones(len(at), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        which = np.flatnonzero(tied)
        dense = np.cumsum(new[which]) - 1
        at[which] = resolve(at[which], dense, ranks, shift)
        differs = np.ones(len(at), bool)
        differs[1:] = False
        for step in [*range(0, depth - 8, 8), depth - 8]:
            word = words[at + step]
            differs[1:] |= word[1:] != word[:-1]
        yield at, differs


def rolling(text: np.ndarray, width: int) -> np.ndarray:
    """A 32-bit hash of the ``width`` bytes from each position that has as many. Its upper half is well mixed."""
    run = text.astype(np.uint32)
    run += np.uint32(1)
    out, done, covered, left = None, 0, 1, width
    while left:
        if left & 1:
            if out is None:
                out = run
            else:
                out = out[: len(run) - done] * np.uint32(pow(ODD_32, covered, 2**32))
                out += run[done:]
            done += covered
        left >>= 1
        if left:
            ahead = run[covered:]
            run = run[:-covered] * np.uint32(pow(ODD_32, covered, 2**32))
            run += ahead
            covered *= 2
    out = out ^ out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out


def least_places(text: np.ndarray, depth: int) -> np.ndarray:
    """For each string of ``depth`` bytes, the place of its least hash of ANCHOR bytes, the leftmost of equal ones."""
    out = np.empty(len(text) - depth + 1, np.int32)
    # The hash's upper half, then the place, so that one minimum gives both.
    kind, bits = (np.uint32, 16) if SOUGHT + depth <= 2**16 else (np.uint64, 32)
    numbers, wide = np.arange(SOUGHT + depth, dtype=kind), depth - ANCHOR + 1
    for low in range(0, len(out), SOUGHT):
        least = (rolling(text[low : low + SOUGHT + depth - 1], ANCHOR) >> np.uint32(16)).astype(kind, copy=False)
        least <<= kind(bits)
        least |= numbers[: len(least)]
        have = 1
        while have * 2 <= wide:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < wide:
            least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
        np.add(least & kind(2**bits - 1), low, out=out[low : low + SOUGHT], casting="unsafe")
    return out


def anchored(text: np.ndarray, valid: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of ``depth`` bytes that share the place of their least hash of ANCHOR bytes.

    ``valid`` marks where a string may start. Gives each run's first start, its number of starts and a 64-bit hash of the
    bytes at that place. The place depends on the string's bytes alone, so equal strings always have the same hash.
    """
    place = least_places(text, depth)
    first, last = valid[: len(place)].copy(), valid[: len(place)].copy()
    moved = place[1:] != place[:-1]
    first[1:] &= moved | ~valid[: len(place) - 1]
    last[:-1] &= moved | ~valid[1 : len(place)]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) - starts + 1, mixed(sliding_window_view(text, ANCHOR)[place[starts]].view("<u4"))


def mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of words."""
    out = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        out ^= words[:, k]
        out *= ODD
        out ^= out >> np.uint64(32)
    return out


def gathered(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches one after the other. The text must go on after the last start for the longest of them."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    width = int(lengths.max())
    windows, inside = sliding_window_view(text, width), np.arange(width)
    many = max(1, HASHED // width)
    parts = []
    for low in range(0, len(starts), many):
        block = windows[starts[low : low + many]]
        parts.append(block[inside < lengths[low : low + many, None]])
    return np.concatenate(parts)


def run_words(text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Words of 8 bytes that cover each run: two runs are equal if their lengths and words are."""
    # From the front as many as every run has, and from the end those for what a run may have beyond.
    front = depth // 8 * 8
    back = -(-(2 * depth - ANCHOR - front) // 8) * 8
    words = sliding_window_view(text, front)[begins].view("<u8")
    return np.hstack([words, sliding_window_view(text, back)[begins + lengths - back].view("<u8")])


def run_hashes(text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit hash of all of each run's bytes."""
    out = np.zeros(len(begins), np.uint64)
    for low in range(0, len(begins), COMPARED):
        rows = slice(low, low + COMPARED)
        out[rows] = mixed(run_words(text, begins[rows], lengths[rows], depth))
    return out


def shared(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The rows whose hash several documents have, in their order."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    rank = np.argsort(hashes)
    new = np.ones(len(rank), bool)
    new[1:] = hashes[rank][1:] != hashes[rank][:-1]
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    several = np.minimum.reduceat(orders[rank], head) < np.maximum.reduceat(orders[rank], head)
    return np.sort(rank[several[group]])


def copied(
    text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, orders: np.ndarray, depth: int, whole: np.ndarray | None = None
) -> np.ndarray:
    """Which runs are byte for byte those of a smaller document. ``whole`` are their hashes of all bytes, if known.

    A run that is not found here is still compared with others when suffixes are sorted.
    """
    out = np.zeros(len(begins), bool)
    if whole is None:
        whole = run_hashes(text, begins, lengths, depth)
    sort = np.lexsort((orders, whole))
    new = np.ones(len(sort), bool)
    new[1:] = whole[sort][1:] != whole[sort][:-1]
    first = sort[new][np.cumsum(new) - 1] if len(sort) else sort
    larger = orders[sort] > orders[first]
    larger &= lengths[sort] == lengths[first]
    sort, first = sort[larger], first[larger]
    for low in range(0, len(sort), COMPARED):
        a, b = sort[low : low + COMPARED], first[low : low + COMPARED]
        same = run_words(text, begins[a], lengths[a], depth) == run_words(text, begins[b], lengths[b], depth)
        out[a[same.all(axis=1)]] = True
    return out


#: A new one for each of many small blobs would take longer than the work.
compressor = cache(lambda: zstandard.ZstdCompressor(1))
decompressor = cache(zstandard.ZstdDecompressor)


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], "<u4").tobytes()
    return compressor().compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    data = decompressor().decompress(data)
    at, out = 4 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, "<u4", len(kinds)).tolist(), kinds):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


DEAL = "bucket long, removal boolean, data binary"
SEGMENTS = ("u8", "i8", "i8", "u4", "u4", "u4", "u1")  # hash; documents' order and key; document, start, starts; bytes
REMOVALS = ("i8", "i8", "u4", "u4")  # document's order and key, start, length


class Dealer:
    """Deals the runs of a task's documents into buckets, one round's share of them.

    Runs whose hash is among ``hot``, a sorted array, are dealt string by string.
    """

    def __init__(self, depth: int, turn: int, rounds: int, buckets: int, hot: np.ndarray | None = None) -> None:
        self.depth, self.turn, self.rounds, self.buckets = depth, turn, rounds, buckets
        self.hot = np.zeros(0, np.uint64) if hot is None else hot
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts: list[np.ndarray] = []
        self.orders: list[int] = []
        self.keys: list[int] = []
        self.size = 0

    def add(self, texts: list[tuple[int, int, bytes]]) -> None:
        """Documents (order, key, bytes), hashed together. Longer ones than fit are cut so that no string is lost."""
        pieces, size = [], 0
        for order, key, data in texts:
            number = len(self.orders)
            self.orders.append(order)
            self.keys.append(key)
            for at in range(0, max(1, len(data) - self.depth + 1), HASHED):
                piece = data[at : at + HASHED + self.depth - 1]
                pieces.append((number, at, piece))
                size += len(piece)
                if size > HASHED:
                    self._hash(pieces)
                    pieces, size = [], 0
        if pieces:
            self._hash(pieces)

    def _hash(self, pieces: list[tuple[int, int, bytes]]) -> None:
        text = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        lengths = np.array([len(p) for _, _, p in pieces])
        begins = np.cumsum(lengths) - lengths
        valid = np.ones(len(text) + 1, bool)
        for begin, length in zip(begins.tolist(), lengths.tolist()):
            valid[max(begin, begin + length - self.depth + 1) : begin + length] = False
        valid = valid[:-1]
        base, self.size = self.size, self.size + len(text)
        self._hold(text)
        if len(text) < self.depth:
            return
        self._take(pieces, base, begins, *anchored(text, valid, self.depth))

    def _hold(self, text: np.ndarray) -> None:
        self.texts.append(text)

    def _take(self, pieces, base, begins, starts, counts, hashes) -> None:
        mine = (hashes >> np.uint64(40)) % np.uint64(self.rounds) == np.uint64(self.turn)
        starts, counts, hashes = starts[mine], counts[mine], hashes[mine]
        piece = np.searchsorted(begins, starts, side="right") - 1
        documents = np.array([d for d, _, _ in pieces])[piece]
        offsets = np.array([a for _, a, _ in pieces])[piece] + starts - begins[piece]
        self.parts.append((hashes, documents, offsets, counts, base + starts))

    def deal(self) -> Iterator[tuple[int, bool, bytes]]:
        """Rows for the buckets; then, as removals, runs that a smaller document of this task has as well."""
        if self.parts:
            hashes, documents, offsets, counts, begins = (np.concatenate(x) for x in zip(*self.parts))
            text = np.concatenate([*self.texts, np.zeros(2 * self.depth, np.uint8)])
            lengths = counts + self.depth - 1
            orders, keys = np.array(self.orders, np.int64), np.array(self.keys, np.int64)
            hot = np.isin(hashes, self.hot)
            if hot.any():
                own = (x[hot] for x in (documents, offsets, counts, begins))
                yield from self._deal_strings(*own, text, orders, keys)
                hashes, documents, offsets, counts, lengths, begins = (
                    x[~hot] for x in (hashes, documents, offsets, counts, lengths, begins)
                )
            copies = np.zeros(len(hashes), bool)
            rows = shared(hashes, orders[documents])
            # So a run that very many documents share leaves a task once.
            copies[rows] = copied(text, begins[rows], lengths[rows], orders[documents[rows]], self.depth)
            at = np.flatnonzero(copies)
            if len(at):
                d = documents[at]
                yield int(keys[d[0]] % self.buckets), True, packed(
                    orders[d], keys[d], offsets[at].astype("<u4"), lengths[at].astype("<u4")
                )
            rows = np.flatnonzero(~copies)
            yield from self._rows(
                hashes[rows], documents[rows], offsets[rows], counts[rows], begins[rows], text, orders, keys
            )
        self.clear()

    def _deal_strings(
        self, documents: np.ndarray, offsets: np.ndarray, counts: np.ndarray, begins: np.ndarray, text: np.ndarray,
        orders: np.ndarray, keys: np.ndarray,
    ) -> Iterator[tuple[int, bool, bytes]]:
        """The strings of hot runs, each to the bucket of its own hash, so that equal ones still meet; as removals,
        those that a smaller document of this task has as well."""
        row = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        places, offset, owner = begins[row] + step, offsets[row] + step, documents[row]
        long = np.full(len(row), self.depth)
        one = run_hashes(text, places, long, self.depth)
        copies = copied(text, places, long, orders[owner], self.depth, one)
        at = np.flatnonzero(copies)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (row[at][1:] != row[at][:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(at)))
            d = owner[at[first]]
            yield int(keys[d[0]] % self.buckets), True, packed(
                orders[d], keys[d], offset[at[first]].astype("<u4"), (many + self.depth - 1).astype("<u4")
            )
        rows = np.flatnonzero(~copies)
        single = np.ones(len(rows), np.int64)
        yield from self._rows(one[rows], owner[rows], offset[rows], single, places[rows], text, orders, keys)

    def _rows(
        self, hashes: np.ndarray, documents: np.ndarray, offsets: np.ndarray, counts: np.ndarray, begins: np.ndarray,
        text: np.ndarray, orders: np.ndarray, keys: np.ndarray,
    ) -> Iterator[tuple[int, bool, bytes]]:
        """One row for each bucket. Runs come by documents.

        What a row holds is put in order for all buckets at once: a large table has thousands of them, with few runs each.
        """
        if not len(hashes):
            return
        bucket = (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64) % self.buckets
        order = np.argsort(bucket.astype(np.uint16) if self.buckets <= 2**16 else bucket, kind="stable")
        hashes, documents, bucket = hashes[order], documents[order], bucket[order]
        offsets, begins, counts = offsets[order].astype("<u4"), begins[order], counts[order]
        lengths = counts + self.depth - 1
        head = np.ones(len(order), bool)
        head[1:] = bucket[1:] != bucket[:-1]
        fresh = head.copy()
        fresh[1:] |= documents[1:] != documents[:-1]
        cuts = np.append(np.flatnonzero(head), len(order))
        # For each row, the documents before those of its bucket, and the bytes before it.
        nth = np.append(np.cumsum(fresh) - 1, fresh.sum())
        there = documents[fresh]
        number = (nth[:-1] - np.repeat(nth[cuts[:-1]], np.diff(cuts))).astype("<u4")
        sizes = np.append(0, np.cumsum(lengths))
        order_of, key_of, counts = orders[there], keys[there], counts.astype("<u4")
        # The bytes of some buckets at a time.
        for some in np.split(np.arange(len(cuts) - 1), np.flatnonzero(np.diff(sizes[cuts[:-1]] // GATHERED)) + 1):
            low, high = cuts[some[0]], cuts[some[-1] + 1]
            data = gathered(text, begins[low:high], lengths[low:high])
            for a, b in zip(cuts[some].tolist(), cuts[some + 1].tolist()):
                documents_ = slice(nth[a], nth[b])
                yield int(bucket[a]), False, packed(
                    hashes[a:b], order_of[documents_], key_of[documents_], number[a:b], offsets[a:b], counts[a:b],
                    data[sizes[a] - sizes[low] : sizes[b] - sizes[low]],
                )


class Counter(Dealer):
    """Counts a task's runs by hash."""

    def __init__(self, depth: int, least: int) -> None:
        super().__init__(depth, 0, 1, 1)
        self.least = least

    def _hold(self, text: np.ndarray) -> None:
        """Counts need no text."""

    def _take(self, pieces, base, begins, starts, counts, hashes) -> None:
        self.parts.append((hashes, counts))

    def deal(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The hashes of at least ``least`` runs, how many, and the strings in these."""
        if self.parts:
            hashes, counts = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
            runs = np.diff(np.append(head, len(hashes)))
            often = runs >= self.least
            if often.any():
                yield hashes[head][often], runs[often], np.add.reduceat(counts, head)[often]
        self.clear()


COUNTS = "hash long, runs long, strings long"


def _dealer_pass(make, batches_of):
    """Feeds a task's documents to what ``make`` makes, and gives what that deals as batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = make()

        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist())
                dealer.add([(LAST if order is None else order, key, data or b"") for order, key, data in rows])
                if dealer.size > DEALT:
                    yield from batches_of(dealer.deal())
        yield from batches_of(dealer.deal())

    return run


def _counted(depth: int, least: int):
    def batches_of(dealt) -> Iterator[pa.RecordBatch]:
        for hashes, runs, strings in dealt:
            columns = [pa.array(x) for x in (hashes.view(np.int64), runs.astype(np.int64), strings.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "runs", "strings"])

    return _dealer_pass(lambda: Counter(depth, least), batches_of)


def hot_anchors(texts: DataFrame, depth: int) -> tuple[np.ndarray, int]:
    """The hashes whose runs have half a bucket's bytes or more, sorted, and the number of strings in these runs.

    There is at most one such hash for each half bucket of text that is dealt.
    """
    counts = texts.mapInArrow(_counted(depth, HOT_LEAST), COUNTS)
    counts = counts.groupBy("hash").agg(F.sum("runs").alias("runs"), F.sum("strings").alias("strings"))
    size = F.col("runs") * (depth - 1) + F.col("strings")
    found = counts.where(size >= BUCKET_BYTES // 2).select("hash", "strings").toPandas()
    return np.sort(found["hash"].to_numpy(np.int64).view(np.uint64)), int(found["strings"].sum())


def _dealt(depth: int, turn: int, rounds: int, buckets: int, hot: np.ndarray):
    def batch_of(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "removal", "data"])

    def batches_of(dealt) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in dealt:
            rows.append(row)
            size += len(row[2])
            if size > GATHERED:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return _dealer_pass(lambda: Dealer(depth, turn, rounds, buckets, hot), batches_of)


FOUND = "order long, key long, start long, length long"


def found_batch(orders, keys, starts, lengths) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(x, np.int64)) for x in (orders, keys, starts, lengths)]
    return pa.RecordBatch.from_arrays(columns, names=["order", "key", "start", "length"])


def bucket_removals(blobs: list[bytes], depth: int) -> Iterator[pa.RecordBatch]:
    """What a bucket's documents lose: strings that a smaller document of the bucket has."""
    parts = []
    for blob in blobs:
        hashes, orders, keys, number, offsets, counts, text = unpacked(blob, SEGMENTS)
        parts.append((hashes, orders[number], keys[number], offsets.astype(np.int64), counts.astype(np.int64), text))
    hashes, orders, keys, offsets, counts, text = (np.concatenate(x) for x in zip(*parts))
    lengths = counts + depth - 1
    begins = np.cumsum(lengths) - lengths
    # Runs whose hash only one document has cannot meet another. Of equal runs, that of the smallest document stands for
    # those of larger ones, which lose all their strings.
    rows = shared(hashes, orders)
    copies = copied(text, begins[rows], lengths[rows], orders[rows], depth)
    gone, rows = rows[copies], rows[~copies]
    if len(gone):
        yield found_batch(orders[gone], keys[gone], offsets[gone], lengths[gone])
    rows = rows[shared(hashes[rows], orders[rows])]
    if not len(rows):
        return
    own, many = lengths[rows], counts[rows]
    text = np.concatenate([text, np.zeros(2 * depth, np.uint8)])
    text = np.concatenate([gathered(text, begins[rows], own), np.zeros(depth + 32, np.uint8)])
    first = np.cumsum(own) - own
    ends = np.cumsum(many)
    row = np.repeat(np.arange(len(rows)), many)
    step = np.arange(ends[-1]) - np.repeat(ends - many, many)
    starts = first[row] + step
    owner = orders[rows]
    removed = np.zeros(len(text), bool)
    at_row = np.zeros(len(text), np.int64)
    at_row[starts] = row
    for at, differs in sorted_blocks(text, starts, depth):
        mine = owner[at_row[at]]
        least = np.minimum.reduceat(mine, np.flatnonzero(differs))[np.cumsum(differs) - 1]
        removed[at[mine > least]] = True
    hit = removed[starts]
    row, step = row[hit], step[hit]
    if not len(row):
        return
    begin = np.ones(len(row), bool)
    begin[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
    at = np.flatnonzero(begin)
    run = np.diff(np.append(at, len(row)))
    which = rows[row[at]]
    yield found_batch(orders[which], keys[which], offsets[which] + step[at], run + depth - 1)


def _removed(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([c[k].as_py() for c in batch.columns] for batch in batches for k in range(len(batch)))
        for _, bucket in groupby(rows, key=lambda r: r[0]):
            blobs = []
            for _, removal, data in bucket:
                if removal:
                    yield found_batch(*unpacked(data, REMOVALS))
                else:
                    blobs.append(data)
            if blobs:
                yield from bucket_removals(blobs, depth)

    return run


def cut_out(data: bytes, starts: list[int], lengths: list[int]) -> tuple[bytes, list[int], list[int]]:
    """The bytes left when stretches are taken out, and the stretches joined where they touch or overlap."""
    if not len(starts):
        return data, [], []
    order = np.argsort(np.asarray(starts))
    low = np.asarray(starts)[order]
    high = np.maximum.accumulate(low + np.asarray(lengths)[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    at = np.flatnonzero(new)
    begins, ends = low[at].tolist(), high[np.append(at[1:], len(low)) - 1].tolist()
    left = [data[a:b] for a, b in zip([0, *ends], [*begins, len(data)])]
    return b"".join(left), begins, ends


def _release(spark) -> None:
    """Let go of finished jobs, so that Spark's cleaner deletes their shuffle files before the next round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(
    df: DataFrame,
    depth: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """Take out each byte covered by a string of ``depth`` bytes that also starts in a row with a smaller id.

    One row per row of ``df``: the id, ``n_bytes`` of the text in UTF-8, ``starts`` and ``ends`` of the removed runs,
    each as long as possible, and ``kept``, the bytes left over. Strings are judged on the input, not on what is left,
    and never cross rows.

    A missing text is empty; texts shorter than ``depth`` lose nothing. Rows of the same id do not count as smaller
    than each other; rows without an id come after all others. An empty table gives an empty result. Other columns
    are not looked at. A ``depth`` below ANCHOR is refused.

    Suffixes are worth comparing for ``depth`` bytes only. They are dealt into buckets by the least hash of ANCHOR bytes
    among those bytes, which equal strings share; neighbouring suffixes with the same least hash travel as one stretch
    of text. A hash that fills half a bucket, such as that of a line in very many rows with other text around it, would
    bring all its stretches together; such hashes are counted first, and their strings are dealt one by one, by a hash
    of all their bytes. Buckets are dealt in ``rounds``, each a part of the hash space, so no more than that part of all suffixes is
    in flight. Of stretches that are byte for byte equal, that of the smallest row stands for those of larger ones, in a
    task before it deals and in a bucket again. A bucket sorts its suffixes block by block: by their first 16 bytes, and
    ties by the ranks of a difference cover of the bucket's text. Equal neighbours in that order are the repeats.
    """
    if depth < ANCHOR:
        raise ValueError(f"depth has to be {ANCHOR} or more")
    spark = df.sparkSession
    texts = df.select(
        F.col(id_column).cast("long").alias("order"), bytes_of(F.col(text_column).cast("string")).alias("data")
    )
    # The content tells rows of one id apart; rows that it does not are the same row again.
    texts = texts.withColumn("key", F.xxhash64("data")).select("order", "key", "data")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    hot, strings = hot_anchors(texts, depth)
    # A run brings its bytes and up to ``depth`` more: about four times the text in all. A string dealt by itself
    # brings ``depth`` bytes.
    buckets = max(1, -(-(4 * total + strings * depth) // (rounds * BUCKET_BYTES)))
    found = []
    for turn in range(rounds):
        dealt = texts.mapInArrow(_dealt(depth, turn, rounds, buckets, hot), DEAL)
        dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
        found.append(keep(dealt.mapInArrow(_removed(depth), FOUND), "removals"))
        del dealt
        _release(spark)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    spans = every.groupBy("order", "key").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    texts = texts.withColumn("place", F.coalesce("order", F.lit(LAST)))
    joined = texts.alias("t").join(
        spans.alias("s"), (F.col("t.place") == F.col("s.order")) & (F.col("t.key") == F.col("s.key")), "left"
    )

    @F.arrow_udf("struct<kept: binary, starts: array<long>, ends: array<long>>")
    def taken(data: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
        rows = (cut_out(d.as_py(), s.as_py() or [], n.as_py() or []) for d, s, n in zip(data, starts, lengths))
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kept", "starts", "ends"])

    out = joined.select("t.order", "t.data", taken("t.data", "s.spans.start", "s.spans.length").alias("taken"))
    return out.select(
        F.col("order").alias("doc_id"),
        F.octet_length("data").cast("long").alias("n_bytes"),
        "taken.starts", "taken.ends", "taken.kept",
    )
