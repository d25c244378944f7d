"""Periodic runs of words: suffix trees answer how far two places agree, Lyndon roots say which places to ask about."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a run: so many periods, and so many words, at least.
PERIODS, WORDS = 4, 6
#: Bytes of text whose words are numbered together, and words of candidate stretches that share a tree. A text or a
#: stretch that is longer is taken whole.
TEXT_BYTES = 2 << 20
TREE_WORDS = 20_000
#: A number above all words of one tree, by which its nodes' branches are told apart.
BRANCH = 1 << 32


def suffix_tree(symbols: list[int]) -> tuple[list[int], list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of all suffixes, built from left to right in one pass; the last symbol must occur once.

    Returns start and end of each node's edge, the place that its leaf's suffix starts from (-1: inner node), and the
    branches: node * BRANCH + first symbol -> child. Node 0 is the root.
    """
    n = len(symbols)
    start, end, link, suffix = [0], [0], [0], [-1]
    branch: dict[int, int] = {}
    get = branch.get
    node = edge = length = waiting = 0
    for i, symbol in enumerate(symbols):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = i
            key = node * BRANCH + symbols[edge]
            child = get(key)
            if child is None:
                branch[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                suffix.append(i - waiting + 1)
                if last:
                    link[last] = node
                    last = 0
            else:
                span = (end[child] if end[child] <= i else i + 1) - start[child]
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                at = start[child]
                if symbols[at + length] == symbol:
                    if last:
                        link[last] = node
                    length += 1
                    break
                inner = len(start)
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                suffix += (-1, i - waiting + 1)
                branch[key] = inner
                branch[inner * BRANCH + symbol] = inner + 1
                start[child] = at + length
                branch[inner * BRANCH + symbols[at + length]] = child
                if last:
                    link[last] = inner
                last = inner
            waiting -= 1
            if not node and length:
                length -= 1
                edge = i - waiting + 1
            elif node:
                node = link[node]
    return start, end, suffix, branch


class Agreement:
    """How many symbols from two places on agree: the depth of the lowest common ancestor of their leaves.

    Of the Euler tour of the suffix tree only what is needed is kept: the leaves in order, and between two neighbours
    the depth of the shallowest node that the tour passes. A table of minima over all power-of-two stretches answers a
    question with two lookups.
    """

    def __init__(self, symbols: list[int]) -> None:
        start, end, suffix, branch = suffix_tree(symbols)
        keys = np.fromiter(branch.keys(), np.int64, len(branch))
        children = np.fromiter(branch.values(), np.int64, len(branch))
        # Branches of a node next to each other, the greatest symbol first, so that the smallest is taken first off a stack.
        order = np.lexsort((-(keys % BRANCH), keys // BRANCH))
        del branch
        parents, children = (keys // BRANCH)[order], children[order].tolist()
        low = np.searchsorted(parents, np.arange(len(start)), "left").tolist()
        high = np.searchsorted(parents, np.arange(len(start)), "right").tolist()
        span = (np.array(end) - np.array(start)).tolist()
        leaves, depths, least = [], [], 0
        depth = [0] * len(start)
        stack = [0]
        while stack:
            at = stack.pop()
            if at < 0:  # back in an inner node, before its next branch
                least = min(least, depth[~at])
                continue
            if suffix[at] >= 0:
                leaves.append(suffix[at])
                depths.append(least)
                least = len(symbols)
                continue
            own = depth[at]
            for k in range(low[at], high[at]):
                child = children[k]
                depth[child] = own + span[child]
                if k > low[at]:
                    stack.append(~at)
                stack.append(child)
        self.leaves = np.array(leaves)
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[self.leaves] = np.arange(len(leaves))
        self.minima = [np.array(depths[1:], np.int32)]
        while len(self.minima[-1]) > 1 << (len(self.minima) - 1):
            reach = 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(self.minima[-1][:-reach], self.minima[-1][reach:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a and b, none equal."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of smaller rank; the length if there is none."""
    values, n = rank.tolist(), len(rank)
    out, stack = [n] * n, []
    for i, x in enumerate(values):
        while stack and values[stack[-1]] > x:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def runs_within(symbols: np.ndarray, periods: int = PERIODS, words: int = WORDS) -> np.ndarray:
    """Rows (start, length, period) of all runs, in order, of numbers whose first and last one occur nowhere else.

    The longest Lyndon word that starts at a place ends before the next smaller suffix. Every run has such a word, in the
    order of the symbols or in the opposite one, as a root; so each place gives two candidates, and each is extended in both directions
    as far as it agrees with itself one period on.
    """
    n = len(symbols)
    forward = Agreement(symbols.tolist())
    found = []
    for rank in (forward.rank, -forward.rank):
        period = next_smaller(rank) - np.arange(n)
        at = np.flatnonzero((np.arange(n) + period < n) & (period * periods <= n))
        at = at[at > 0]
        found.append(np.stack([at, period[at]]))
    at, period = np.concatenate(found, axis=1)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    right = forward(at, at + period)
    # A run that is long enough has enough words to the right of its leftmost root.
    rooted = right + 2 * period >= np.maximum(words, periods * period)
    at, period, right = at[rooted], period[rooted], right[rooted]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    del forward
    backward = Agreement(symbols[::-1].tolist())
    left = backward(n - at, n - at - period)
    runs = np.stack([at - left, left + period + right, period], axis=1)
    return np.unique(runs[runs[:, 1] >= np.maximum(words, periods * period)], axis=0)


def candidates(words: np.ndarray, parts: np.ndarray, periods: int = PERIODS, least: int = WORDS) -> list[tuple[int, int]]:
    """Stretches (from, to) of words, each in one part, outside of which no run reaches.

    A run holds each of its words as often as it has periods. So words that are rarer in their stretch are in no run and
    divide it; this goes on until nothing changes.
    """
    at = np.arange(len(words))
    stretch = parts.astype(np.int64)
    while len(at):
        _, back, count = np.unique(stretch << 32 | words[at], return_inverse=True, return_counts=True)
        often = count[back] >= periods
        if often.all():
            break
        # Places left over go on as one stretch while they are neighbours that were in one stretch before.
        at, before = at[often], stretch[often]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (before[1:] != before[:-1])
        stretch = np.cumsum(new)
        long = np.bincount(stretch)[stretch] >= least
        at, stretch = at[long], stretch[long]
    if not len(at):
        return []
    edges = np.flatnonzero(np.diff(stretch)) + 1
    return list(zip(at[np.r_[0, edges]].tolist(), (at[np.r_[edges - 1, len(at) - 1]] + 1).tolist()))


def runs_of(words: np.ndarray, parts: np.ndarray, periods: int = PERIODS, least: int = WORDS) -> np.ndarray:
    """Rows (start, length, period), in order, of the runs of numbered words; no run crosses from one part to another.

    Candidate stretches stand side by side in one tree, between symbols that occur nowhere else.
    """
    found, group, size = [], [], 0

    def search() -> None:
        total = sum(b - a for a, b in group) + len(group) + 1
        symbols, place = np.empty(total, np.int64), np.empty(total, np.int64)
        at = 0
        for k, (a, b) in enumerate(group):
            symbols[at], place[at] = k, -1
            symbols[at + 1 : at + 1 + b - a] = words[a:b] + len(group) + 1
            place[at + 1 : at + 1 + b - a] = np.arange(a, b)
            at += 1 + b - a
        symbols[at], place[at] = len(group), -1
        runs = runs_within(symbols, periods, least)
        runs[:, 0] = place[runs[:, 0]]
        found.append(runs)

    for a, b in candidates(words, parts, periods, least):
        group.append((a, b))
        size += b - a
        if size >= TREE_WORDS:
            search()
            group, size = [], 0
    if group:
        search()
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def text_runs(texts: pa.Array, periods: int, least: int) -> tuple[pa.Array, pa.Array]:
    """For each text its runs, and the text without what repeats a run's first period."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    there = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(there), owner[there.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    starts = np.r_[0, ends[:-1]]
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = runs_of(numbers, owner, periods, least)
    doc = owner[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    cuts = np.r_[0, np.cumsum(kept)][np.r_[0, ends]]
    left = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.filter(pa.array(kept)))
    fields = [pa.array(x) for x in (runs[:, 0] - starts[doc], runs[:, 1], runs[:, 2])]
    bounds = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))].astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return listed, pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())


def periodic_runs(
    df: DataFrame,
    text_column: str = "text",
    runs_column: str = "runs",
    collapsed_column: str = "collapsed",
    periods: int = PERIODS,
    least: int = WORDS,
) -> DataFrame:
    """Add the runs of words of each whole text, and the text without their repetitions.

    Words are what ASCII white space separates, numbered from 0. A run is a stretch of at least ``least`` words and
    ``periods`` periods, with words one (smallest) period apart identical, that no neighbouring word extends. ``runs`` lists
    (start, length, period) by start, then period. ``collapsed`` has the words, joined by one blank, that no run contains
    after its first period.

    A missing or empty text has no runs and an empty collapsed text. Repeated rows have the same runs each; an empty table
    gives an empty one. Other columns stay as they are; columns named like the new ones are replaced. Nothing is shuffled.
    """
    if periods < 2:
        raise ValueError("a run has two periods at least")
    df = df.drop(runs_column, collapsed_column)
    at = df.columns.index(text_column)
    fields = [*df.schema.fields, T.StructField(runs_column, RUN), T.StructField(collapsed_column, T.StringType())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            low = 0
            while low < len(batch):
                before = sizes[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, before + TEXT_BYTES, "right")))
                part = batch.slice(low, high - low)
                added = text_runs(part.column(at), periods, least)
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, runs_column, collapsed_column])
                low = high

    return df.withColumn(text_column, F.col(text_column).cast("string")).mapInArrow(search, T.StructType(fields))
