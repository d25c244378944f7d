"""Byte-level BPE by speculation: propose tokens greedily, verify neighbours, merge exactly only where that fails."""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import alone

# Fixed value: the pattern by which this kind of vocabulary splits text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose ids a Python worker remembers before it starts afresh; it keeps those from before until then. Only words of
#: at most LONG characters are remembered, so that this bounds memory. Results do not depend on it.
REMEMBERED = 300_000
LONG = 200
NEVER = 2**40
#: Bytes by which the lengths to try are looked up, and the longest word whose pairs are searched without a queue.
START = 3
PLAIN = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such a vocabulary: printable bytes stand for themselves, the others,
    in order, for the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def rank_encoder(spec: dict, pattern: str):
    """An encoder by merge ranks that cuts texts by ``pattern``; None for a vocabulary whose ids do not stand in the order of
    its merges, or that changes texts before or other than by that."""
    model, letters = spec["model"], byte_letters()
    marks = {t["content"]: t for t in spec.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in marks}
    splits = spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else list(m) for m in model.get("merges", [])]
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    fits = (
        model.get("type") == "BPE"
        and splits.get("type") == "ByteLevel"
        and not splits.get("add_prefix_space")
        and splits.get("use_regex", True)
        and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(m[k] for m in marks.values() for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and made == sorted(set(made))
        and len(vocabulary) == 256 + len(made)
        and all(x in letters for token in vocabulary for x in token)
    )
    if not fits:
        return None
    import tiktoken

    ranks = {bytes(letters[x] for x in token): i for token, i in vocabulary.items()}
    special = {content: t["id"] for content, t in marks.items()}
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class ByteBpe:
    """The tables of a vocabulary, and encoding with them.

    Inside, a single byte is numbered by its value, and what merge r makes is numbered 256 + r; so numbers stand in
    the order in which merges happen.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        vocabulary = model["vocab"]
        as_bytes = lambda token: bytes(letters[x] for x in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        number = {x: b for x, b in letters.items()} | {a + b: 256 + r for r, (a, b) in enumerate(pairs)}
        if len(number) != 256 + len(pairs):
            raise ValueError("two merges of this vocabulary make the same token")
        count = len(number)
        self.left, self.right = np.arange(count), np.arange(count)
        for r, (a, b) in enumerate(pairs):
            self.left[256 + r], self.right[256 + r] = number[a], number[b]
        keys = self.left[256:] << 32 | self.right[256:]
        order = np.argsort(keys)
        self.keys, self.made = keys[order], order + 256
        self.merge = {(int(a), int(b)): 256 + r for r, (a, b) in enumerate(zip(self.left[256:], self.right[256:]))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = np.array([vocabulary[x] for x in sorted(number, key=number.get)], np.uint32)
        texts = sorted(number, key=number.get)
        own = self._own()
        self.tokens = {as_bytes(x): k for k, x in enumerate(texts) if own[k]}
        # The longest token that starts with given bytes, so that few lengths have to be tried.
        self.longest: dict[bytes, int] = {}
        for token in self.tokens:
            start = token[:START]
            self.longest[start] = max(self.longest.get(start, 0), len(token))
        by_id = {int(self.ids[k]): as_bytes(x) for k, x in enumerate(texts)} | {i: t.encode() for t, i in self.special.items()}
        self.table = np.frombuffer(b"".join(by_id.values()), np.uint8)
        self.starts, self.lengths = np.zeros(max(by_id) + 1, np.int64), np.full(max(by_id) + 1, -1)
        self.lengths[list(by_id)] = [len(x) for x in by_id.values()]
        self.starts[list(by_id)] = np.cumsum(self.lengths[list(by_id)]) - self.lengths[list(by_id)]
        self.split = regex.compile(PATTERN)
        self.ranked = rank_encoder(spec, r"[^\x00]+|\x00")  # words of any kind, a zero character between them
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _made_by(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the merge of each pair makes; NEVER where the two do not merge."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], NEVER) if len(self.keys) else np.full(len(a), NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b stay apart when the bytes of both are merged together.

        The merges inside both are undone from the last to the first. At each moment the pieces that touch could
        merge; they would have if their merge came before the one that used up the left piece, or not after the one
        that used up the right piece, as of equal merges the left one comes first. ``before``: only merges before
        that one count.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if before is None else before.copy()
        fine, at = np.ones(len(a), bool), np.arange(len(a))
        while len(at):
            x, y = a[at], b[at]
            fine[at[self._made_by(x, y) < limit[at]]] = False
            at = at[fine[at] & (np.maximum(x, y) >= 256)]
            x, y = a[at], b[at]
            undo_left = x > y
            limit[at] = np.where(undo_left, x, y + 1)
            a[at], b[at] = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return fine

    def _own(self) -> np.ndarray:
        """Which tokens the merges really make of their own bytes."""
        made = np.arange(256, len(self.left))
        own = np.ones(len(self.left), bool)
        own[256:] = self.compatible(self.left[256:], self.right[256:], made)
        for k in range(256, len(own)):
            own[k] &= own[self.left[k]] and own[self.right[k]]
        return own

    def exact_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words that are merged exactly: by merge ranks, all words in one text with a zero character between
        them, where the vocabulary's ids stand in merge order; words with such a character go one by one."""
        if self.ranked is None or any("\0" in w for w in words):
            return [self.ids[self.exact(w.encode())].astype("<u4").tobytes() for w in words]
        ids = np.asarray(self.ranked.encode_to_numpy("\0".join(words) + "\0", disallowed_special=()), "<u4")
        cuts = np.flatnonzero(ids == self.ids[0]).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *(k + 1 for k in cuts)], cuts)]

    def propose(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        out, at, tokens, longest = [], 0, self.tokens, self.longest
        while at < len(word):
            end = at + longest.get(word[at : at + START], START - 1)
            while (piece := word[at:end]) not in tokens:
                end -= 1
            out.append(tokens[piece])
            at += len(piece)
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge by merge: always the first merge in order, the leftmost of its kind first."""
        token, get = list(word), self.merge.get
        if len(token) <= PLAIN:
            made = [get(pair, NEVER) for pair in zip(token, token[1:])]
            while made and (first := min(made)) < NEVER:
                i = made.index(first)
                token[i : i + 2] = [first]
                del made[i]
                if i:
                    made[i - 1] = get((token[i - 1], first), NEVER)
                if i < len(made):
                    made[i] = get((first, token[i + 1]), NEVER)
            return token
        after = [*range(1, len(token)), -1]
        before = list(range(-1, len(token) - 1))
        queue = [(m, i) for i in range(len(token) - 1) if (m := self.merge.get((token[i], token[i + 1])))]
        heapq.heapify(queue)
        while queue:
            made, i = heapq.heappop(queue)
            j = after[i] if token[i] >= 0 else -1
            if j < 0 or self.merge.get((token[i], token[j])) != made:
                continue
            token[i], token[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := self.merge.get((made, token[after[i]])):
                    heapq.heappush(queue, (m, i))
            if before[i] >= 0 and (m := self.merge.get((token[before[i]], made))):
                heapq.heappush(queue, (m, before[i]))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers: proposals, verified together, mended where needed."""
        data = [w.encode() for w in words]
        proposed = [self.propose(w) for w in data]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False  # the last token of a word has no neighbour
        at = np.flatnonzero(inner)
        pairs, back = np.unique(flat[at] << 32 | flat[at + 1], return_inverse=True)
        fails = at[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]
        whole, cuts = self.ids[flat].astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        out = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        failed = np.unique(np.searchsorted(ends, fails, side="right")).tolist()
        for k, ids in zip(failed, self.exact_ids([words[k] for k in failed])):
            out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        pieces: list[list[str]] = []
        for text in texts:
            if self.marks and "<" in text:
                parts = self.marks.split(text)
                pieces.append([x for k, p in enumerate(parts) for x in ([p] if k % 2 else self.split.findall(p))])
            else:
                pieces.append(self.split.findall(text))
        known, older = self.known, self.older
        new = [w for w in set(chain.from_iterable(pieces)) if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        self._learn([w for w in new if w not in known])
        get = known.__getitem__
        out = [b"".join(map(get, words)) for words in pieces]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w not in self.special]
        if plain:
            self.known.update(zip(plain, self.encode_words(plain)))
        for w in words:
            if w in self.special:
                self.known[w] = int(self.special[w]).to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        return self._bytes(np.frombuffer(ids, "<u4"))[0].tobytes().decode("utf-8", "replace")

    def _bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens, and where each token's end."""
        lengths = self.lengths[ids]
        if len(lengths) and lengths.min() < 0:
            raise ValueError("an id that the vocabulary does not have")
        ends = np.cumsum(lengths)
        # Of each byte its place within its token, and from there its place in the table of all tokens' bytes.
        from_table = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.table[from_table + np.arange(len(from_table))], ends

    def decode_cells(self, cells: list[bytes]) -> pa.Array:
        """The texts of cells of ids, decoded together; bytes that are no UTF-8 become replacement characters."""
        ids = np.frombuffer(b"".join(cells), "<u4")
        data, ends = self._bytes(ids)
        cuts = np.cumsum([0, *(len(x) // 4 for x in cells)])
        offsets = np.r_[0, ends][cuts]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        try:
            # If all is UTF-8 and no text begins within a character, every text is.
            if ((data[inner] & 0xC0) == 0x80).any():
                raise ValueError
            data.tobytes().decode("utf-8")
        except ValueError:
            return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in itertools.pairwise(offsets)], pa.string())
        return pa.StringArray.from_buffers(len(cells), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


#: Bytes of texts that are encoded together; a longer text is encoded by itself.
TOGETHER = 2 << 20


def _together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of cells of at most TOGETHER bytes, of which ``sizes`` has the sums; a larger cell by itself."""
    low = 0
    while low < len(sizes):
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + TOGETHER, "right")))
        yield low, high
        low = high


def encode_column(text: Column, path: str) -> Column:
    """The ids of a text, as little-endian unsigned 32-bit numbers in one binary cell; no ids for a missing text."""

    @F.arrow_udf("binary")
    def encode(cells: pa.Array) -> pa.Array:
        alone("bpe", vocabulary.cache_clear)
        bpe, out = vocabulary(path), []
        sizes = np.cumsum(pc.fill_null(pc.binary_length(cells), 0).to_numpy(zero_copy_only=False))
        for low, high in _together(sizes):
            out += bpe.encode([x or "" for x in cells.slice(low, high - low).to_pylist()])
        return pa.array(out, pa.binary())

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of a cell of ids; bytes that are no UTF-8 become replacement characters."""

    @F.arrow_udf("string")
    def decode(cells: pa.Array) -> pa.Array:
        alone("bpe", vocabulary.cache_clear)
        bpe, parts = vocabulary(path), [pa.array([], pa.string())]
        sizes = np.cumsum(pc.fill_null(pc.binary_length(cells), 0).to_numpy(zero_copy_only=False))
        for low, high in _together(sizes):
            parts.append(bpe.decode_cells([x or b"" for x in cells.slice(low, high - low).to_pylist()]))
        return pa.concat_arrays(parts)

    return decode(ids)


def encode_documents(df: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """Add the ids of each text under the vocabulary file at ``path``, which every executor must have.

    Whole texts are encoded, special tokens in them included, with no tokens added around them. A missing or empty
    text has no ids. Repeated rows stay. Other columns stay as they are; one named like the new column is replaced.
    """
    return df.withColumn(ids_column, encode_column(F.col(text_column), path))


def decode_documents(df: DataFrame, path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """Add the text of each cell of ids. A missing or empty cell gives an empty text."""
    return df.withColumn(text_column, decode_column(F.col(ids_column), path))
