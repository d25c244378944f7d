"""N-gram Jaccard join by T-occurrence search: short inverted lists are merged, long ones are probed."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import alone, components, keep, unused

#: Shingles that are known to be frequent, the most frequent first. They are only put last in the order in which lists
#: are looked at, so the bound changes speed, not results.
FREQUENT = 2**18
#: Shingles that are counted or listed together in a task, and words whose hash a worker remembers.
TOGETHER = 1_500_000
REMEMBERED = 300_000
#: Tokens that one bucket counts.
COUNTED = 2_000_000
#: Documents that are searched for, and searched through, in one cell.
BLOCK = 256
#: Bits of the filter that tells which documents may have candidates. A fixed size: 4 MB.
FILTER_BITS = 2**25

_known: dict[bytes, int] = {}


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct runs of ``width`` words, as sorted hashes.

    A-Z are lower-cased; words end at a blank or at tab to carriage return. A text with fewer words is one run; one
    without words has none.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    if len(_known) > REMEMBERED:
        _known.clear()
    for word in set(words).difference(_known):
        _known[word] = xxhash.xxh64_intdigest(word)
    hashes = np.array([_known[w] for w in words], np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ out >> np.uint64(29))


def class_of(tokens: np.ndarray) -> int:
    """What stands for all documents with this set."""
    return xxhash.xxh64_intdigest(tokens.tobytes(), seed=len(tokens)) - 2**63


def signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def needed(size: int, other: int, share: int) -> int:
    """The overlap from which two sets of these sizes are similar: 100 * overlap >= share * union."""
    return -(-share * (size + other) // (100 + share))


def short_lists(size: int, share: int) -> int:
    """How many of a set's lists have to be merged: a similar set is in at least one of that many, whichever they are."""
    return size - -(-share * size // 100) + 1


def similar(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    low, high = (a, b) if len(a) <= len(b) else (b, a)
    if not len(low) or 100 * len(low) < share * len(high):
        return False
    at = np.minimum(np.searchsorted(high, low), len(high) - 1)
    return int((high[at] == low).sum()) >= needed(len(low), len(high), share)


def _documents(width: int):
    """A row for each document with its set's size and class, and rows for shingles that several sets of a task have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def counted(kind: pa.DataType) -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            several = counts > 1
            n = int(several.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind), pa.array(counts[several]), pa.array(signed(tokens[several])), pa.array(np.ones(n, bool))],
                names=["id", "n_shingles", "class", "frequent"],
            )

        kind = pa.int64()
        alone("jaccard", _known.clear)
        for batch in batches:
            kind = batch.schema.field(0).type
            sizes, classes = [], []
            for cell in batch.column(1):
                tokens = shingles(cell.as_py() or "", width)
                own = class_of(tokens)
                sizes.append(len(tokens))
                classes.append(own)
                if own not in seen:
                    seen.add(own)
                    held.append(tokens)
                    size += len(tokens)
                if size > TOGETHER:
                    yield counted(kind)
                    held, size = [], 0
                    seen.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(np.zeros(len(sizes), bool))],
                names=["id", "n_shingles", "class", "frequent"],
            )
        if held:
            yield counted(kind)

    return run


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(data: bytes, kinds: str) -> list[np.ndarray]:
    names = kinds.split()
    data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 4 * len(names), []
    for size, kind in zip(np.frombuffer(data, "<u4", len(names)).tolist(), names):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


#: Rows between the steps: where they go, what they hold, and the packed numbers.
STEP = "at long, kind string, data binary"
#: Gaps between sorted tokens, whose they are, and of each class its name, size and number of tokens not known as
#: frequent.
TOKENS = "u8 u4 i8 u4 u4"
#: Of each entry its class, the class's size and number of tokens as above, the token and how many classes have it.
SEVERAL = "i8 u4 u4 u8 u4"
#: Entries of lists, and ties.
ENTRIES, TIES = "u8 u4 i8", "i8 i8"


def step_row(at: int, kind: str, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([at], pa.int64()), pa.array([kind]), pa.array([data], pa.binary())], names=["at", "kind", "data"]
    )


def _spread(width: int, share: int, frequent, buckets: int):
    """Sends every token that is not known as frequent to the bucket that counts it; a bucket is a range of tokens.

    Known frequent tokens come last in the order of a class. Where its short lists reach that far, their entries are
    made here: of several entries of a token in a task the first goes on, and the others are tied to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        alone("jaccard", _known.clear)
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = np.array([h[0] for h in held], np.int64)
            sizes = np.array([h[1] for h in held], "<u4")
            rest = np.array([len(h[2]) for h in held], "<u4")
            tokens = np.concatenate([h[2] for h in held])
            owner = np.repeat(np.arange(len(held)), rest)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            bucket = (tokens >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(tokens)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    there, number = np.unique(owner[a:b], return_inverse=True)
                    gaps = np.diff(tokens[a:b], prepend=np.uint64(0))
                    data = packed(gaps, number.astype("<u4"), names[there], sizes[there], rest[there])
                    yield step_row(int(bucket[a]), "tokens", data)
            late = [h[3] for h in held]
            if not sum(map(len, late)):
                return
            tokens = np.concatenate(late)
            classes = np.repeat(names, [len(x) for x in late])
            place = np.concatenate([r + np.arange(len(x), dtype=np.uint32) for r, x in zip(rest, late)])
            order = np.lexsort((classes, place, tokens))
            tokens, classes, place = tokens[order], classes[order], place[order].astype("<u4")
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            leader = classes[first][np.cumsum(first) - 1]
            pairs = np.unique(np.column_stack([classes[~first], leader[~first]]), axis=0)
            at = int(names[0] % buckets)
            yield step_row(at, "entries", packed(tokens[first], place[first], classes[first]))
            yield step_row(at, "ties", packed(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])))

        for batch in batches:
            for cell in batch.column(0):
                tokens = shingles(cell.as_py() or "", width)
                own = class_of(tokens)
                if not len(tokens) or own in seen:
                    continue
                seen.add(own)
                often = np.zeros(len(tokens), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    often = np.where(known[at] == tokens, counts[at], 0)
                rest, late = tokens[often == 0], tokens[:0]
                reach = short_lists(len(tokens), share) - len(rest)
                if reach > 0:
                    late, often = tokens[often > 0], often[often > 0]
                    late = late[np.lexsort((late, often))[:reach]]
                held.append((own, len(tokens), rest, late))
                size += len(rest) + len(late)
                if size > TOGETHER:
                    yield from flush()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield from flush()

    return run


def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list[bytes]]]]:
    """The rows of a step, which come sorted, by where they went: their data by kind."""
    rows = (r for batch in batches for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist())
    for at, group in groupby(rows, key=lambda r: r["at"]):
        out = defaultdict(list)
        for r in group:
            out[r["kind"]].append(r["data"])
        yield at, out


def _several(groups: int):
    """Counts the tokens of a bucket, and sends those that several classes have to the groups of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, told in by_place(batches):
            for kind in ("entries", "ties"):
                for data in told[kind]:
                    yield step_row(at % groups, kind, data)
            parts = []
            for data in told["tokens"]:
                gaps, number, names, sizes, rest = unpacked(data, TOKENS)
                parts.append((np.cumsum(gaps, dtype=np.uint64), names[number], sizes[number], rest[number]))
            if not parts:
                continue
            tokens, names, sizes, rest = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((names, tokens))
            tokens, names, sizes, rest = tokens[order], names[order], sizes[order], rest[order]
            new = np.ones(len(tokens), bool)
            new[1:] = tokens[1:] != tokens[:-1]
            once = new.copy()
            once[1:] |= names[1:] != names[:-1]  # copies of a class in other tasks count once
            tokens, names, sizes, rest, new = tokens[once], names[once], sizes[once], rest[once], new[once]
            count = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]
            rows = np.flatnonzero(count > 1)
            group = names[rows] % groups
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    r = rows[a:b]
                    yield step_row(int(group[a]), "several", packed(names[r], sizes[r], rest[r], tokens[r], count[r].astype("<u4")))

    return run


POSTINGS = "token long, place int, class long, leader long"


def _entered(share: int):
    """Puts the tokens of each class in order, those that no other class has first, and enters the short lists."""

    def rows(tokens: np.ndarray, place: np.ndarray, names: np.ndarray, leader: np.ndarray | None) -> pa.RecordBatch:
        told = pa.nulls(len(names), pa.int64()) if leader is None else pa.array(leader)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(tokens)), pa.array(place.astype(np.int32)), pa.array(names), told],
            names=["token", "place", "class", "leader"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, told in by_place(batches):
            for data in told["entries"]:
                yield rows(*unpacked(data, ENTRIES), None)
            for data in told["ties"]:
                names, leader = unpacked(data, TIES)
                yield rows(names.view(np.uint64), np.zeros(len(names)), names, leader)
            if not told["several"]:
                continue
            names, sizes, rest, tokens, count = (
                np.concatenate(x) for x in zip(*(unpacked(d, SEVERAL) for d in told["several"]))
            )
            order = np.lexsort((tokens, count, names))
            names, sizes, rest, tokens = names[order], sizes[order].astype(np.int64), rest[order].astype(np.int64), tokens[order]
            new = np.ones(len(names), bool)
            new[1:] = names[1:] != names[:-1]
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            shared = np.diff(np.append(np.flatnonzero(new), len(names)))[np.cumsum(new) - 1]
            place = rest - shared + np.arange(len(names)) - start
            short = sizes - -(-share * sizes // 100) + 1
            at = place < short
            yield rows(tokens[at], place[at], names[at], None)

    return run


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties the entries of each list, which come sorted by token and place, to the first entry of the list."""
    token = leader = None
    for batch in batches:
        tokens, classes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        told = batch.column(3)
        is_told = told.is_valid().to_numpy(zero_copy_only=False)
        own = ~is_told
        at = np.flatnonzero(own)
        a, b = [], []
        if len(at):
            t, c = tokens[at], classes[at]
            first = np.ones(len(t), bool)
            first[1:] = t[1:] != t[:-1]
            if token is not None and t[0] == token:
                first[0] = False
            lead = np.empty(len(t), np.int64)
            group = np.cumsum(first) - 1
            starts = c[first]
            lead[group >= 0] = starts[group[group >= 0]]
            lead[group < 0] = leader if leader is not None else 0
            token, leader = t[-1], lead[-1]
            other = ~first & (lead != c)
            a, b = [c[other]], [lead[other]]
        a.append(classes[is_told])
        b.append(told.filter(told.is_valid()).to_numpy())
        pairs = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value's hash place, FILTER_BITS of them whatever the size of ``df``."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = df.select(at.alias("at")).selectExpr("cast(at div 32 as int) as word", "shiftleft(1L, cast(at % 32 as int)) as bit")
    # At most FILTER_BITS / 32 rows.
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.int64)
    out[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64)
    return out.astype(np.uint32)


SETS = "class long, tokens binary"


def _sets(width: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("jaccard", _known.clear)
        for batch in batches:
            classes, sets = [], []
            for cell in batch.column(0):
                tokens = shingles(cell.as_py() or "", width)
                own = class_of(tokens)
                at = own % FILTER_BITS
                if len(tokens) and int(bits.value[at // 32]) >> (at % 32) & 1:
                    classes.append(own)
                    sets.append(tokens.tobytes())
            if classes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names=["class", "tokens"]
                )

    return run


class TOccurrence:
    """Inverted lists over some sets, searched for the sets that share enough tokens with a query (DivideSkip).

    A query's lists are put in order of length. The T - 1 longest are left out of the merge, where T is the least
    overlap that any similar set has; whoever is similar still turns up in one of the others. These short lists are
    merged with a heap, which counts how often each set turns up, and then the long lists are probed for those sets by
    binary search.
    """

    def __init__(self, sets: list[np.ndarray], share: int) -> None:
        self.sizes, self.share = [len(s) for s in sets], share
        self.lists: dict[int, list[int]] = defaultdict(list)
        for k, tokens in enumerate(sets):
            for token in tokens.tolist():
                self.lists[token].append(k)

    def search(self, query: np.ndarray) -> list[int]:
        if not len(query):
            return []
        lists = sorted((self.lists[t] for t in query.tolist() if t in self.lists), key=len)
        missing = len(query) - len(lists)
        short = max(0, short_lists(len(query), self.share) - missing)
        merged, probed = lists[:short], lists[short:]
        found = []
        for k, copies in groupby(heapq.merge(*merged)):
            size = self.sizes[k]
            if 100 * min(size, len(query)) < self.share * max(size, len(query)):
                continue
            need = needed(len(query), size, self.share) - sum(1 for _ in copies)
            left = len(probed)
            for members in probed:
                if need <= 0 or need > left:
                    break
                left -= 1
                at = bisect_left(members, k)
                need -= at < len(members) and members[at] == k
            if need <= 0:
                found.append(k)
        return found


def _searched(share: int):
    """Searches each cell, whose rows come together: its queries among its other sets. Yields what ties them together."""

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        sets = [(r["class"], np.frombuffer(r["tokens"], np.uint64)) for r in rows if not r["query"]]
        index = TOccurrence([t for _, t in sets], share)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for r in rows:
            if r["query"]:
                for k in index.search(np.frombuffer(r["tokens"], np.uint64)):
                    a, b = find(r["class"]), find(sets[k][0])
                    root[max(a, b)] = min(a, b)
        return [(x, find(x)) for x in list(root) if find(x) != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for low in range(0, len(batch), 256):
                    yield from batch.slice(low, 256).to_pylist()

        for _, cell in groupby(rows(), key=lambda r: (r["component"], r["i"], r["j"])):
            if found := links(list(cell)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"]
                )

    return run


def jaccard_components(
    df: DataFrame,
    width: int = 5,
    share: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Documents whose sets of ``width``-word shingles have 100 * intersection >= share * union are linked.

    One row per row of ``df``: the id, n_shingles, and component_id, the smallest id that links reach, itself included.

    A missing or empty text, or one of white space, has no shingles and is linked with nothing; a text with fewer
    words than ``width`` has one shingle. Rows with equal sets are linked. Rows without an id link like others; a
    component of such rows has no id. An empty table gives an empty result. Other columns are not looked at.

    1. Rows with the same set form a class, and only classes go on.
    2. Tokens are counted over all classes, and each class enters its rarest lists, as many as T-occurrence needs: two
       similar sets meet in at least one. Tokens that no other class has fill most of these places, and lists of one
       are not made. The entries of a list are tied to one of them, so a list of any length gives as many ties, never
       its pairs. Ties put all that may be similar into one candidate group. Tokens that are frequent in a single task
       are known beforehand; in each task only one entry for them is sent on.
    3. Of each group the set that most lists chose is compared with all others.
    4. What is not similar to it is searched for in the whole group, in cells of bounded size, by DivideSkip.
    Links of 3 and 4 give the components.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    told = texts.mapInArrow(_documents(width), f"id {kind}, n_shingles long, class long, frequent boolean")
    told = keep(told, "classes")
    often = told.where("frequent").groupBy("class").agg(F.sum("n_shingles").alias("n"))
    # FREQUENT rows at most.
    top = often.orderBy(F.desc("n"), "class").limit(FREQUENT).toPandas()
    tokens = top["class"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], top["n"].to_numpy(np.int64)[order]))
    total = told.where("not frequent").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // COUNTED))
    entries = texts.select("text").mapInArrow(_spread(width, share, frequent, buckets), STEP)
    for step, schema in ((_several(buckets), STEP), (_entered(share), POSTINGS)):
        entries = entries.repartition("at").sortWithinPartitions("at").mapInArrow(step, schema)
    entries = entries.repartition("token").sortWithinPartitions("token", "place", "class")
    ties = keep(entries.mapInArrow(_tied, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n")), "ties")
    groups = components(ties)
    chosen = ties.groupBy(F.col("b").alias("id")).agg(F.sum("n").alias("n"))
    groups = groups.withColumnRenamed("component_id", "component").join(chosen, "id", "left")
    groups = keep(groups.select(F.col("id").alias("class"), "component", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    hubs = groups.groupBy("component").agg(F.max(F.struct("n", "class")).alias("hub"), F.count("*").alias("members"))
    hubs = keep(hubs.select("component", F.col("hub.class").alias("hub"), "members"), "hubs")
    bits = spark.sparkContext.broadcast(bit_filter(groups, "class"))
    sets = texts.select("text").mapInArrow(_sets(width, bits), SETS).groupBy("class").agg(F.first("tokens").alias("tokens"))
    sets = keep(sets.join(groups.select("class", "component"), "class"), "sets")

    @F.arrow_udf("boolean")
    def same(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = ((np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(left, right))
        return pa.array((similar(a, b, share) for a, b in pairs), pa.bool_())

    hub_sets = keep(
        hubs.join(sets.select(F.col("class").alias("hub"), F.col("tokens").alias("hub_tokens")), "hub"), "hub-sets"
    )
    compared = sets.join(hub_sets, "component").select(
        "class", "component", "hub", "members",
        F.when(F.col("class") == F.col("hub"), True).otherwise(same("tokens", "hub_tokens")).alias("linked"),
    )
    compared = keep(compared, "compared")
    links = compared.where("linked and class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    # Whoever is not linked with the hub is searched for among all of the group but the hub.
    open_groups = compared.where("not linked").groupBy("component").agg(F.count("*").alias("queries"), F.first("members").alias("members"))
    open_groups = keep(open_groups.where("members > 2"), "open")
    rows, columns = F.ceil(F.col("queries") / BLOCK).cast("int"), F.ceil(F.col("members") / BLOCK).cast("int")
    within = compared.select("class", "component", "linked").join(open_groups, "component")
    asked = within.where("not linked").select(
        "class", "component", F.lit(True).alias("query"),
        F.pmod(F.xxhash64("class", F.lit(1)), rows).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), columns - 1)).alias("j"),
    )
    among = within.select(
        "class", "component", F.lit(False).alias("query"),
        F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"),
        F.pmod(F.xxhash64("class", F.lit(2)), columns).cast("int").alias("j"),
    )
    cells = asked.unionByName(among).join(sets.select("class", "tokens"), "class")
    cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "query", "class")
    more = cells.select("component", "i", "j", "query", "class", "tokens").mapInArrow(_searched(share), "a long, b long")
    found = components(keep(links.unionByName(more), "links"))
    rows = told.where("not frequent").select("id", "n_shingles", "class")
    rows = rows.join(found.select(F.col("id").alias("class"), F.col("component_id").alias("component")), "class", "left")
    alone = F.when(F.col("n_shingles") > 0, F.coalesce("component", "class"))
    rows = keep(rows.select("id", "n_shingles", alone.alias("component")), "rows")
    least = keep(rows.where("component is not null").groupBy("component").agg(F.min("id").alias("least")), "least")
    return rows.join(least, "component", "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )


def near_dedup(
    df: DataFrame, width: int = 5, share: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``df`` without near-duplicates, with their columns: of each component the row with the smallest id.

    See ``jaccard_components`` for what is linked. Rows without an id stay only where no row of their component has
    one; of rows with the same id one stays. Texts without words are all kept.
    """
    row = unused(df, "_row")
    marked = keep(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard_components(marked, width, share, row, text_column)
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    named = found.join(marked.select(F.col(row).alias("row"), F.col(id_column).alias("id")), "row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    best = keep(named.groupBy("component").agg(first).select(F.col("first.row").alias(row)), "best")
    return marked.join(best, row, "left_semi").select(*df.columns)
