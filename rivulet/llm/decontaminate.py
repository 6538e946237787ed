"""Benchmark decontamination with suffix arrays over the training text.

Each Arrow batch of documents is a shard: its words, as numbers of the benchmark's vocabulary, get a suffix array, in which
every test suffix is binary-searched. Between two neighbouring test suffixes lie the shard's suffixes whose longest match is
with one of the two, so the searches tell the longest verbatim match at every word. Words that no test item holds are number 0;
suffixes that begin with one can't match and aren't in the array. The test items are the query set: they go to the tasks in
blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import binary_parts, limit_batches, utf8

#: Bytes to words: A-Z lower-cased; every other ASCII byte that is no digit or letter separates.
WORD_BYTES = bytes((b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32) for b in range(256))
#: Text bytes of a block of test items; a larger benchmark goes to the tasks in several blocks, each broadcast on its own.
#: A block takes BUILT bytes a word and its distinct words, so some 30 MB, and 150 MB where all words have one letter.
BLOCK_BYTES, BUILT = 4 << 20, 64
#: Bits of a word's number: 16 where the vocabulary allows it. A key is as many words as fit into 64 bits.
BITS = 16
RESULT = "n_words long, n_hit long, items array<string>, longest_match long, longest_item string, longest_at long"


def packed(ids: np.ndarray, bits: int) -> np.ndarray:
    """Key of each position: its word and the next ones, 64 // bits of them, most significant first."""
    step = 64 // bits
    x = np.concatenate([ids, np.zeros(step, ids.dtype)]).astype(np.uint64)
    out = np.zeros(len(ids), np.uint64)
    for j in range(step):
        out |= x[j : j + len(ids)] << np.uint64(bits * (step - 1 - j))
    return out


def first_words(keys: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Mask of the first n words of keys (none for n below 1, all of them for as many as fit or more)."""
    step = 64 // bits
    return np.array([((1 << 64) - 1) ^ ((1 << bits * (step - v)) - 1) for v in range(step + 1)], np.uint64)[np.clip(n, 0, step)]


def joined(levels: list[np.ndarray]) -> np.ndarray:
    """Keys of several levels as bytes that sort as they do."""
    wide = np.stack(levels, axis=1).astype(">u8")
    return np.frombuffer(wide.tobytes(), f"S{8 * len(levels)}") if len(wide) else np.empty(0, f"S{8 * len(levels)}")


def same_words(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Number of equal words at the beginning of keys."""
    x = a ^ b
    out = (x == 0).astype(np.int64)
    for j in range(1, 64 // bits):
        out += x < np.uint64(1 << (64 - bits * j))
    return out


class Block:
    """Some test items: vocabulary, suffix array, and the items that hold each window."""

    def __init__(self, rows: list[tuple[str | None, bytes]], window: int):
        self.window, self.vocab = window, {}
        self.names = sorted({"" if i is None else str(i) for i, _ in rows})
        rank, flat, owner, short = {n: k for k, n in enumerate(self.names)}, [], [], {}
        for i, text in rows:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in text.translate(WORD_BYTES).split()]
            own = rank["" if i is None else str(i)]
            flat += [*ids, 0]
            owner += [own] * (len(ids) + 1)
            if 0 < len(ids) < window:
                short.setdefault(tuple(ids), set()).add(own)
        self.bits = BITS if len(self.vocab) < (1 << BITS) - 1 else 32
        self.step = 64 // self.bits
        self.levels = -(-window // self.step)
        self.depth = self.levels * self.step
        self.ids = np.array(flat, np.uint32)
        left = left_of(self.ids)
        order = self._sorted()
        order = order[self.ids[order] > 0]
        keys = np.concatenate([packed(self.ids, self.bits), np.zeros(self.depth, np.uint64)])
        self.order, self.item = order.astype(np.int32), np.array(owner, np.int32)[order]
        levels = [keys[order + self.step * k] & first_words(keys, left[order] - self.step * k, self.bits) for k in range(self.levels)]
        self.first, self.bytes = levels[0] if levels else np.empty(0, np.uint64), joined(levels)
        self._windows(left[order], levels, short)

    def _sorted(self) -> np.ndarray:
        """Suffix array by prefix doubling; each item's end is a word of its own, smaller than the others."""
        n, ends = len(self.ids), self.ids == 0
        rank = np.where(ends, np.cumsum(ends), self.ids.astype(np.int64) + int(ends.sum()))
        size = 1
        while True:
            after = np.concatenate([rank[size:], np.zeros(min(size, n), np.int64)])
            key = rank * (int(rank.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], key[order][1:] != key[order][:-1]])[:n])
            if not n or rank.max() == n:
                return order
            size *= 2

    def _windows(self, left: np.ndarray, levels: list[np.ndarray], short: dict[tuple[int, ...], set[int]]) -> None:
        """group: number of the owner set of each suffix's window (-1: too short for one); sets: the owner sets, as ranks of
        item names. Windows with the same items share a set. short: items that are one window each."""
        self.group, self.sets = np.full(len(left), -1, np.int32), []
        known: dict[bytes, int] = {}

        def number(owners: np.ndarray) -> int:
            k = known.setdefault(owners.tobytes(), len(self.sets))
            if k == len(self.sets):
                self.sets.append(owners)
            return k

        at = np.flatnonzero(left >= self.window)
        if len(at):
            cut = [x[at] & first_words(x, np.full(len(at), self.window - self.step * k), self.bits) for k, x in enumerate(levels)]
            new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in cut], axis=0)])
            begin = np.flatnonzero(new)
            numbers = [number(np.unique(self.item[at[b:e]])) for b, e in zip(begin.tolist(), np.append(begin[1:], len(at)).tolist())]
            self.group[at] = np.repeat(np.array(numbers, np.int32), np.diff(np.append(begin, len(at))))
        self.short = [(np.array(w, np.uint32), number(np.array(sorted(own), np.int32))) for w, own in short.items()]

    def size(self) -> int:
        """Bytes of the arrays."""
        return sum(x.nbytes for x in (self.ids, self.order, self.item, self.first, self.bytes, self.group, *self.sets))


def left_of(ids: np.ndarray) -> np.ndarray:
    """Words from each position to the next 0."""
    at = np.arange(len(ids))
    return np.minimum.accumulate(np.where(ids == 0, at, len(ids))[::-1])[::-1] - at


def suffix_array(keys: np.ndarray, starts: np.ndarray, step: int, levels: int) -> np.ndarray:
    """starts sorted by keys[start], keys[start + step], ... (levels of them)."""
    order = starts[np.argsort(keys[starts])]
    first = keys[order]
    tied = np.concatenate([[False], first[1:] == first[:-1]])
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    if levels > 1 and len(at):
        rows = order[at]
        group = np.cumsum(np.concatenate([[True], first[at][1:] != first[at][:-1]]))
        order[at] = rows[np.lexsort((*[keys[rows + step * k] for k in range(levels - 1, 0, -1)], group))]
    return order


class Shard:
    """Words of some documents with their suffix array, searched for a block's suffixes."""

    def __init__(self, block: Block, words: list[list[bytes]]):
        self.block, sizes = block, np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 between documents
        self.sizes = sizes
        self.ids = np.zeros(int(self.starts[-1]) + block.depth + 1, np.uint64)
        get = block.vocab.get
        for k, doc in enumerate(words):
            self.ids[self.starts[k] : self.starts[k] + sizes[k]] = np.fromiter(map(get, doc, repeat(0)), np.uint64, len(doc))
        self.keys = packed(self.ids, block.bits)
        self.order = suffix_array(self.keys, np.flatnonzero(self.ids), block.step, block.levels)
        self.first = self.keys[self.order]

    def level(self, positions: np.ndarray, k: int) -> np.ndarray:
        return self.keys[positions + self.block.step * k]

    def search(self) -> np.ndarray:
        """Place in the array of every test suffix: the number of the shard's suffixes below it."""
        block = self.block
        begin, end = np.searchsorted(self.first, block.first, "left"), np.searchsorted(self.first, block.first, "right")
        hit = np.flatnonzero(end > begin)
        if not len(hit):
            return begin
        starts = np.unique(begin[hit], return_index=True)
        cover = np.zeros(len(self.order) + 1, np.int64)
        np.add.at(cover, starts[0], 1)
        np.add.at(cover, end[hit][starts[1]], -1)
        inside = np.flatnonzero(np.cumsum(cover)[:-1])  # the shard's suffixes that begin as some test suffix
        deep = joined([self.level(self.order[inside], k) for k in range(block.levels)])
        begin[hit] += np.searchsorted(deep, block.bytes[hit], "left") - np.searchsorted(inside, begin[hit])
        return begin

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of the array: words that it shares with the nearest test suffix (up to the depth), and which one that is."""
        block, n = self.block, len(self.order)
        after = np.cumsum(np.bincount(self.search(), minlength=n + 1))[:n]  # the first test suffix above each
        best, which = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for test in (after - 1, after):
            ok = np.flatnonzero((test >= 0) & (test < len(block.order)))
            common = same_words(self.first[ok], block.first[test[ok]], block.bits)
            full = np.flatnonzero(common == block.step)
            if block.levels > 1 and len(full):
                deep = np.frombuffer(block.bytes[test[ok[full]]].tobytes(), ">u8").reshape(len(full), -1)
                for k in range(1, block.levels):
                    common[full] += same_words(self.level(self.order[ok[full]], k), deep[:, k].astype(np.uint64), block.bits)
                    on = common[full] == block.step * (k + 1)
                    full, deep = full[on], deep[on]
            better = common > best[ok]
            best[ok[better]], which[ok[better]] = common[better], test[ok[better]]
        return np.minimum(best, left_of(self.ids)[self.order]), which

    def within(self, positions: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the test suffixes that share the first n (up to the depth) words with each position."""
        block = self.block
        masks = [first_words(self.keys, n - block.step * k, block.bits) for k in range(block.levels)]
        low = [self.level(positions, k) & m for k, m in enumerate(masks)]
        return np.searchsorted(block.bytes, joined(low), "left"), np.searchsorted(block.bytes, joined([x | ~m for x, m in zip(low, masks)]), "right")

    def extended(self, at: int) -> tuple[int, int]:
        """Length of the longest match at a position that has one of the depth's length, and the first item that has it."""
        block, n = self.block, self.block.depth
        lo, hi = (int(x[0]) for x in self.within(np.array([at]), np.array([n])))
        while self.ids[at + n]:
            column = block.ids[block.order[lo:hi] + n]
            b, e = np.searchsorted(column, [self.ids[at + n], self.ids[at + n] + np.uint64(1)])
            if b == e:
                break
            lo, hi, n = lo + int(b), lo + int(e), n + 1
        return n, int(block.item[lo:hi].min())

    def longest(self, words: np.ndarray) -> list[tuple[int, str | None, int | None]]:
        """Longest match of each document: words, item (the first by name), position (the first). words: of each position."""
        block, out = self.block, [(0, None, None)] * len(self.sizes)
        most = np.maximum.reduceat(words[: self.starts[-1]], self.starts[:-1]) if len(self.sizes) else np.empty(0, np.int64)
        document = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        at = np.flatnonzero((words[: len(document)] == most[document]) & (words[: len(document)] > 0))
        docs, place = np.unique(document[at], return_index=True)
        at = at[place]
        low, high = self.within(at, most[docs])
        for d, p, lo, hi in zip(docs.tolist(), at.tolist(), low.tolist(), high.tolist()):
            if most[d] < block.depth:
                out[d] = (int(most[d]), block.names[int(block.item[lo:hi].min())], p - int(self.starts[d]))
        for d in docs[most[docs] >= block.depth].tolist():
            full = np.flatnonzero(words[self.starts[d] : self.starts[d + 1]] >= block.depth) + int(self.starts[d])
            best = (0, 0, 0)
            for run in np.split(full, np.flatnonzero(np.diff(full) > 1) + 1):
                for p in run.tolist():
                    bound = int(run[-1]) - p + block.depth  # a longer match would have made the run longer
                    if bound <= best[0]:
                        break
                    n, item = self.extended(p)
                    if n > best[0]:
                        best = (n, item, p)
            out[d] = (best[0], block.names[best[1]], best[2] - int(self.starts[d]))
        return out


def search(block: Block, words: list[list[bytes]]) -> list[tuple[np.ndarray | None, set[str], tuple[int, str | None, int | None]]]:
    """For each document: mask of hit words (None: none), items with occurring windows, and the longest match (words, item, position)."""
    nothing = [(None, set(), (0, None, None))] * len(words)
    if not len(block.order):
        return nothing
    shard = Shard(block, words)
    if not len(shard.order):
        return nothing
    best, which = shard.matches()
    length = np.zeros(len(shard.ids), np.int64)
    length[shard.order] = best
    marks = np.zeros(len(shard.ids) + 1, np.int64)
    hit = np.flatnonzero(best >= block.window)
    found = [(shard.order[hit], block.group[which[hit]])]
    marks[shard.order[hit]] += 1
    np.add.at(marks, shard.order[hit] + block.window, -1)
    for ids, owners in block.short:
        at = occurrences(shard, ids)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + len(ids), -1)
        found.append((at, np.full(len(at), owners, np.int32)))
    at, sets = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(np.stack([np.searchsorted(shard.starts, at, "right") - 1, sets], axis=1), axis=0)  # one a document and owner set
    items: dict[int, set[str]] = {}
    for d, k in pairs.tolist():
        items.setdefault(d, set()).update(block.names[i] for i in block.sets[k].tolist())
    mask, longest = np.cumsum(marks[:-1]) > 0, shard.longest(length)
    return [(mask[shard.starts[d] : shard.starts[d] + shard.sizes[d]] if d in items else None, items.get(d, set()), longest[d]) for d in range(len(words))]


def occurrences(shard: Shard, ids: np.ndarray) -> np.ndarray:
    """Positions of a short window."""
    block = shard.block
    low = np.zeros(block.depth, np.uint64)
    low[: len(ids)] = ids
    high = low.copy()
    high[len(ids) :] = (1 << block.bits) - 1
    b, e = 0, len(shard.order)
    for k in range(-(-len(ids) // block.step)):
        part = shard.first[b:e] if k == 0 else shard.level(shard.order[b:e], k)
        x, y = (packed(w[block.step * k : block.step * (k + 1)], block.bits)[0] for w in (low, high))
        b, e = b + int(np.searchsorted(part, x, "left")), b + int(np.searchsorted(part, y, "right"))
        if b == e:
            break
    return shard.order[b:e]


def blocks_of(rows: Iterable[tuple[str | None, bytes]], window: int, limit: int) -> Iterator[Block]:
    """Test items in blocks of at most `limit` text bytes (a longer item is a block of its own)."""
    held: list[tuple[str | None, bytes]] = []
    size = 0
    for row in rows:
        if held and size + len(row[1]) > limit:
            yield Block(held, window)
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield Block(held, window)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out: str = "decontamination", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of docs plus a struct column `out`: n_words, n_hit, items (distinct ids as strings, sorted), and the
    longest verbatim match of any length (words, item, word position): of equal ones the first in the document, and of items
    that have that one the first by name. Without a common word it is 0 words, null, null.

    A word is hit if it lies in any occurrence of a window of an item: `window` consecutive words, or the whole of a shorter
    item; items without words have no window. Null texts have no words. A null item id counts as the empty string; repeated
    items count once. A column of docs that is named like `out` is replaced. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    limit_batches(spark, 4 << 20)
    rows = ((r[0], bytes(r[1])) for r in benchmark.select(F.col(item_col).cast("string"), utf8(item_text)).toLocalIterator())
    shared = [spark.sparkContext.broadcast(b) for b in blocks_of(rows, window, block_bytes)]
    docs = docs.drop(out)
    result = T._parse_datatype_string(RESULT)
    work = docs.withColumn(out, utf8(text_col))
    names = work.columns
    types = {f.name: f.dataType for f in T._parse_datatype_string(RESULT).fields}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = binary_parts(batch.column(batch.num_columns - 1))
            text = bytes(values[int(at[0]) : int(at[-1])]).translate(WORD_BYTES)
            base = int(at[0])
            words = [text[int(a) - base : int(b) - base].split() for a, b in zip(at, at[1:])]
            hits: list = [None] * len(words)
            items: list[set[str]] = [set() for _ in words]
            best: list[tuple] = [(0, None, None)] * len(words)
            for one in shared:
                block = one.value
                for k, (mask, own, longest) in enumerate(search(block, words)):
                    if mask is not None:
                        hits[k] = mask if hits[k] is None else hits[k] | mask
                        items[k] |= own
                    if longest[0]:
                        best[k] = min(best[k], longest, key=lambda x: (-x[0], x[2] or 0, x[1] or ""))
                if len(shared) > 1:
                    one.__dict__.pop("_value", None)  # the next block takes its place
            column = pa.StructArray.from_arrays(
                [
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([0 if h is None else int(h.sum()) for h in hits], pa.int64()),
                    pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                    pa.array([b[0] for b in best], pa.int64()),
                    pa.array([b[1] for b in best], pa.string()),
                    pa.array([b[2] for b in best], pa.int64()),
                ],
                names=list(types),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=names)

    return work.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, result)]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents without those that hold a window of the benchmark; columns as in docs."""
    out = "__decontamination"
    return annotate(docs, benchmark, out=out, **options).where(F.col(f"{out}.n_hit") == 0).drop(out)


def items_digest(items: "F.Column") -> "F.Column":
    return F.sha2(F.concat_ws(",", items), 256)

