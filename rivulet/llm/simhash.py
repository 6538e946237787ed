"""SimHash near-dedup: pigeonhole blocks over 64-bit fingerprints, Hamming check, connected components.

Fingerprints are cut into m bands; two that differ in k bits agree on at least m - k of them, so they meet under one of the
C(m, m - k) choices of bands. Only distinct fingerprints are compared. Inside a bucket, links are found without emitting pairs:
each task joins what it compares and emits one edge a fingerprint, to the smallest one it is linked with.

near_duplicates, the pipeline's stage, is for a similarity of shingle sets that differs in too many bits for whole pigeonholes:
wider fingerprints are cut into more and wider blocks the more documents there are, pairs that share a block and stay within a
Hamming distance are candidates, and an exact check of the shingle sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import limit_batches, maybe_in, utf8, written

SEED = 42
#: Bucket size up to which all pairs are compared at once; larger ones go by pivots.
SMALL = 48
#: Bucket size from which a bucket is dealt to several tasks.
SPLIT = 1 << 20
#: One node in so many tells which buckets those are.
SEEN = 64
#: Edges of a file between two rounds of the components, and up to which one task joins them in memory (4 MB).
EDGES, FEW = 500_000, 250_000
#: 64-bit lanes of the fingerprints that are cut into blocks; random fingerprints that may share a bucket; share of the pairs at
#: the similarity that is to meet in a block; and the share that may be lost to the Hamming distance.
LANES, RANDOM, RECALL, LOST = 16, 64, 0.99, 0.001
#: Bits of a fingerprint that its rows carry, and steps of the logarithm of the set's size to the base 1 / similarity.
CARRIED, STEPS = 120, 4
#: Bucket size up to which a bucket's pairs are compared by shifts; larger ones are kept whole.
SHIFTED = 512
#: Rounds in which each text is checked with its nearest one of another component, and rows that it is compared with for that.
ROUNDS, WINDOW = 2, 64
#: Texts and shingles of a block of texts that are checked in one task with each other and with one other block's.
BLOCK, BLOCK_SHINGLES = 256, 250_000
#: Bucket size from which a bucket's pairs are listed in several tasks.
PAIRED = 2048


def lanes_of(h: np.ndarray, lanes: int) -> np.ndarray:
    """Hash x lane: 64 bits a lane, each a mix of the hash; lane 0 is the hash itself."""
    if lanes == 1:
        return h[:, None]
    x = h[:, None] + np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = h
    return x


def shingles(text: bytes, words_in_shingle: int) -> np.ndarray:
    """Hashes of a text's shingles, in their order, repeated ones too; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= words_in_shingle:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - words_in_shingle + 1].tolist(), (ends[words_in_shingle - 1 :] - 1).tolist())])
    return np.frombuffer(hashes, ">u8").astype(np.uint64)


def simhash(h: np.ndarray, lanes: int = 1) -> bytes:
    """Fingerprint of hashes: a bit is 1 if set in over half of them; 64 bits a lane, first bit highest; zero without hashes."""
    set_ = np.zeros(64 * lanes, np.int64)
    for k in range(0, len(h), 255):  # so many rows add up in a byte
        wide = lanes_of(h[k : k + 255], lanes).astype(">u8")
        set_ += np.add.reduce(np.unpackbits(wide.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(set_ * 2 > len(h)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4) -> DataFrame:
    """id, fp: 64 bits as a signed long. Null texts count as empty; a text of fewer words is one shingle."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingles(t, words_in_shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64))], names=["id", "fp"])

    limit_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(hashed, f"id {kind}, fp long")


def bands(n: int, bits: int) -> int:
    """Number of bands: the fewest for which a bucket of n random fingerprints would hold about 16 at most. Links don't depend on it."""
    for m in range(bits + 1, 64):
        if n / 2.0 ** (64 * (m - bits) / m) <= 16:
            return m
    return 64


def band_rows(distinct: DataFrame, m: int, bits: int) -> DataFrame:
    """key, node: a row for each choice of m - bits bands out of m, keyed by the choice and the bands' values."""
    edges = [64 * i // m for i in range(m + 1)]
    masks = []
    for chosen in combinations(range(m), m - bits):
        mask = 0
        for i in chosen:
            mask |= ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    rows = distinct.select("node", F.posexplode(F.array(*[F.lit(x).cast("long") for x in masks])).alias("choice", "mask"))
    return rows.select(F.xxhash64("choice", F.col("node").bitwiseAND(F.col("mask"))).alias("key"), "node")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose last axis is their lanes."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels[i]: smallest index joined with i so far; also join a[j] with b[j]."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(labels, high, low)
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels = shorter


def join_large(f: np.ndarray, bits: int) -> np.ndarray:
    """Labels of one bucket's distinct fingerprints (fingerprint x lane), by pivots.

    Fingerprints within bits // 2 of a pivot are its ball and all linked. A further one is linked with the ball if it is
    within bits of the pivot or of a member; by the triangle inequality only those within bits + bits // 2 of the pivot are tried.
    """
    n, radius = len(f), bits // 2
    labels, free = np.arange(n), np.ones(n, bool)
    for p in range(n):
        if not free[p]:
            continue
        d = distance(f, f[p])
        ball = np.flatnonzero((d <= radius) & free)
        free[ball] = False
        near = d <= bits
        if len(ball) > 1:
            rim = np.flatnonzero((d > bits) & (d <= bits + radius))
            for x in np.array_split(rim, max(1, len(rim) * len(ball) * f.shape[1] // 4_000_000)):
                near[x] |= (distance(f[x][:, None], f[ball][None, :]) <= bits).any(axis=1)
        joined = np.unique(labels[near])
        if len(joined) > 1:
            labels[np.isin(labels, joined)] = joined[0]
    return labels


def linked(keys: np.ndarray, nodes: np.ndarray, f: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it is joined with) within the buckets of whole runs of equal keys; f: the nodes' fingerprints."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    a_all, b_all = [], []
    large = starts[sizes > SMALL], sizes[sizes > SMALL]
    for s, n in zip(*large):
        labels = join_large(f[s : s + n], bits)
        at = np.flatnonzero(labels != np.arange(n))
        a_all.append(s + at)
        b_all.append(s + labels[at])
    run = np.repeat(np.arange(len(starts)), sizes)
    at = np.flatnonzero(sizes[run] <= SMALL)
    for d in range(1, int(min(SMALL, sizes[sizes <= SMALL].max(initial=1)))):
        at = at[at + d < len(keys)]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        near = at[distance(f[at], f[at + d]) <= bits]
        a_all.append(near + d)
        b_all.append(near)
    if not a_all or not (a := np.concatenate(a_all)).size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values, place = np.unique(nodes, return_inverse=True)
    labels = merge(np.arange(len(values)), place[a], place[np.concatenate(b_all)])
    at = np.flatnonzero(labels != np.arange(len(values)))
    return values[at], values[labels[at]]


def runs(compare: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of Arrow batches, sorted by their first column, that gives `compare` whole runs of equal keys."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= 100_000 and held[0][0][0] != held[-1][0][-1]:
                rows = [np.concatenate(x) for x in zip(*held)]
                end = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last run may go on
                yield from compare([x[:end] for x in rows])
                held, size = [[x[end:] for x in rows]], size - end
        if size:
            yield from compare([np.concatenate(x) for x in zip(*held)])

    return whole


def dealt(rows: DataFrame) -> DataFrame:
    """rows by key, sorted, a bucket in one task."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "key").sortWithinPartitions("key", "node")


def links(rows: DataFrame, n: int, bits: int) -> DataFrame:
    """Edges (u, v) of nodes (fingerprints) that differ in at most `bits` bits and share a key, directly or by others.

    n: nodes; no bucket can have more, so large buckets are only looked for where n is over SPLIT.
    """

    def compare(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, nodes = rows
        u, v = linked(keys, nodes, nodes.view(np.uint64)[:, None], bits)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt(pieces(rows, sample=rows.where(seen()), every=SEEN) if n > SPLIT else rows).select("key", "node").mapInArrow(runs(compare), "u long, v long").distinct()


def seen() -> Column:
    """One node in SEEN."""
    return F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(SEEN)) == 0


def pieces(rows: DataFrame, split: int | None = None, sample: DataFrame | None = None, every: int = 1) -> DataFrame:
    """rows with the buckets of over `split` (SPLIT) rows in pieces: every two pieces of a bucket, and each with itself, are a bucket of
    their own, so that all pairs still meet and no task gets more than two pieces of a bucket.

    sample: the rows of one node in `every`, from which bucket sizes are estimated. Pairs meet whatever the estimate says.
    """
    split = split or SPLIT
    hot = (rows if sample is None else sample).groupBy("key").agg((F.count(F.lit(1)) * every).alias("n")).where(F.col("n") > split)
    hot = written(hot.select("key", F.ceil(F.col("n") / split).cast("int").alias("parts")), "hot-buckets")
    rows = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")))
    return rows.withColumn("key", key).drop("parts", "piece", "other")


def smallest_of(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key, name: the smallest value of each key (a long).

    Grouped by the key's complement: a join on the key then has an exchange on this side too, without which Spark can't split
    the partition of a key that many rows of the other side have.
    """
    grouped = rows.groupBy(F.bitwise_not(key).alias("_complement")).agg(F.min(value).alias(name))
    return grouped.select(F.bitwise_not("_complement").alias(key), name)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        labels = merge(np.arange(len(nodes)), place[: len(u)], place[len(u) :])
        at = np.flatnonzero(labels != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[labels[at]])], names=["u", "root"])


def components(edges: DataFrame) -> DataFrame:
    """u, root: the smallest node of u's component, for every node that isn't the smallest itself.

    Alternating stars: in each round every node's larger neighbours, then its smaller ones, are tied to the smallest
    neighbour, until nothing moves. Rounds are joins and minima that combine before they shuffle; no node's neighbours are
    gathered, and each round is written to the shared folder. At most FEW edges are joined by one task, with the same result.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if 0 < now.count() <= FEW:
        return written(now.repartition(1).mapInArrow(joined, "u long, root long"), "roots")
    seen = None
    while True:
        # two sums of whole hashes: equal ones are equal edges
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20)")).alias("h"), F.sum(F.xxhash64(F.lit(SEED), "v", "u").cast("decimal(20)")).alias("g")).first()
        if state["n"] == 0 or state == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = state
        both = now.union(now.select("v", "u"))
        least = smallest_of(both, "u", "v", "m").select("u", F.least("u", "m").alias("m"))
        # large star: v > u is tied to the smallest of u and its neighbours
        star = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = smallest_of(star, "u", "v", "m")
        # small star: u and its smaller neighbours are tied to the smallest of them
        tied = star.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # as many files as the edges fill, not as many as a shuffle has partitions
        now = written(tied.union(small.select("u", F.col("m").alias("v"))).distinct().coalesce(1 + 2 * state["n"] // EDGES), "edges")


def named(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """node, component_id: the smallest `least` of each node's component."""
    rooted = distinct.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = smallest_of(rooted, "root", "least", "component_id")
    return rooted.select("node", "root").join(smallest, "root").select("node", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: id_col, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable by links).

    Fingerprints are linked if at most `bits` bits differ; equal ones always are, those of texts without words (null, empty,
    white space: zero) too. Null ids count last: component_id is null only where a component has no other id. Repeated rows
    stay repeated. Other columns, whatever their names, are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, words_in_shingle), "fingerprints")
    distinct = written(prints.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("least")), "distinct")
    n = distinct.count()
    roots = components(links(band_rows(distinct, bands(n, bits), bits), n, bits))
    groups = named(distinct, roots).withColumnRenamed("node", "fp")
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class BlockPlan:
    """How fingerprints are cut: bits of a block, number of blocks, and the most bits that candidate pairs differ in: of the CARRIED
    ones, and of all."""

    bits: int
    blocks: int
    carried: int
    most: int

    def places(self, lanes: int = LANES) -> np.ndarray:
        """Blocks x bits: the fingerprint's bits that each block has. Blocks of one layout (a permutation of all bits) are apart."""
        width, out, layout = 64 * lanes, [], 0
        while len(out) < self.blocks:
            order = np.random.default_rng((SEED, layout)).permutation(width)
            out += list(order[: width // self.bits * self.bits].reshape(-1, self.bits))
            layout += 1
        return np.array(out[: self.blocks])


def rate(similarity: float) -> float:
    """Share of bits in which fingerprints of sets of the Jaccard similarity differ, at most: the angle of sets of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def binomial(n: int, p: float) -> np.ndarray:
    """Probabilities of 0 to n."""
    k = np.arange(n + 1)
    with np.errstate(divide="ignore"):
        logs = np.cumsum(np.concatenate([[0.0], np.log((n - k[:-1]) / k[1:])])) + k * np.log(p) + (n - k) * np.log1p(-p)
    return np.exp(logs)


def plan_blocks(n: int, similarity: float, recall: float = RECALL, lanes: int = LANES) -> BlockPlan:
    """Blocks for n distinct texts: so wide that about RANDOM unrelated ones share a bucket whatever n is, and so many that pairs at
    the similarity meet with probability `recall`. A document's comparisons grow with the number of blocks, n to the power 0.24."""
    width, p = 64 * lanes, rate(similarity)
    bits = min(40, max(8, math.ceil(math.log2(max(1, n) / RANDOM))))
    spread, differ = binomial(width, p), np.arange(width + 1)
    j = np.arange(bits)
    agree = np.prod(np.clip((width - differ[:, None] - j) / (width - j), 0, 1), axis=1)  # a block's bits are all of the equal ones
    low, high = 1, 1
    while spread @ (1 - (1 - agree) ** high) < recall:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if spread @ (1 - (1 - agree) ** mid) >= recall else (mid, high)
    carried, most = (int(np.searchsorted(np.cumsum(binomial(n, p)), 1 - LOST)) for n in (CARRIED, width))
    return BlockPlan(bits, high, carried, most)


def block_keys(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Document x block: the block's number and the values of its bits, as one long. prints: document x byte."""
    bits = np.unpackbits(prints, axis=1)
    out = np.broadcast_to(np.arange(len(places), dtype=np.int64), (len(prints), len(places))).copy()
    for j in range(places.shape[1]):
        out <<= 1
        out |= bits[:, places[:, j]]
    return out


def text_marks(text_col: str) -> list[Column]:
    """128 bits of a text's content, h1 and h2."""
    return [F.xxhash64(utf8(text_col)).alias("h1"), F.xxhash64(F.lit(SEED), utf8(text_col)).alias("h2")]


def set_prints(docs: DataFrame, id_col: str, text_col: str, words_in_shingle: int) -> DataFrame:
    """id, h1, h2, fp (128-bit digest of the set of shingles), n (its size), print (its fingerprint, LANES lanes)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t, words_in_shingle)) for t in batch.column(3).to_pylist()]
            made = [pa.array([xxhash.xxh128_digest(x.tobytes(), SEED) for x in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array([simhash(x, LANES) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["id", "h1", "h2", "fp", "n", "print"])

    limit_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), *text_marks(text_col), utf8(text_col).alias("t")).mapInArrow(hashed, f"id {kind}, h1 long, h2 long, fp binary, n long, print binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str, words_in_shingle: int) -> DataFrame:
    """wanted without h1 and h2, and with shingles: the sorted distinct hashes, packed. wanted: node, and h1 and h2 of its text.

    Only texts that a filter of h1 lets pass are shuffled, which is all if there are too many nodes for one, and once: copies are
    left out by the same keys that the join has.
    """
    texts = docs.select(*text_marks(text_col), utf8(text_col).alias("t"))
    maybe = maybe_in(wanted, "h1", wanted.count(), docs)
    if maybe is not None:
        texts = texts.where(maybe(F.col("h1")))
    kept = [c for c in wanted.columns if c not in ("h1", "h2")]
    found = texts.dropDuplicates(["h1", "h2"]).join(wanted, ["h1", "h2"]).select(*kept, "t")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t, words_in_shingle)).tobytes() for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*kept, "shingles"])

    return found.mapInArrow(hashed, T.StructType([*[wanted.schema[c] for c in kept], T.StructField("shingles", T.BinaryType())]))


def block_rows(prints: DataFrame, plan: BlockPlan, similarity: float) -> DataFrame:
    """key, node, a, b: a row for each block of each fingerprint; a and b: its first CARRIED bits, and the set's size in STEPS.
    prints: node, n, print."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = plan.places()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                wide = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(part), -1)
                steps = np.minimum(255, np.log(part.column(1).to_numpy()) / -math.log(similarity) * STEPS).astype(np.uint8)
                carried = [np.ascontiguousarray(x).view(np.int64)[:, 0] for x in (wide[:, :8], np.concatenate([steps[:, None], wide[:, 8:15]], axis=1))]
                repeated = [pa.array(np.repeat(x, plan.blocks)) for x in (part.column(0).to_numpy(), *carried)]
                yield pa.RecordBatch.from_arrays([pa.array(block_keys(wide, places).ravel()), *repeated], names=["key", "node", "a", "b"])

    return prints.select("node", "n", "print").mapInArrow(cut, "key long, node long, a long, b long")


def alike(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Whether rows i and j differ in at most `most` of the carried bits and their sets' sizes allow the similarity."""
    x = b[i] ^ b[j]
    near = np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(x >> np.uint64(8)) <= most
    steps = (b & np.uint64(255)).astype(np.int16)
    return near & (np.abs(steps[i] - steps[j]) <= STEPS)


def has_alike(keys: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether each row is alike another one of its bucket; rows of buckets over SHIFTED count as such. Rows come in whole buckets, sorted."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    run = np.repeat(np.arange(len(starts)), sizes)
    found = sizes[run] > SHIFTED
    at, d = np.flatnonzero((sizes[run] > 1) & ~found), 0
    while len(at):
        d += 1
        at = at[at + d < len(keys)]
        at = at[run[at] == run[at + d]]
        near = at[alike(a, b, at, at + d, most)]
        found[near] = found[near + d] = True
    return found


def shared_blocks(prints: DataFrame, n: int, plan: BlockPlan, similarity: float) -> DataFrame:
    """key, node: the rows of block_rows that are alike another one of their bucket.

    n: nodes; no bucket can have more, so large buckets are only looked for where n is over SPLIT.
    """
    rows = block_rows(prints, plan, similarity)

    def compare(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, nodes, a, b = rows
        at = np.flatnonzero(has_alike(keys, a.view(np.uint64), b.view(np.uint64), plan.carried))
        yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(nodes[at])], names=["key", "node"])

    if n > SPLIT:
        rows = pieces(rows, sample=block_rows(prints.where(seen()), plan, similarity), every=SEEN)
    return dealt(rows).select("key", "node", "a", "b").mapInArrow(runs(compare), "key long, node long")


def lanes_in(prints: np.ndarray) -> np.ndarray:
    """Fingerprints as they come from Arrow: row x lane."""
    return np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)


def could_be(n: np.ndarray, f: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows i and j may be candidates by their sets' sizes and fingerprints, and the bits that they differ in."""
    bits = distance(f[i], f[j])
    return (bits <= most) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])), bits


def nearest(buckets: DataFrame, turn: int, similarity: float, most: int) -> DataFrame:
    """node, other: for each node the nearest of some rows of its buckets that have another root, if any is a candidate.

    buckets: key, node, n, print, root, cuts. A row is compared with WINDOW others that a hash of the turn picks, in pieces of hot
    buckets that another one does, so that the work is linear in the rows.
    """

    def compare(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, nodes, n, roots, prints = rows
        order = np.lexsort((lanes_of(nodes.view(np.uint64), turn + 2)[:, turn + 1], keys))
        keys, nodes, n, roots, f = keys[order], nodes[order], n[order], roots[order], lanes_in(prints[order])
        best, other = np.full(len(keys), most + 1), np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        for d in range(1, WINDOW + 1):
            at = at[at + d < len(keys)]
            at = at[keys[at] == keys[at + d]]
            i = at[roots[at] != roots[at + d]]
            ok, bits = could_be(n, f, i, i + d, similarity, most)
            for mine, theirs in ((i[ok], i[ok] + d), (i[ok] + d, i[ok])):
                nearer = bits[ok] < best[mine]
                best[mine[nearer]], other[mine[nearer]] = bits[ok][nearer], nodes[theirs[nearer]]
        at = np.flatnonzero(best <= most)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(best[at].astype(np.int64)), pa.array(other[at])], names=["node", "bits", "other"])

    key = F.when(F.col("cuts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("cuts"))))
    found = dealt(buckets.withColumn("key", key)).select("key", "node", "n", "root", "print").mapInArrow(runs(compare), "node long, bits long, other long")
    return found.groupBy("node").agg(F.min(F.struct("bits", "other")).alias("best")).select("node", F.col("best.other").alias("other"))


def bucket_pairs(buckets: DataFrame, similarity: float, most: int) -> DataFrame:
    """u, v: the candidates of a bucket that have different roots. buckets: key, node, n, print, root."""

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, nodes, n, roots, prints = rows
        f = lanes_in(prints)

        def out(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            ok, _ = could_be(n, f, i, j, similarity, most)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(nodes[i[ok]], nodes[j[ok]])), pa.array(np.minimum(nodes[i[ok]], nodes[j[ok]]))], names=["u", "v"])

        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        for s, size in zip(starts[sizes > SHIFTED], sizes[sizes > SHIFTED]):
            _, group, members = np.unique(roots[s : s + size], return_inverse=True, return_counts=True)
            rows = s + np.lexsort((group, members[group]))  # small components first: each is compared with those after it
            ends = np.cumsum(np.sort(members))
            for begin, end in zip(np.concatenate([[0], ends[:-1]]), ends):
                for own in rows[begin:end]:
                    yield from out(np.full(size - end, own), rows[end:])
        run = np.repeat(np.arange(len(starts)), sizes)
        at, d = np.flatnonzero((sizes[run] > 1) & (sizes[run] <= SHIFTED)), 0
        while len(at):
            d += 1
            at = at[at + d < len(keys)]
            at = at[run[at] == run[at + d]]
            other = at[roots[at] != roots[at + d]]
            yield from out(other, other + d)

    several = buckets.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rows = pieces(buckets.join(several, "key", "left_semi"), PAIRED)
    return dealt(rows).select("key", "node", "n", "root", "print").mapInArrow(runs(pairs), "u long, v long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, groups: int, similarity: float) -> DataFrame:
    """Edges (u, v): of the pairs (u, v), those whose sets have the Jaccard similarity or more, without those that others imply.

    sets: node, root, block, blocks, n, shingles. A set goes once to each two blocks that it has a pair in; the pairs of
    clusters of one block go by their roots' hash to `groups` groups.
    """

    def check(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        nodes = sets["node"].to_numpy()
        packed = [np.frombuffer(x, np.uint64) for x in sets["shingles"].to_pylist()]
        order = np.argsort(nodes)
        at = [order[np.searchsorted(nodes, pairs[c].to_numpy(), sorter=order)].tolist() for c in ("u", "v")]
        parent = list(range(len(nodes)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        found = []
        for a, b in zip(*at):
            x, y = find(a), find(b)
            if x == y:
                continue
            both = np.sort(np.concatenate([packed[a], packed[b]]))
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common / (len(both) - common) >= similarity:
                parent[x] = y
                found.append((a, b))
        edges = nodes[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"u": edges[:, 0], "v": edges[:, 1]})

    places = sets.select("node", "root", "block", "blocks", "n")
    mine = places.toDF("u", "root", "block", "blocks", "n")
    other = places.select(F.col("node").alias("v"), F.col("block").alias("block_v"), F.col("n").alias("n_v"))
    both = pairs.join(mine, "u").join(other, "v").where(F.least("n", "n_v") / F.greatest("n", "n_v") >= similarity)
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.xxhash64("root", F.least("block", "block_v"), F.greatest("block", "block_v")))
    placed = written(both.select(key.alias("g"), "u", "v"), "pairs")
    ends = placed.select(F.explode(F.array("u", "v")).alias("node"), F.col("g").alias("group")).distinct()
    needed = ends.join(sets.select("node", "shingles"), "node")
    return placed.groupBy("g").cogroup(needed.groupBy("group")).applyInArrow(check, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: id_col, component_id. As simhash_components, for a Jaccard similarity of the sets of shingles.

    Links are exact: every one is checked on the sets (64-bit hashes of shingles). Candidates are texts whose fingerprints share
    a block and differ in no more of their CARRIED bits than all but one in a thousand pairs at the similarity. A pair at the
    similarity itself shares a block with probability RECALL, one of higher similarity with more: equal blocks can't find all
    pairs that differ in so many bits. Texts without words are one group.

    In some rounds each text is checked with its nearest candidate of another component, which joins large groups with few checks;
    then all candidates that are still apart are. Shingles are hashed again for the texts that have candidates, instead of being
    kept for all.
    """
    prints = written(set_prints(docs, id_col, text_col, words_in_shingle).withColumn("row", F.monotonically_increasing_id()), "prints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct("row", "n", "print", "h1", "h2")).alias("one"))
    distinct = written(distinct.select("fp", "least", F.col("one.row").alias("node"), "one.n", "one.print", "one.h1", "one.h2"), "distinct")
    nodes = distinct.count()
    plan = plan_blocks(nodes, similarity)
    own = distinct.where("n > 0").select("node", "n", "print")
    shared = written(shared_blocks(own, nodes, plan, similarity), "shared")
    cuts = shared.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PAIRED).alias("cuts")).where("cuts > 1")
    buckets = written(shared.join(own, "node").join(cuts, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))), "buckets")
    stars = written(nearest(buckets.withColumn("root", F.col("node")), 0, similarity, plan.most), "stars")
    first = stars.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
    clusters = components(first).withColumnRenamed("u", "node")
    rows = distinct.select("node", "n", "h1", "h2")
    members = written(rows.join(buckets.select("node").distinct(), "node").join(clusters, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    wanted = written(members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).select("node", "root", "block", "blocks", "n", "h1", "h2"), "wanted")
    sets = written(shingle_sets(docs, wanted, text_col, words_in_shingle), "sets")
    groups = 1 + (members.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES

    linked = written(similar(first, sets, groups, similarity), "links")
    for turn in range(1, ROUNDS + 1):
        roots = components(linked).withColumnRenamed("u", "node")
        rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = bucket_pairs(rooted, similarity, plan.most)
        if turn < ROUNDS:
            pairs = nearest(rooted, turn, similarity, plan.most).select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
        linked = written(linked.union(similar(pairs, sets, groups, similarity)), "links")
    named_ = named(distinct.select("node", "least"), components(linked))
    return prints.select("id", "fp").join(distinct.select("node", "fp").join(named_, "node").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "component_id")
