"""The k nearest rows by Euclidean distance, exactly, in blocks of vectors.

Every pair is looked at, so the work grows with queries times rows; a matrix product a pair of blocks makes it small. Products only
say which pairs can't be among the nearest, by a bound of their rounding errors; the others' distances are summed element by element in
doubles, as `array_distance` does. Memory is bounded by the blocks, and a task returns k rows a query at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.packaging import ship_package

#: Bytes and rows of a block of rows, rows of a block of queries, rows that a product takes at once, pairs that are summed at once.
BLOCK_BYTES, BLOCK_ROWS, QUERY_ROWS, TILE, PAIRS = 4 << 20, 16_384, 2_048, 1_024, 16_384
#: Bytes of an Arrow batch; of a table for which its blocks get another partition, at least and at most.
BATCH_BYTES, LEAST_BYTES, MOST_BYTES = 8 << 20, 1 << 20, 64 << 20
#: A squared norm beyond which a product may overflow; such rows are always summed.
LARGE = 1e300
#: Order of distances: numbers, NaN, null; then places that are still free.
NUMBER, NAN, NULL, FREE = range(4)
BLOCK = "no string, dim int, nil boolean, ids binary, vectors binary"


def blocks(df: DataFrame, rows: int) -> DataFrame:
    """Rows (id, vector) in blocks of vectors of one length. dim: the length, -1 for null; nil: the vectors have null elements."""
    kind = np.dtype("f4" if df.schema["vector"].dataType.elementType.simpleString() == "float" else "f8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(key: tuple[int, bool], least: int) -> Iterator[pa.RecordBatch]:
            most = max(1, min(rows, BLOCK_BYTES // max(1, key[0] * kind.itemsize)))
            if sum(len(i) for i, _ in held[key]) < min(least, most):
                return
            ids, vectors = (np.concatenate(x) for x in zip(*held[key]))
            stop = len(ids) if least == 1 else len(ids) // most * most
            for at in range(0, stop, most):
                part = slice(at, min(at + most, stop))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((uuid.uuid4().hex, pa.string()), (key[0], pa.int32()), (key[1], pa.bool_()), (ids[part].tobytes(), pa.binary()), (vectors[part].tobytes(), pa.binary()))], ["no", "dim", "nil", "ids", "vectors"])
            held[key] = [(ids[stop:], vectors[stop:])]

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dims = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            ends = np.cumsum(np.maximum(dims, 0), dtype=np.int64)
            nulls = np.concatenate([[0], np.cumsum(pc.is_null(flat).to_numpy(zero_copy_only=False))])
            nil = nulls[ends] > nulls[ends - np.maximum(dims, 0)]
            values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(kind, copy=False)
            for dim, odd in sorted({*zip(dims.tolist(), nil.tolist())}):
                at = np.flatnonzero((dims == dim) & (nil == odd))
                held.setdefault((dim, odd), []).append((ids[at], values[(ends[at] - max(dim, 0))[:, None] + np.arange(max(dim, 0))]))
                yield from out((dim, odd), rows)
        for key in held:
            yield from out(key, 1)

    return df.mapInArrow(pack, BLOCK)


def firsts(groups: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k nearest if a group's rows are all as near: those with its k + 1 smallest ids (one may be the query's own), k of an id."""
    order = np.lexsort((ids, groups))
    g, i, at = groups[order], ids[order], np.arange(len(ids))
    group = np.concatenate([[True], g[1:] != g[:-1]])
    other = group | np.concatenate([[True], i[1:] != i[:-1]])
    no = np.cumsum(other)
    return np.sort(order[(no - np.maximum.accumulate(np.where(group, no, 0)) <= k) & (at - np.maximum.accumulate(np.where(other, at, 0)) < k)])


def equal(vectors: np.ndarray) -> np.ndarray:
    """A number for each vector; vectors of one number are the same bit by bit."""
    bits = vectors.view(f"u{vectors.itemsize}")
    hashes = bits.astype(np.uint64) @ (np.random.default_rng(1).integers(1 << 62, size=bits.shape[1], dtype=np.uint64) * 2 + 1)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[False], (hashes[order][1:] != hashes[order][:-1]) | (bits[order][1:] != bits[order][:-1]).any(axis=1)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Block:
    """A block as it comes from a batch; `side` is the prefix of its columns."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, kind: str):
        self.no, self.dim, self.nil = (batch.column(side + c)[row].as_py() for c in ("no", "dim", "nil"))
        self.ids = np.frombuffer(batch.column(f"{side}ids")[row].as_buffer(), np.int64)
        self.raw = np.frombuffer(batch.column(f"{side}vectors")[row].as_buffer(), kind).reshape(len(self.ids), max(self.dim, 0))


class Rows(Block):
    def __init__(self, batch: pa.RecordBatch, row: int, kind: str, k: int):
        super().__init__(batch, row, "e_", kind)
        self.some = self.ids[firsts(np.zeros(len(self.ids), np.int64), self.ids, k)]
        at = firsts(equal(self.raw), self.ids, k)
        self.own, self.vectors = self.ids[at], self.raw[at].astype(np.float64)
        squares = (self.vectors**2).sum(axis=1)
        sure = squares <= LARGE
        self.most = np.sqrt(squares[sure].max(initial=0))
        self.wide = np.column_stack([self.vectors, np.where(sure, squares, np.nan)])


class Queries(Block):
    """Queries and the k nearest rows so far: distances, their kinds, ids."""

    def __init__(self, batch: pa.RecordBatch, row: int, kind: str, k: int):
        super().__init__(batch, row, "q_", kind)
        self.ids, self.vectors = self.ids.copy(), self.raw.astype(np.float64)
        self.squares = (self.vectors**2).sum(axis=1)
        self.wide = np.column_stack([-2 * self.vectors, np.ones(len(self.ids))])
        self.d, self.kind, self.near = np.zeros((len(self.ids), k)), np.full((len(self.ids), k), FREE, np.int8), np.zeros((len(self.ids), k), np.int64)

    def merge(self, at: np.ndarray, d: np.ndarray, kind: np.ndarray, ids: np.ndarray) -> None:
        """Take in pairs: the number of the query, the distance and its kind, the row's id."""
        other = self.ids[at] != ids
        at, d, kind, ids = at[other], d[other], kind[other], ids[other]
        rows, k = np.unique(at), self.d.shape[1]
        at = np.concatenate([at, np.repeat(rows, k)])
        d, kind, ids = (np.concatenate([x, own[rows].ravel()]) for x, own in ((d, self.d), (kind, self.kind), (ids, self.near)))
        order = np.lexsort((ids, d, kind, at))
        best = order[np.searchsorted(at[order], rows)[:, None] + np.arange(k)]
        self.d[rows], self.kind[rows], self.near[rows] = d[best], kind[best], ids[best]

    def limits(self, most: float) -> np.ndarray:
        """What a row's squared norm less twice the product mustn't exceed, for rows of norm `most` at most."""
        error = (self.vectors.shape[1] + 16) * 2.3e-16 * (np.sqrt(self.squares) + most) ** 2 + 1e-300
        limit = self.d[:, -1] ** 2 * (1 + 1e-14) - self.squares + error
        return np.where((self.kind[:, -1] == NUMBER) & (self.squares <= LARGE), limit, np.inf)

    def meet(self, rows: Rows) -> bool:
        """Look at all pairs with a block of rows. False if there is a pair of different lengths."""
        if self.dim >= 0 and rows.dim >= 0 and self.dim != rows.dim:
            return bool(((self.ids == self.ids[0]) & (self.ids[0] == rows.ids).all()).all())
        if min(self.dim, rows.dim) < 0 or self.nil or rows.nil:
            at = np.flatnonzero(self.kind[:, -1] >= NULL)
            n = len(at) * len(rows.some)
            self.merge(np.repeat(at, len(rows.some)), np.zeros(n), np.full(n, NULL, np.int8), np.tile(rows.some, len(at)))
            return True
        start, size = 0, max(64, TILE // 8)
        while start < len(rows.own):
            size = min(TILE, 2 * size if start else size)  # few at first: what isn't among their nearest needs no sum
            far = self.wide @ rows.wide[start : start + size].T > self.limits(rows.most)[:, None]
            found = np.flatnonzero(~far)
            for part in range(0, len(found), PAIRS):
                at, to = np.divmod(found[part : part + PAIRS], far.shape[1])
                steps = np.ascontiguousarray((self.vectors[at] - rows.vectors[start + to]).T)
                total = np.zeros(len(at))
                for step in steps:  # one after the other: the sum is then the same to the last bit
                    total += step * step
                nan = np.isnan(total)
                self.merge(at, np.where(nan, 0, np.sqrt(total)), np.where(nan, NAN, NUMBER).astype(np.int8), rows.own[start + to])
            start += size
        return True


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(q, e, distance): of each row of queries the pairs with its k nearest rows of another id, and some more. All have columns id, bigint
    without nulls, and vector, array of float or double.

    Near is by array_distance, then by id, as ORDER BY has them: NaN after numbers, null last. A task returns what is nearest among the
    rows that it saw, so the caller ranks the pairs. Vectors of different lengths are an error, as in array_distance.
    """
    spark = queries.sparkSession
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    kinds = [df.schema["vector"].dataType.elementType.simpleString().replace("float", "f4").replace("double", "f8") for df in (queries, rows)]

    def parts(df: DataFrame, tasks: int) -> int:
        known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # file sizes, no job
        return max(min(tasks, known // LEAST_BYTES + 1), known // MOST_BYTES + 1) if known < 1 << 42 else spark.sparkContext.defaultParallelism

    q, e = blocks(queries, QUERY_ROWS), blocks(rows, BLOCK_ROWS)
    q, e = q.select([F.col(c).alias(f"q_{c}") for c in q.columns]), e.select([F.col(c).alias(f"e_{c}") for c in e.columns])
    pairs = e.repartition(parts(rows, 2 * spark.sparkContext.defaultParallelism)).crossJoin(q.repartition(parts(queries, 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Queries] = {}
        block, names = None, ["q", "e", "distance", "unequal"]
        with np.errstate(all="ignore"):
            for batch in batches:
                for row in range(batch.num_rows):
                    if block is None or block.no != batch.column("e_no")[row].as_py():
                        block = Rows(batch, row, kinds[1], k)
                    if (no := batch.column("q_no")[row].as_py()) not in own:
                        own[no] = Queries(batch, row, kinds[0], k)
                    if not own[no].meet(block):
                        yield pa.RecordBatch.from_pydict({"q": [0], "e": [0], "distance": pa.array([None], pa.float64()), "unequal": [True]})
            for x in own.values():
                at, to = np.nonzero(x.kind < FREE)
                kind = x.kind[at, to]
                d = pa.array(np.where(kind == NAN, np.nan, x.d[at, to]), mask=kind == NULL)
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[at]), pa.array(x.near[at, to]), d, pa.array(np.zeros(len(at), bool))], names)

    found = pairs.mapInArrow(search, "q bigint, e bigint, distance double, unequal boolean")
    wrong = F.raise_error(F.lit("array_distance: arrays of different lengths")).cast("double")
    return found.select("q", "e", F.when(F.col("unequal"), wrong).otherwise(F.col("distance")).alias("distance"))
