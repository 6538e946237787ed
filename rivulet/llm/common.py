"""Helpers shared by the training-data operators: shared-folder tables, Arrow batch limits, streaming reductions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.packaging import ship_package
from rivulet.session import shared_folder

#: Bytes of one Arrow batch sent to Python. With two Python workers an executor this bounds what a task holds.
BATCH_BYTES = 8 << 20

#: Bits of a Bloom filter a key, and of all that one may have (8 MB); bytes of a table from which going around a join is worth a second scan.
BLOOM_BITS, BLOOM_MOST, AROUND = 10, 1 << 26, 64 << 20

#: The white space of the contracts, as a Java/Python character class body.
SPACE = r"\x20\x09-\x0D"


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/rivulet/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard_work(spark: SparkSession) -> None:
    """Delete what this application's operators have written; results that weren't stored elsewhere are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/rivulet/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so that long documents don't add up to more than a worker can hold; see that workers have this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > size or int(now) <= 0:
        spark.conf.set(key, str(size))


def utf8(column: str) -> "F.Column":
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's statistics: file sizes, no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scan_bytes(df: DataFrame, column: str) -> int:
    """Input bytes: the optimizer's statistics (file sizes, no job), or the column's own where those are missing or far too large."""
    estimate = estimated_bytes(df)
    if estimate < 1 << 42:
        return estimate
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0


def binary_parts(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Value bytes and offsets of a binary array without nulls, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(values if values is not None else b""), at


def maybe_in(keys: DataFrame, column: str, n: int, rows: DataFrame) -> Callable[[Column], Column] | None:
    """A test that is true for every one of the n longs of keys' column and for about one in a hundred others: a Bloom filter of
    BLOOM_BITS a key. None if that would be over BLOOM_MOST bits, or if `rows`, which it should keep out of a shuffle, are a small
    table: they then go through it.
    """
    size = max(1, -(-BLOOM_BITS * n // (1 << 15))) << 15
    if size > BLOOM_MOST or estimated_bytes(rows) < AROUND:
        return None

    def places(key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(size)) for k in range(4)]

    at = keys.select(F.explode(F.array(*places(F.col(column)))).alias("at")).select((F.col("at") + 1).alias("at"))
    made = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(size >> 3, np.uint8)
    for row in made.toLocalIterator():  # BLOOM_MOST bits at most
        bits[(row["bucket"] - 1) << 12 : row["bucket"] << 12] = np.frombuffer(row["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        found = np.ones(len(a), np.uint8)
        for x in (a.to_numpy(), b.to_numpy(), c.to_numpy(), d.to_numpy()):
            found &= shared.value[x >> 3] >> (x & 7).astype(np.uint8)
        return pd.Series((found & 1).astype(bool))

    return lambda key: test(*places(key))


def without(rows: DataFrame, away: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in away (one column, written, distinct); rows without key stay. Rows that a filter of the keys leaves
    out go around the join; where there are too many keys for a filter, all go through it."""
    maybe = maybe_in(away.select(F.xxhash64(key).alias("h")), "h", away.count(), rows)
    if maybe is None:
        return rows.join(away, key, "left_anti").select(rows.columns)
    known = maybe(F.xxhash64(key))
    return rows.where(~known).unionByName(rows.where(known).join(away, key, "left_anti").select(rows.columns))


def tree_sum(partials: DataFrame, key: str, vector: str, parts: int) -> DataFrame:
    """Sum float64 vectors (packed as binary) by key; parts: about how many rows a key has.

    Adders get their rows by key and hold one vector, whatever the numbers of keys and rows; from 16 rows on they work in two levels,
    so that none gets more than about the root of a key's rows.
    """
    schema = partials.select(key, vector).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], schema_types[0]), pa.array([total.tobytes()], pa.binary())], names=[key, vector])

        schema_types = None
        for batch in batches:
            schema_types = [f.type for f in batch.schema]
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(v, np.float64)
                if total is not None and k == now:
                    total += x
                    continue
                if total is not None:
                    yield out()
                now, total = k, x.copy()
        if total is not None:
            yield out()

    level = partials.select(key, vector)
    if parts > 16:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(int(parts**0.5)))
        level = level.withColumn("_salt", salt).repartition(key, "_salt").sortWithinPartitions(key).select(key, vector).mapInArrow(add, schema)
    return level.repartition(key).sortWithinPartitions(key).mapInArrow(add, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
