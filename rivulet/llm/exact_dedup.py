"""Exact dedup by content-defined chunk recipes.

A document is cut where a rolling hash of its last 16 bytes is small, so equal texts give equal chunks wherever they stand.
Chunks become identifiers (XXH3-128), which a chunk dictionary verifies against SHA-256: an identifier that stands for two
contents makes the whole run use the SHA-256 itself as identifier. Documents are equal if their ordered identifier lists are.
Only recipes (16 bytes a chunk) move between tasks; the texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import binary_parts, limit_batches, utf8, written

#: Window of the rolling hash in bytes; it equals the bits of the hash, as each step shifts it by one.
WINDOW = 16
#: Per-byte random values, from a multiplicative rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def rolling(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last 16 bytes, modulo 2**16."""
    values = GEAR[data]
    h = values.copy()
    for j in range(1, min(WINDOW, len(h))):
        h[j:] += values[:-j] << np.uint16(j)
    return h


def cuts(candidates: np.ndarray, start: int, end: int, least: int, most: int) -> list[int]:
    """Chunk ends between start and end: the candidates at least `least` bytes on, or `most` bytes on without one.

    With least >= WINDOW no hash that spans the text before `start` is used, so cuts depend on the content alone.
    """
    out, at, i, n = [], start, 0, len(candidates)
    while end - at > least:
        while i < n and candidates[i] < at + least:
            i += 1
        nxt = int(candidates[i]) if i < n else end
        at = min(nxt, at + most, end)
        out.append(at)
    if at < end or not out:
        out.append(end)
    return out


def recipes(docs: DataFrame, id_col: str, text_col: str, chunk_bits: int, least: int, most: int, id_bytes: int) -> DataFrame:
    """One row per document: its id, packed chunk identifiers, packed SHA-256 of the chunks, and the text's SHA-256."""
    if least < WINDOW:
        raise ValueError(f"chunks of under {WINDOW} bytes would depend on their surroundings")
    below = np.uint16(1 << (16 - chunk_bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = binary_parts(batch.column(1))
            base = int(at[0]) if len(at) else 0
            text = bytes(values[base : int(at[-1])]).lower()  # of bytes: A-Z only
            at = (at - base).astype(np.int64)
            found = np.flatnonzero(rolling(np.frombuffer(text, np.uint8)) < below) + 1
            bounds = np.searchsorted(found, at, side="right")
            ids, proofs, whole = [], [], []
            for k in range(batch.num_rows):
                s, e = int(at[k]), int(at[k + 1])
                doc = text[s:e]
                ends = cuts(found[bounds[k] : bounds[k + 1]], s, e, least, most) if e > s else []
                chunks = [doc[a - s : b - s] for a, b in zip([s, *ends], ends)]
                ids.append(b"".join([xxhash.xxh3_128_digest(c)[:id_bytes] for c in chunks]))
                proofs.append(b"".join([hashlib.sha256(c).digest() for c in chunks]))
                whole.append(hashlib.sha256(doc).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(proofs, pa.binary()), pa.array(whole)], names=["id", "ids", "proofs", "text_sha256"])

    limit_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(cut, f"id {kind}, ids binary, proofs binary, text_sha256 string")


def chunk_dictionary(rec: DataFrame, id_bytes: int) -> DataFrame:
    """Distinct chunk identifiers with their number of uses and whether one content stands behind each (`verified`)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uses: dict[tuple[bytes, bytes], int] = {}
            for ids, proofs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in range(len(proofs) // 32):
                    key = ids[k * id_bytes : (k + 1) * id_bytes], proofs[k * 32 : (k + 1) * 32]
                    uses[key] = uses.get(key, 0) + 1
            if uses:
                proof = np.frombuffer(b"".join(p for _, p in uses), np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in uses], pa.binary()), *(pa.array(proof[:, k]) for k in range(4)), pa.array(list(uses.values()), pa.int64())], names=["chunk", "p0", "p1", "p2", "p3", "uses"])

    seen = rec.select("ids", "proofs").mapInArrow(pairs, "chunk binary, p0 long, p1 long, p2 long, p3 long, uses long")
    sides = [F.min(f"p{k}").alias(f"l{k}") for k in range(4)] + [F.max(f"p{k}").alias(f"h{k}") for k in range(4)]
    same = F.lit(True)
    for k in range(4):
        same = same & (F.col(f"l{k}") == F.col(f"h{k}"))
    return seen.groupBy("chunk").agg(F.sum("uses").alias("uses"), *sides).select("chunk", "uses", same.alias("verified"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bits: int = 11, least: int = 256, most: int = 1 << 14, id_bytes: int = 16) -> DataFrame:
    """Groups of documents whose texts are identical after lower-casing A-Z; of a group the largest id stays.

    Returns one row per input row: id_col, keep_id, group_size, kept, text_sha256. A null text counts as empty, so null and
    empty texts form one group. Null ids are smaller than any other; a group of null ids only keeps them all (keep_id null).
    Rows that repeat the id that stays are the same document and are all kept. Other columns, whatever their names, are ignored.
    id_bytes under 16 weakens the identifiers (for tests of the verification).
    """
    rec = written(recipes(docs, id_col, text_col, chunk_bits, least, most, id_bytes), "recipes")
    clash = chunk_dictionary(rec, id_bytes).where(~F.col("verified")).limit(1).count()
    rec = rec.select("id", F.col("proofs" if clash else "ids").alias("recipe"), "text_sha256")
    # written, so that the join has an exchange of its own on either side and Spark can split the partition of a large group
    groups = written(rec.groupBy("recipe").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "recipe-groups")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return rec.join(groups, "recipe", "left").select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )
