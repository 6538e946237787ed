"""Line dedup: sharded minimal perfect hashes over distinct line hashes index compact fingerprint, count and owner arrays.

Documents never join lines. A task hashes its documents' lines and packs the hashes by shard; each shard's index is built from
what the tasks have pre-aggregated, and the packed probes go to the shard (hot shards: to several copies of its arrays),
where a probe is one array access. What comes back to a document is the list of its line hashes to drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import BATCH_BYTES, limit_batches, maybe_in, scan_bytes, utf8, written

STRIP = b" \t\n\x0b\x0c\r"
#: Input bytes a shard of the index stands for, and probes that one task answers against a copy of a shard.
SHARD_BYTES, PROBES = 64 << 20, 1_000_000
#: Batches whose entries of a shard are combined at once; beyond as many, batches are combined in groups first.
COMBINED = 4096
#: Levels of the perfect hash, and slots per key on each.
LEVELS, GAMMA = 48, 2
#: The document that rows without id are.
NULL_ID = np.iinfo(np.int64).max


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip(STRIP).lower()


def long_enough(key: bytes, least: int) -> bool:
    """At least `least` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def line_hash(key: bytes) -> bytes:
    """128 bits; equal keys only, for any number of lines that can be stored."""
    return xxhash.xxh3_128_digest(key)


def mixed(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    x = lo ^ (hi * np.uint64(2 * level + 1) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1)))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash: on each level a key alone in its slot takes it, the others go on; its number is the slot's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, self.first, at = [], [], 0
        for slots in levels:
            self.first.append(at)
            self.ranks.append(np.cumsum(slots, dtype=np.int64) - slots)
            at += int(slots.sum())
        self.size = at

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray) -> PerfectHash:
        """Over distinct (lo, hi)."""
        levels = []
        while len(lo):
            if len(levels) == LEVELS:
                raise ValueError("line hashes aren't distinct")
            slot = mixed(lo, hi, len(levels)) % np.uint64(GAMMA * len(lo))
            alone = np.bincount(slot.astype(np.int64), minlength=GAMMA * len(lo)) == 1
            levels.append(alone)
            rest = ~alone[slot.astype(np.int64)]
            lo, hi = lo[rest], hi[rest]
        return cls(levels)

    def numbers(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Each key's number; -1 or any number for keys that aren't in it (a fingerprint tells)."""
        out = np.full(len(lo), -1, np.int64)
        left = np.arange(len(lo))
        for k, slots in enumerate(self.levels):
            slot = (mixed(lo[left], hi[left], k) % np.uint64(len(slots))).astype(np.int64)
            here = slots[slot]
            out[left[here]] = self.first[k] + self.ranks[k][slot[here]]
            left = left[~here]
        return out

    def packed(self) -> tuple[bytes, bytes]:
        return np.array([len(x) for x in self.levels], np.int64).tobytes(), b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpacked(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in np.frombuffer(sizes, np.int64).tolist():
            width = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(bits[at : at + width], np.uint8), count=n).astype(bool))
            at += width
        return cls(levels)


#: Per batch and shard: probes (hash, document, hash of its text) and, for building, one entry a hash: smallest and largest document, count.
ENTRIES = "shard int, piece long, n long, hashes binary, owners binary, texts binary, b_hashes binary, b_least binary, b_most binary, b_count binary"
#: Per shard: perfect hash, 32-bit fingerprints, counts (1: a single document; up to 2**32 - 1) and owners.
INDEX = "shard int, probes long, sizes binary, bits binary, prints binary, counts binary, owners binary"
PARTIAL = "shard int, n long, b_hashes binary, b_least binary, b_most binary, b_count binary"


def entries(docs: DataFrame, id_col: str, text_col: str, shards: int, least_chars: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            hashes, owners, marks = [], [], []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                keys = {key for line in text.split(b"\n") if long_enough(key := line_key(line), least_chars)}
                hashes += map(line_hash, keys)
                owners += [doc] * len(keys)
                marks += [mark] * len(keys)
            if not hashes:
                continue
            h = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2)
            d, m = np.array(owners, np.int64), np.array(marks, np.int64)
            shard = (h[:, 0] % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((m, d, h[:, 1], h[:, 0], shard))
            h, d, m, shard = h[order], d[order], m[order], shard[order]
            other = np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1) | (d[1:] != d[:-1]) | (m[1:] != m[:-1])])  # equal rows probe once
            h, d, m, shard = h[other], d[other], m[other], shard[other]
            new = np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])  # equal hashes are neighbours: one shard
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(d))
            count = np.add.reduceat(np.concatenate([[True], new[1:] | (d[1:] != d[:-1])]).astype(np.int64), first)
            cols: list[list] = [[] for _ in range(10)]
            at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            for s, e in zip(at, np.append(at[1:], len(d))):
                fs, fe = np.searchsorted(first, [s, e])
                for c, v in zip(cols, (int(shard[s]), (part << 24) + number, int(e - s), h[s:e].tobytes(), d[s:e].tobytes(), m[s:e].tobytes(), h[first[fs:fe]].tobytes(), d[first[fs:fe]].tobytes(), d[ends[fs:fe] - 1].tobytes(), count[fs:fe].tobytes())):
                    c.append(v)
            number += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in ENTRIES.split(", ")])

    limit_batches(docs.sparkSession)
    return docs.select(owner_of(id_col).alias("id"), mark_of(text_col).alias("mark"), utf8(text_col).alias("t")).mapInArrow(pack, ENTRIES)


def owner_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID)))


def mark_of(text_col: str) -> Column:
    """Tells rows with one id apart."""
    return F.xxhash64(utf8(text_col))


def combined(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of some entries, with smallest and largest document and count."""
    h = np.frombuffer(b"".join(pdf["b_hashes"]), np.uint64).reshape(-1, 2)
    least, most, count = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("b_least", "b_most", "b_count"))
    order = np.lexsort((h[:, 1], h[:, 0]))
    h, least, most, count = h[order], least[order], most[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)]))
    return h[first], np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), np.add.reduceat(count, first)


def combine_batches(pdf: pd.DataFrame) -> pd.DataFrame:
    """One entry a hash of some batches of a shard."""
    arrays = [x.tobytes() for x in combined(pdf)]
    return pd.DataFrame([(pdf["shard"].iloc[0], int(pdf["n"].sum()), *arrays)], columns=["shard", "n", "b_hashes", "b_least", "b_most", "b_count"])


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Index of one shard, from the batches' pre-aggregated entries."""
    h, least, most, count = combined(pdf)
    lo, hi = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
    table = PerfectHash.build(lo, hi)
    at = table.numbers(lo, hi)
    prints, counts, owners = np.zeros(len(lo), np.uint32), np.zeros(len(lo), np.uint32), np.zeros(len(lo), np.int64)
    # a document may be in several batches' counts (rows that share an id): whether there is another one, the ids tell
    prints[at], counts[at], owners[at] = hi.astype(np.uint32), np.where(least == most, 1, np.clip(count, 2, 2**32 - 1)), least
    sizes, bits = table.packed()
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "probes": int(pdf["n"].sum()), "sizes": sizes, "bits": bits, "prints": prints.tobytes(), "counts": counts.tobytes(), "owners": owners.tobytes()}])


def probe_shard(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """(document, hash of its text, line hash) of the probes whose line several documents hold and another one owns."""
    none = pd.DataFrame({"id": np.empty(0, np.int64), "mark": np.empty(0, np.int64), "hash": np.empty(0, object)})
    if probes.empty or index.empty:
        return none
    one = index.iloc[0]
    table = PerfectHash.unpacked(one["sizes"], one["bits"])
    prints, counts, owners = np.frombuffer(one["prints"], np.uint32), np.frombuffer(one["counts"], np.uint32), np.frombuffer(one["owners"], np.int64)
    out = [none]
    for hashes, docs, marks in zip(probes["hashes"], probes["owners"], probes["texts"]):
        h, d, m = np.frombuffer(hashes, np.uint64).reshape(-1, 2), np.frombuffer(docs, np.int64), np.frombuffer(marks, np.int64)
        lo, hi = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
        at = table.numbers(lo, hi)
        drop = np.flatnonzero((at >= 0) & (prints[at] == hi.astype(np.uint32)) & (counts[at] > 1) & (owners[at] != d))
        if len(drop):
            big = h[drop].astype(">u8").tobytes()
            out.append(pd.DataFrame({"id": d[drop], "mark": m[drop], "hash": [big[16 * k : 16 * k + 16] for k in range(len(drop))]}))
    return pd.concat(out, ignore_index=True)


def line_index(made: DataFrame, batches: int) -> DataFrame:
    """The sharded index of `entries`. batches: about how many there are; a line that all hold has an entry a batch in its shard,
    which beyond COMBINED are combined in groups first."""
    parts = made.select("shard", "piece", "n", "b_hashes", "b_least", "b_most", "b_count")
    if batches > COMBINED:
        group = F.pmod(F.xxhash64("piece"), F.lit(-(-batches // COMBINED)))
        parts = parts.withColumn("group", group).groupBy("shard", "group").applyInPandas(lambda pdf: combine_batches(pdf), PARTIAL)
    return parts.drop("piece").groupBy("shard").applyInPandas(build_shard, INDEX)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10) -> DataFrame:
    """id, mark (hash of the text), drops: for each document with lines to lose, their 128-bit hashes."""
    spark = docs.sparkSession
    size = scan_bytes(docs, text_col)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    made = written(entries(docs, id_col, text_col, shards, least_chars), "line-entries")
    index = written(line_index(made, -(-size // BATCH_BYTES)), "line-index")
    copies = F.greatest(F.lit(1), F.ceil(F.col("probes") / PROBES)).cast("int")
    probes = made.select("shard", "piece", "hashes", "owners", "texts").join(index.select("shard", copies.alias("copies")), "shard")
    probes = probes.withColumn("copy", F.pmod(F.xxhash64("piece"), F.col("copies")).cast("int"))
    copied = index.select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    drops = probes.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInPandas(probe_shard, "id long, mark long, hash binary")
    return written(drops.groupBy("id", "mark").agg(F.collect_set("hash").alias("drops")), "line-drops")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, out: str = "line_dedup") -> DataFrame:
    """All rows and columns of docs plus a struct column `out`: text (the lines that stay, joined by \\n), n_lines, n_dropped.

    Lines split at \\n; a null or empty text is one empty line. A line's key is the line without white space at its ends and
    with A-Z lower-cased. Keys of at least `least_chars` code points that at least two documents hold lose all their lines
    except those of the smallest id that holds them, where all stay. Rows that repeat an id are one document. Null ids are one
    document that comes after all others. A row's verdicts are found by its id and a 64-bit hash of its text. A column of docs
    that is named like `out` is replaced. Ids must be integers.
    """
    drops = dropped_lines(docs, id_col, text_col, least_chars)
    docs = docs.drop(out)
    key, mark, text, lost = f"__{out}_id", f"__{out}_mark", f"__{out}_text", f"__{out}_drops"
    own = docs.withColumns({key: owner_of(id_col), mark: mark_of(text_col)})
    verdicts, none = drops.select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("drops").alias(lost)), F.array().cast("array<binary>")
    maybe = maybe_in(drops.select(F.xxhash64("id", "mark").alias("h")), "h", drops.count(), docs)
    if maybe is None:
        work = own.join(verdicts, [key, mark], "left")
    else:  # documents that lose no line go around the join
        known = maybe(F.xxhash64(key, mark))
        work = own.where(known).join(verdicts, [key, mark], "left").unionByName(own.where(~known).withColumn(lost, none))
    work = work.select(*docs.columns, F.coalesce(lost, none).alias(lost), utf8(text_col).alias(text))
    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, gone in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index(lost)).to_pylist()):
                lines = t.split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    away = set(gone)
                    lines = [x for x in lines if not (long_enough(k := line_key(x), least_chars) and line_hash(k) in away)]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(b"\n".join(lines))
            column = pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), column], names=[*columns, out])

    limit_batches(docs.sparkSession)
    from pyspark.sql import types as T

    kind = T._parse_datatype_string("text string, n_lines long, n_dropped long")
    return work.mapInArrow(keep, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))


