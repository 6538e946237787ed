"""Language ID with error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams tells the languages with a 1 from those
with a 0. Training is one pass that sums n-gram counts by language (every labelled row, no sample), and sums over languages for
each bit; only the bits' tables and the languages' names reach the driver. The bits' weights come from a bounded sample of
labelled rows. A document gets the codeword with the least weighted loss; a small lead flags ambiguity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import binary_parts, limit_batches, scan_bytes, tree_sum, utf8, written

#: n-gram lengths, buckets of each (a power of two), positions scored at once, and rows of the sample that weighs the bits.
ORDERS, BUCKETS, SLICE, WEIGHT_ROWS = (2, 3), 1 << 14, 1 << 17, 2000
#: Languages whose counts a task holds before it passes them on, that one task sums for the bits, and up to which the code is the best of several.
HELD, SUMMED, CHOSEN = 64, 512, 512
SMOOTH, MARGIN = 0.5, 0.5
UNDETERMINED = "und"
#: A-Z lower-cased, other ASCII bytes that are no letters as one separator.
LETTERS = bytes((b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32) for b in range(256))


def grams(text: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram at each position; BUCKETS where it would pass its document's end."""
    x = text.astype(np.uint32)
    h = x.copy()
    for j in range(1, order):
        h[:-j] = h[:-j] * np.uint32(0x01000193) ^ x[j:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    out = (h >> np.uint32(12)).astype(np.int64) & (BUCKETS - 1)
    for j in range(1, order):
        at = ends - j
        out[at[at >= 0]] = BUCKETS
    return out


def batch_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values, at = binary_parts(column)
    base = int(at[0])
    return np.frombuffer(bytes(values[base : int(at[-1])]).translate(LETTERS), np.uint8), (at - base).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: every split of the languages up to five, else a random code of 12 log2 n bits, up to CHOSEN languages
    that of 64 whose words are farthest apart."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        rows = [[1 if i == 0 or i in chosen else -1 for i in range(n)] for k in range(n - 1) for chosen in combinations(range(1, n), k)]
        return np.array(rows, float).T
    best, seed = None, 0
    while seed < (64 if n <= CHOSEN else 1) or best[0] <= 0:
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, int(12 * np.ceil(np.log2(n)))))
        code, seed = code[:, np.abs(code.sum(axis=0)) < n], seed + 1
        if n <= CHOSEN:
            same = code @ code.T
            apart = (code.shape[1] - same[~np.eye(n, dtype=bool)].max()) / 2
        else:
            apart = float(len(np.unique(code, axis=0)) == n)
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # language x bit
    tables: list[np.ndarray]  # of each order: bucket x bit, the last row of no n-gram
    weights: np.ndarray  # of the bits

    def margins(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Document x bit: mean log-ratio of its n-grams, grown with the root of their number up to 256."""
        docs, ends = len(at) - 1, at[1:]
        sums = np.zeros((docs, self.code.shape[1]))
        for order, table in zip(ORDERS, self.tables):
            buckets = grams(text, ends, order)
            for s in range(0, len(buckets), SLICE):
                e = min(s + SLICE, len(buckets))
                first, last = int(np.searchsorted(at, s, "right")) - 1, int(np.searchsorted(at, e, "left"))
                own = np.arange(first, last)
                own = own[at[own + 1] > np.maximum(at[own], s)]  # documents with bytes in the slice
                if len(own):
                    sums[own] += np.add.reduceat(table[buckets[s:e]], np.maximum(at[own], s) - s, axis=0)
        sizes = np.maximum(1, np.diff(at))[:, None]
        return sums / sizes * np.sqrt(np.minimum(sizes, 256))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest codeword, score, and lead over the next in loss."""
        loss = np.stack([(np.logaddexp(0, -margins * c) * self.weights).sum(axis=1) for c in self.code], axis=1)
        best = loss.argmin(axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        ranked = np.sort(loss, axis=1)
        lead = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1 / share.sum(axis=1), lead


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, weight_rows: int = WEIGHT_ROWS) -> LanguageModel:
    """Learn from labelled (rows with null text or language are left out). Repeated rows count as often as they stand there."""
    spark = labelled.sparkSession
    limit_batches(spark, 4 << 20)
    width = len(ORDERS) * BUCKETS
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), utf8(text_col).alias("t"), F.col(id_col).alias("id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            text, at = batch_text(batch.column(1))
            owner = np.repeat(np.arange(len(langs)), np.diff(at))
            for k, order in enumerate(ORDERS):
                buckets = grams(text, at[1:], order)
                for lang in set(langs):
                    mine = buckets[(langs == lang)[owner]]
                    sums.setdefault(lang, np.zeros(width))[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(mine, minlength=BUCKETS + 1)[:-1]
            if len(sums) > HELD:
                yield from passed_on(sums)
        yield from passed_on(sums)

    def passed_on(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while sums:
            lang, v = sums.popitem()
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tobytes()], pa.binary())], names=["lang", "v"])

    partials = rows.select("lang", "t").mapInArrow(count, "lang string, v binary")
    counts = written(tree_sum(partials, "lang", "v", 1 + scan_bytes(labelled, text_col) // (16 << 20)), "language-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").collect())  # names only
    code = codewords(len(languages))
    model = LanguageModel(languages, code, bit_tables(counts, languages, code), np.ones(code.shape[1]))
    if code.shape[1]:
        model.weights = bit_weights(rows, model, weight_rows)
    return model


def bit_tables(counts: DataFrame, languages: list[str], code: np.ndarray) -> list[np.ndarray]:
    """For each order the log-ratio of a bucket's mean rates in the languages with +1 and in those with -1, by bit.

    Tasks sum the rates of SUMMED languages each, for all bits; a bit's sums meet in one task, in the same order in every run.
    """
    number, bits, width = {x: k for k, x in enumerate(languages)}, code.shape[1], len(ORDERS) * BUCKETS

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, group = np.zeros((bits, 2, width)), None
        for batch in batches:
            for g, lang, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if group is not None and g != group:
                    yield packed(group, sums)
                    sums[:] = 0
                group, own = g, np.frombuffer(v, np.float64).reshape(len(ORDERS), BUCKETS)
                rates = ((own + SMOOTH) / (own.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).ravel()
                side = (code[number[lang]] < 0).astype(int)
                for b in range(bits):
                    sums[b, side[b]] += rates
        if group is not None:
            yield packed(group, sums)

    def packed(group: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(bits)), pa.array([group] * bits, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], names=["bit", "g", "v"])

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros((2, width))

        def out() -> pa.RecordBatch:
            have = np.array([(code[:, now] > 0).sum(), (code[:, now] < 0).sum()])[:, None]
            rates = np.log(total / have)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([(rates[0] - rates[1]).astype(np.float32).tobytes()], pa.binary())], names=["bit", "v"])

        for batch in batches:
            for bit, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if now is not None and bit != now:
                    yield out()
                    total = np.zeros((2, width))
                now = bit
                total = total + np.frombuffer(v, np.float64).reshape(2, width)
        if now is not None:
            yield out()

    tables = np.zeros((len(ORDERS), BUCKETS + 1, bits), np.float32)
    if bits:
        group = F.pmod(F.xxhash64("lang"), F.lit(-(-len(languages) // SUMMED)))
        summed = counts.select(group.alias("g"), "lang", "v").repartition("g").sortWithinPartitions("g", "lang").mapInArrow(sides, "bit long, g long, v binary")
        for row in summed.repartition("bit").sortWithinPartitions("bit", "g").mapInArrow(ratios, "bit long, v binary").collect():  # 128 KB a bit
            tables[:, :-1, row["bit"]] = np.frombuffer(row["v"], np.float32).reshape(len(ORDERS), BUCKETS)
    return list(tables)


def bit_weights(rows: DataFrame, model: LanguageModel, most: int) -> np.ndarray:
    """How well each bit's classifier tells labelled rows, 0 to 1, from a sample of at most `most` rows chosen by hash."""
    order = {lang: k for k, lang in enumerate(model.languages)}
    chosen = rows.select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).orderBy("h", "id").limit(most).select("id").distinct()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.code[[order[x] for x in batch.column(0).to_pylist()]]
            right = (model.margins(*batch_text(batch.column(1))) * y > 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([right.tolist()], pa.list_(pa.int64())), pa.array([batch.num_rows], pa.int64())], names=["right", "n"])

    got = rows.join(F.broadcast(chosen), "id", "left_semi").select("lang", "t").mapInArrow(judge, "right array<long>, n long").collect()  # `chosen` has at most `most` ids
    n = sum(r["n"] for r in got)
    if not n:
        return np.ones(model.code.shape[1])
    return np.maximum(2 * np.sum([r["right"] for r in got], axis=0) / n - 1, 0.05)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """All rows and columns of docs plus a struct column `out`: lang, score (0 to 1), ambiguous.

    lang is `und` with score 0 if the text is null or has no letter, or if nothing could be learned. A column of docs that is
    named like `out` is replaced. Only the text is an input.
    """
    limit_batches(docs.sparkSession, 4 << 20)
    docs = docs.drop(out)
    text, letter = f"__{out}_text", f"__{out}_letter"
    work = docs.withColumn(text, utf8(text_col)).withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names, codewords and 128 KB a bit
    columns = docs.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            known = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            if model.languages:
                best, score, lead = model.decode(model.margins(*batch_text(batch.column(batch.num_columns - 2))))
            else:
                known[:], best, score, lead = False, np.zeros(len(known), int), np.zeros(len(known)), np.zeros(len(known))
            names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
            column = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & (lead < MARGIN))], names=["lang", "score", "ambiguous"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], column], names=[*columns, out])

    kind = T._parse_datatype_string("lang string, score double, ambiguous boolean")
    return work.mapInArrow(predict, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))


def held_out(id_col: str, parts: int, part: int) -> "F.Column":
    """Rows whose crc32(id as text) leaves `part` modulo `parts`; null ids aren't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
