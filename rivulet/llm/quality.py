"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass turns texts into a few statistics each, which are written to the shared folder. Standardised statistics become random
Fourier features (a Gaussian kernel's approximation); each task sums its part of the normal equations, the driver solves them.
Raw scores are calibrated by pooling adjacent violators over a fixed number of score bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import limit_batches, scan_bytes, tree_sum, utf8, written
from rivulet.llm.language_id import held_out

#: Random features, ridge penalty per labelled row, bins of the raw score and their range, seed.
FEATURES, RIDGE, BINS, LOW, HIGH, SEED = 256, 1e-3, 400, -0.5, 1.5, 29
STATISTICS = (
    "log_bytes", "log_words", "bytes_per_word", "distinct_words", "top_word", "upper", "lower", "digits", "other_ascii", "beyond_ascii", "full_stops_commas", "exclamations", "marks", "bars",
    "spaces", "capital_words", "longest_word", "log_lines", "bytes_per_line", "repeated_lines", "closed_lines", "entropy",
)


def statistics(text: bytes) -> list[float]:
    """STATISTICS of one text; all finite, for the empty text too."""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    uses = Counter(words)
    some, w = max(1, n), max(1, len(words))
    share = hist[hist > 0] / some

    def part(chars: bytes) -> float:
        return float(hist[list(chars)].sum()) / some

    return [
        np.log1p(n), np.log1p(len(words)), min(60.0, n / w), len(uses) / w, max(uses.values(), default=0) / w, float(hist[65:91].sum()) / some, float(hist[97:123].sum()) / some,
        float(hist[48:58].sum()) / some, float(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()) / some, float(hist[128:].sum()) / some,
        part(b".,"), part(b"!"), part(b"#$%&*+@^~"), part(b"|<>{}[]\\"), part(b" "), sum(map(bytes.isupper, words)) / w, min(100.0, max(map(len, words), default=0)),
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(full)) / max(1, len(full)), sum(x.rstrip()[-1:] in b".!?" for x in full) / max(1, len(full)), float(-(share * np.log(share)).sum()),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


def slices(x: np.ndarray, rows: int = 1024) -> list[np.ndarray]:
    """x in parts whose random features are a few MB."""
    return [x[k : k + rows] for k in range(0, len(x), rows)]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray | None
    points: np.ndarray  # calibration: raw scores, ascending, ...
    values: np.ndarray  # ... and their calibrated ones
    constant: float = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant one."""
        rng = np.random.default_rng(SEED)
        width = x.shape[1]
        w = rng.normal(0, 1 / np.sqrt(width), (width, FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.constant)
        raw = [self.raw(part) for part in slices(x)]
        return np.clip(np.interp(np.concatenate(raw) if raw else np.empty(0), self.points, self.values), 0.0, 1.0)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Nearest non-decreasing values, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(y, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "x", columns: list[str] | None = None) -> DataFrame:
    """The rows of docs with its columns (or some of them) and `out`: an array of STATISTICS. Null texts count as empty; a column named
    like `out` is replaced."""
    columns = [c for c in docs.columns if c != out] if columns is None else columns
    work = docs.select(*columns, utf8(text_col).alias(f"__{out}_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(x), pa.list_(pa.float64()))], names=[*columns, out])

    limit_batches(docs.sparkSession)
    return work.mapInArrow(count, T.StructType([*work.schema.fields[:-1], T.StructField(out, T.ArrayType(T.DoubleType()))]))


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, x: an array of STATISTICS."""
    return with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", columns=["id"])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Learn from the labelled rows of stats. Rows with null ids or labels are left out; repeated labels count as often as they
    stand there. Without labels of both kinds the score is a constant: the labels' mean, or 0.5 without any."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    rows = written(stats.join(known, "id").select("x", "y"), "quality-rows")
    width = len(STATISTICS)
    parts = 1 + scan_bytes(rows, "x") // (16 << 20)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * width)
        for batch in batches:
            x, y = np.array(batch.column(0).to_pylist(), float).reshape(-1, width), batch.column(1).to_numpy()
            total += np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(["all"]), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    got = tree_sum(rows.mapInArrow(moments, "k string, v binary"), "k", "v", parts).first()
    total = np.frombuffer(got["v"], np.float64) if got else np.zeros(2 + 2 * width)
    n, y = total[0], total[1]
    if not n or y in (0.0, n):
        return QualityModel(np.zeros(width), np.ones(width), None, np.zeros(1), np.zeros(1), float(y / n) if n else 0.5)
    mean = total[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(0, total[2 + width :] / n - mean * mean))
    model = QualityModel(mean, np.where(scale > 1e-6, scale, 1.0), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    size = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for x, y in zip(slices(np.array(batch.column(0).to_pylist(), float).reshape(-1, width)), slices(batch.column(1).to_numpy())):
                z = model.features(x)
                a += z.T @ z
                b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(["all"]), pa.array([np.concatenate([a.ravel(), b]).tobytes()], pa.binary())], names=["k", "v"])

    total = np.frombuffer(tree_sum(rows.mapInArrow(equations, "k string, v binary"), "k", "v", parts).first()["v"], np.float64)
    a, b = total[: size * size].reshape(size, size), total[size * size :]
    penalty = RIDGE * n * np.eye(size) / FEATURES
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(a + penalty, b)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.concatenate([model.raw(x) for x in slices(np.array(batch.column(0).to_pylist(), float).reshape(-1, width))])
            bins = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
            at = np.unique(bins)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(bins, batch.column(1).to_numpy(), BINS)[at]), pa.array(np.bincount(bins, minlength=BINS)[at].astype(float))], names=["bin", "y", "n"])

    bins = sorted(rows.mapInArrow(binned, "bin long, y double, n double").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect())  # BINS rows at most
    y, n = np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins])
    model.points = LOW + (np.array([r["bin"] for r in bins]) + 0.5) * (HIGH - LOW) / BINS
    model.values = isotonic(y / n, n)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 3, part: int = 1) -> tuple[QualityModel, DataFrame]:
    """Model from the labelled documents that aren't held out, and every document's statistics."""
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    return train_on(stats, labels, id_col, label_col, parts, part), stats


def train_on(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", parts: int = 3, part: int = 1) -> QualityModel:
    """Model from the rows of stats (id, x) that have labels and aren't held out."""
    return fit(stats.where(~held_out("id", parts, part)), labels, id_col, label_col)


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """id, score (0 to 1), for each row of stats."""
    width = len(STATISTICS)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(np.array(batch.column(1).to_pylist(), float).reshape(-1, width)))], names=["id", "score"])

    return stats.select("id", "x").mapInArrow(apply, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def keep_good(rows: DataFrame, model: QualityModel, statistics: str = "x", least: float = 0.5) -> DataFrame:
    """The rows that score at least `least`, without the column of statistics (of with_statistics). One pass, no shuffle; texts stay in the JVM."""

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(x.tolist(), float).reshape(-1, len(STATISTICS))))

    return rows.where(scored(statistics) >= least).drop(statistics)
