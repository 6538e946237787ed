"""Mixing sources to target weights by cube-method balanced sampling.

A source with target t and size s takes every document floor(t / s) times and once more with probability frac(t / s). The extra
copies are drawn by the cube method: the vector of probabilities moves through the null-space of the two balancing equations
(words, documents), three documents at a time, until each is 0 or 1; at most two of a block stay between. Those are dealt into
fewer blocks and go on, until one small landing problem a source remains.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import SPACE, limit_batches, written
from rivulet.operators.numbering import numbered

WORD = f"[^{SPACE}]+"
#: Documents of a block, rows that can't be told apart numbered in one step, and what counts as 0 or 1.
BLOCK, STEP, EPS = 1_000, 4_096, 1e-9


def targets(totals: DataFrame, share: float, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """totals (source, source_size and others), written, with rank and target.

    The weights repeat over the sources in order of code points, null last. A source's target is its weight times a unit, or
    `ceiling` times its size if that is less; the unit is raised until the targets make up `share` of all sizes, or none is
    below its ceiling. Sources are numbered without bringing them together, and only sums over them reach the driver.
    """
    ranked, _ = numbered(totals, ["source"], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight), "mix-sources")
    most = F.col("source_size") * ceiling
    whole = unit = full = None
    while True:
        over = F.lit(False) if unit is None else F.lit(unit) * F.col("weight") >= most
        now = ranked.agg(F.sum(F.when(over, F.col("source_size"))).alias("size"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n"), F.sum("source_size").alias("all")).first()
        whole = share * (now["all"] or 0) if whole is None else whole
        if now["n"] == full or not now["weight"]:
            return ranked.withColumn("target", F.when(over, most).otherwise(F.lit(unit or 0.0) * F.col("weight"))).drop("weight")
        unit, full = max(0.0, whole - ceiling * (now["size"] or 0)) / now["weight"], now["n"] if unit is not None else None


def fly(pi: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """Flight phase: probabilities that keep sum(pi) and sum(pi * size), at most two of them between 0 and 1.

    Documents come in the order given; three are on the move at any time.
    """
    p = pi.astype(float).tolist()
    s = size.astype(float).tolist()
    window: list[int] = []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = float(round(p[k]))
            continue
        window.append(k)
        while len(window) == 3:
            a, b, c = window
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])  # of the null-space of the rows (1, 1, 1) and (s_a, s_b, s_c)
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(window, u) if x)
            down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(window, u) if x)
            step = up if rng.random() * (up + down) < down else -down
            for i, x in zip(window, u):
                p[i] = min(1.0, max(0.0, p[i] + step * x))
            for i in window:
                if p[i] <= EPS or p[i] >= 1 - EPS:
                    p[i] = float(round(p[i]))
            window = [i for i in window if 0 < p[i] < 1]
    return np.array(p)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing: the at most two probabilities left become 0 or 1 so that words, then documents, stray least."""
    p = pi.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        own, weight = p[open_], size[open_].astype(float)
        p[open_] = min(np.ndindex(*[2] * len(open_)), key=lambda x: (abs(float(((np.array(x) - own) * weight).sum())), abs(float((np.array(x) - own).sum())), x))
    return p


def round_of(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Flight of one block's documents, large ones first; and landing in the last round."""

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie"], ascending=[False, True], kind="stable")
        pi = fly(pdf["pi"].to_numpy(), pdf["size"].to_numpy(), random.Random(f"{seed}:{pdf['rank'].iloc[0]}:{pdf['block'].iloc[0]}"))
        return pdf.assign(pi=land(pi, pdf["size"].to_numpy()) if last else pi)

    return move


def words(column: str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ceiling: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per document: id_col, size (words), source, source_size, target (of its source), copies, taken (words, repeats counted),
    text_hash (xxhash64 of the text, which tells rows with one id apart).

    Null texts have 0 words. The null source is a source of its own and comes last in the order. No document is taken more
    than ceil(`ceiling`) times, so its words are at most that times its size. A source without words has target 0. Draws
    depend on ids, sources, sizes, texts and the seed alone, so reruns agree; rows that agree in all of them are drawn on their
    own. All but two documents of a source at most are drawn with probabilities that keep its words and its number of documents;
    those land so that its words stray least. Ids may be null or of any type that sorts. Other columns are ignored.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), F.xxhash64(text_col).alias("h")).hint("rebalance"), "mix-sizes")  # small rows: not a file a task
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(totals, share, weights, ceiling).withColumn("whole", F.floor(rate + EPS).cast("int")).withColumn("pi", F.greatest(F.lit(0.0), rate - F.col("whole")))
    sources = plan.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    alike = sized.groupBy("id", "source", "size", "h").agg(F.count(F.lit(1)).alias("m"))
    # rows that can't be told apart get numbers, in two steps: none makes an array of all of them
    alike = alike.withColumn("high", F.explode(F.sequence(F.lit(0), F.expr(f"(m - 1) div {STEP}"))))
    alike = alike.withColumn("low", F.explode(F.sequence(F.lit(0), F.least(F.lit(STEP), F.col("m") - F.col("high") * STEP) - 1)))
    state = alike.withColumn("tie", F.xxhash64(F.lit(seed), F.col("id").cast("string"), "source", "size", "h", "high", "low"))
    state = state.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("id", "size", "h", "rank", "pi", "blocks", "tie")
    state = state.withColumn("block", F.pmod("tie", F.col("blocks")).cast("int"))
    most, rounds = sources.agg(F.max("blocks")).first()[0] or 1, []
    while True:
        last = most <= 1
        kind = state.schema
        done = written(state.groupBy("rank", "block").applyInPandas(round_of(seed, last), kind), "mix-round")
        fixed = (F.col("pi") == 0) | (F.col("pi") == 1)
        rounds.append(done.where(fixed))
        if last:
            break
        most = -(-2 * most // BLOCK)
        state = done.where(~fixed).withColumn("blocks", F.ceil(2 * F.col("blocks") / BLOCK).cast("int")).withColumn("block", F.pmod("tie", F.col("blocks")).cast("int"))
    drawn = rounds[0]
    for more in rounds[1:]:
        drawn = drawn.union(more)
    copies = F.col("whole") + F.col("pi").cast("int")
    return drawn.select("id", "size", "h", "rank", "pi").join(sources.drop("pi"), "rank").select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), F.col("h").alias("text_hash")
    )
