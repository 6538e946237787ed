"""Windows over streams: the same grouping as operators.windows, with watermarks.

Time is an event-time column (by default the ingest time). Windows close when the watermark passes their end, so the last open
window of a bounded replay stays open; bounded data goes through operators.windows instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rivulet.errors import ConfigError
from rivulet.packaging import ship_package


def tumbling(df: DataFrame, time: str, interval: str, *aggregates: F.Column, keys: tuple[str, ...] = (), late: str = "0 seconds") -> DataFrame:
    grouped = df.withWatermark(time, late).groupBy(F.window(time, interval).alias("_w"), *keys).agg(*aggregates)
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in grouped.columns if c != "_w"])


def session(df: DataFrame, time: str, gap: str, *aggregates: F.Column, keys: tuple[str, ...] = (), late: str = "0 seconds") -> DataFrame:
    grouped = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*aggregates)
    return grouped.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *[c for c in grouped.columns if c != "_w"])


def sliding_count(df: DataFrame, key: str, order: str, value: str, size: int, slide: int) -> DataFrame:
    """Per key: window_no and values (an array) of each full window of `size` rows, a new one every `slide` rows.

    The state of a key is at most the rows that a later window still needs. Rows of one micro-batch are put in order.
    """
    if size <= 0 or slide <= 0 or size < slide:
        raise ConfigError("window_size and slide_size must be over 0, and window_size at least slide_size")
    ship_package(df.sparkSession)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values("_o", kind="stable")
        out = []
        for v in rows["_v"]:
            held.append(float(v))
            if len(held) == size:
                out.append((group[0], number, list(held)))
                held, number = held[slide:], number + 1
        state.update((held, number))
        yield pd.DataFrame(out, columns=["key", "window_no", "values"])

    rows = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    kind = df.schema[key].dataType.simpleString()
    return rows.groupBy("_k").applyInPandasWithState(step, f"key {kind}, window_no bigint, values array<double>", "held array<double>, number bigint", "append", GroupStateTimeout.NoTimeout)


def window_join(inputs: dict[str, DataFrame], time: str, interval: str, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """Equi-join of two streams within the same tumbling window; state older than the watermark is dropped."""
    if len(inputs) != 2:
        raise ConfigError("the streaming equi-join takes two inputs; more go through window_query")
    sides = []
    for name, df in inputs.items():
        plain = lambda c: F.col(c) + F.expr("INTERVAL '0' SECOND") if c == time else F.col(c)  # noqa: E731  no second event time beside the window
        sides.append(df.withWatermark(time, late).select(F.window(time, interval).alias("window"), *keys, *[plain(c).alias(f"{name}_{c}") for c in df.columns if c not in keys]))
    return sides[0].join(sides[1], ["window", *keys]).withColumn("window_start", F.col("window.start")).drop("window")
