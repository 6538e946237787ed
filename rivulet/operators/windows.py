"""Windows over bounded data, and the join of several inputs within one window."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import ConfigError, ProcessError, QueryError
from rivulet.operators.numbering import in_ranges, numbered, with_offsets
from rivulet.packaging import ship_package


def tumbling(df: DataFrame, time: str, interval: str) -> DataFrame:
    """Add window_start and window_end of fixed windows of event time."""
    w = F.window(time, interval)
    return df.withColumn("_w", w).select("*", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")).drop("_w")


def sliding(df: DataFrame, time: str, size: str, slide: str) -> DataFrame:
    """As tumbling, with a row for each window that a row lies in."""
    return df.withColumn("_w", F.window(time, size, slide)).select("*", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")).drop("_w")


def session_bounds(df: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """One row per session: keys, session_start, session_end (last row plus gap), rows. Sessions merge where a row comes within gap.

    Without keys rows are sorted into ranges, which count the sessions that begin in them; a session goes on over as many ranges
    as it needs, and no task sees all rows. Rows without time are in no session.
    """
    if keys:
        grouped = df.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("rows"))
        return grouped.select(*keys, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "rows")
    wide = F.expr(f"INTERVAL '{gap}'")
    ranged = in_ranges(df.select(F.col(time).alias("_t")).where("_t IS NOT NULL"), ["_t"])
    lasts = sorted((r["_p"], r["last"]) for r in ranged.groupBy("_p").agg(F.max("_t").alias("last")).collect())  # one row a range
    kind = ranged.schema["_t"].dataType.simpleString()
    before = df.sparkSession.createDataFrame([(p, lasts[k - 1][1] if k else None) for k, (p, _) in enumerate(lasts)], f"_p bigint, _before {kind}")
    within = Window.partitionBy("_p").orderBy("_id")
    rows = ranged.join(F.broadcast(before), "_p").withColumn("_last", F.coalesce(F.lag("_t").over(within), "_before"))
    rows = rows.withColumn("_new", (F.col("_last").isNull() | (F.col("_t") > F.col("_last") + wide)).cast("bigint"))
    rows = rows.withColumn("_no", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows, _ = with_offsets(rows, F.max("_no"), "_start")
    grouped = rows.groupBy((F.col("_start") + F.col("_no")).alias("_session")).agg(F.min("_t").alias("session_start"), (F.max("_t") + wide).alias("session_end"), F.count(F.lit(1)).alias("rows"))
    return grouped.drop("_session")


def sliding_count(df: DataFrame, order: list[str], size: int, slide: int) -> DataFrame:
    """Add window_no to the rows of each full window of `size` rows in order, a new one every `slide` rows.

    A row lies in up to ceil(size / slide) windows; rows of a short tail are in none. Rows get their numbers without being
    brought together: sorted ranges are counted, and each range starts where the ranges before it end.
    """
    if size <= 0 or slide <= 0 or size < slide:
        raise ConfigError("window_size and slide_size must be over 0, and window_size at least slide_size")
    rows, total = numbered(df, order, "_rn")
    return window_numbers(rows, total, size, slide).drop("_rn")


def window_numbers(rows: DataFrame, total: int, size: int, slide: int) -> DataFrame:
    """rows, numbered from 0 in _rn, once for each full window that they lie in, with window_no."""
    first = F.greatest(F.floor((F.col("_rn") - size) / slide) + 1, F.lit(0))
    last = F.least(F.floor(F.col("_rn") / slide), F.lit((total - size) // slide))
    inside = rows.withColumn("_first", first.cast("bigint")).withColumn("_last", last.cast("bigint")).where("_last >= _first")
    return inside.withColumn("window_no", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def over_groups(df: DataFrame, aggregate: str, name: str, partition: list[str], order: str, before: int | None, after: int | None) -> DataFrame:
    """aggregate OVER (PARTITION BY partition ORDER BY order GROUPS BETWEEN before PRECEDING AND after FOLLOWING); None: unbounded.

    Peer groups are numbered by dense_rank, over which RANGE counts them.
    """
    if not order:
        raise QueryError("a GROUPS frame needs ORDER BY")
    spec = Window.partitionBy(*partition)
    ranked = df.withColumn("_g", F.dense_rank().over(spec.orderBy(F.col(order).asc_nulls_last())))
    frame = spec.orderBy("_g").rangeBetween(Window.unboundedPreceding if before is None else -before, Window.unboundedFollowing if after is None else after)
    return ranked.withColumn(name, F.expr(aggregate).over(frame)).drop("_g")


def over_partitions(df: DataFrame, function: Callable[..., pd.Series], name: str, returns: str, columns: list[str], partition: list[str], order: list[str]) -> DataFrame:
    """df with `name`: function(series, ...) -> series of as many values, called on each partition's rows in order (nulls last).

    For window functions that need a whole partition at once; a partition is in one worker's memory. What aggregates over frames
    can say goes through functions.python.aggregate instead.
    """
    if not partition or not order:
        raise ConfigError("a function over partitions needs columns to part by and to order by")
    ship_package(df.sparkSession)
    kind = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(returns))])

    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        values = function(*(rows[c] for c in columns))
        if len(values) != len(rows):
            raise ProcessError(f"{name}: {len(values)} values for {len(rows)} rows")
        return rows.assign(**{name: values})

    return df.groupBy(*partition).applyInPandas(apply, kind)


def seconds(interval: str) -> float:
    """Length of an interval such as `5 minutes`, `1s` or `500ms`."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*", interval)
    units = {"ms": 0.001, "millisecond": 0.001, "s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}
    unit = m[2].lower() if m else ""
    key = unit if unit in units else unit.rstrip("s")
    if key not in units:
        raise ConfigError(f"no interval: {interval!r}")
    return float(m[1]) * units[key]


def window_join(inputs: dict[str, DataFrame], time: str, interval: str, keys: list[str], how: str = "inner", select: list[Column] | None = None) -> DataFrame:
    """Join inputs on keys within the same tumbling window of event time. Windows that an input has no rows in give none.

    The window is a join key like any other, so the join is planned as an equi-join and the inputs are shuffled once.
    """
    if len(inputs) < 2:
        raise ConfigError("a window join takes two inputs at least")
    out: DataFrame | None = None
    for name, df in inputs.items():
        own = df.withColumn("window_start", F.window(time, interval)["start"]).select("window_start", *keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])
        out = own if out is None else out.join(own, ["window_start", *keys], how)
    return out if select is None else out.select(*select)
