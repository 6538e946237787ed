"""Enrichment from lookup tables (temporaries)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import ConfigError, Unavailable

#: Bytes up to which a lookup table is sent to all tasks; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


class Provider(Protocol):
    def rows(self, spark: SparkSession, keys: DataFrame | None) -> DataFrame:
        """Rows of the lookup table for the distinct keys (one column, `key`); all rows without keys."""


class TableProvider:
    """A lookup table that Spark can read: a DataFrame, or a function that makes one."""

    def __init__(self, table: DataFrame | Callable[[SparkSession], DataFrame], key: str):
        self.table, self.key = table, key

    def rows(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        table = self.table if isinstance(self.table, DataFrame) else self.table(spark)
        if self.key not in table.columns:
            raise ConfigError(f"the lookup table has no column {self.key}")
        if keys is None:
            return sized(table)
        named = keys.select(F.col("key").cast(table.schema[self.key].dataType).alias("_key"))
        return sized(table).join(sized(named), F.col(self.key) == F.col("_key"), "left_semi")


class RedisProvider:
    def __init__(self, **config: object):
        raise Unavailable("the redis lookup needs a redis client library, which isn't installed")


def sized(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint if the optimizer's size estimate is within BROADCAST_BYTES."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def enrich(df: DataFrame, provider: Provider, on: str, key: str, how: str = "left") -> DataFrame:
    """df with the lookup's columns where df's expression `on` equals the lookup's key."""
    keyed = df.withColumn("_key", F.expr(on))
    table = provider.rows(df.sparkSession, None)  # the join finds the keys
    return keyed.join(table, keyed["_key"] == table[key], how).drop("_key")
