"""The few functions without a Spark built-in, as Arrow-batched functions, and the registries of users' own functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rivulet.errors import ConfigError
from rivulet.functions.blake3 import blake3
from rivulet.packaging import ship_package


def hashed(name: str) -> Callable:
    digest = blake3 if name == "blake3" else lambda data: getattr(hashlib, name)(data).digest()

    @F.pandas_udf("binary")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else digest(bytes(v)))

    return apply


def register(spark: SparkSession) -> None:
    """digest's BLAKE algorithms."""
    ship_package(spark)
    for name in ("blake2s", "blake2b", "blake3"):
        spark.udf.register(f"rivulet_{name}", hashed(name))


class Registry:
    """Users' functions of one kind; a name can be given once."""

    def __init__(self, kind: str):
        self.kind, self.functions, self.known = kind, {}, {}

    def add(self, name: str, function: Callable) -> None:
        if name in self.functions:
            raise ConfigError(f"{self.kind} function {name} is there already")
        self.functions[name] = function

    def register(self, spark: SparkSession) -> None:
        """Make all of them callable by name in SQL."""
        for name, function in self.functions.items():
            if self.known.get((id(spark), name)) is not function:
                spark.udf.register(name, function)
                self.known[id(spark), name] = function

    def clear(self) -> None:
        self.functions.clear()


SCALAR, AGGREGATE, WINDOW = Registry("scalar"), Registry("aggregate"), Registry("window")


def scalar(name: str, returns: str) -> Callable[[Callable], Callable]:
    """Register f(series, ...) -> series, called on Arrow batches."""

    def add(f: Callable) -> Callable:
        SCALAR.add(name, F.pandas_udf(f, returns))
        return f

    return add


def aggregate(name: str, returns: str, window: bool = False) -> Callable[[Callable], Callable]:
    """Register f(series, ...) -> value, for groups and, as Spark allows it, for window frames."""

    def add(f: Callable) -> Callable:
        from pyspark.sql.pandas.functions import PandasUDFType

        (WINDOW if window else AGGREGATE).add(name, F.pandas_udf(f, returns, PandasUDFType.GROUPED_AGG))
        return f

    return add


def register_all(spark: SparkSession) -> None:
    """Make the users' functions callable in the session's SQL (queries in the dialect do so themselves)."""
    for kind in (SCALAR, AGGREGATE, WINDOW):
        kind.register(spark)
