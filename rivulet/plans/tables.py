"""Registered queries: what they run, and SQL that says the same for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.plans import dialect
from rivulet.session import configure

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def used(text: str) -> list[str]:
    """Tables that a query names."""
    words = {t.text.lower() for t in dialect.tokens(text) if t.kind == "word"}
    return [t for t in TABLES if t in words]


def sql(name: str, text: str, oracle: str | None = "") -> None:
    """A query in the dialect. oracle: its SQL for the other engine; the same text unless given, None where there is none."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return dialect.query(spark, text, **{t: load(spark, sf_dir, t) for t in used(text)})

    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle or text


def frame(name: str, oracle: str | None) -> Callable[[Query], Query]:
    """A query in the DataFrame API."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add
