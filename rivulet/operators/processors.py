"""Processors: functions from one DataFrame to another, chained by transform()."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.codecs.json import infer, to_json_value
from rivulet.errors import ConfigError, ProcessError
from rivulet.operators.lookup import Provider
from rivulet.packaging import ship_package
from rivulet.plans.dialect import expression, query, translate
from rivulet.schema import VALUE, keep_columns, payloads

Processor = Callable[[DataFrame], DataFrame]


def chain(*processors: Processor) -> Processor:
    def run(df: DataFrame) -> DataFrame:
        for p in processors:
            df = df.transform(p)
        return df

    return run


def sql(text: str, table: str = "flow", temporaries: dict[str, Provider | tuple[Provider, dict]] | None = None) -> Processor:
    """One SELECT over the batch as `table`, and over the lookup tables by their names. The text is checked when this is built.

    temporaries: a provider, or with it the key: {"expr": over the batch} or {"value": text}. With a key the lookup table has the
    rows of the batch's distinct keys only.
    """
    translate(text)
    lookups = {name: one if isinstance(one, tuple) else (one, None) for name, one in (temporaries or {}).items()}
    for _, key in lookups.values():
        if key is not None and ("expr" in key) == ("value" in key):
            raise ConfigError("a key has one of expr and value")
        if key and "expr" in key:
            expression(key["expr"])

    def run(df: DataFrame) -> DataFrame:
        tables = {table: df}
        for name, (provider, key) in lookups.items():
            keys = None
            if key is not None:
                keys = df.select(F.expr(expression(key["expr"])).alias("key")).distinct() if "expr" in key else df.sparkSession.createDataFrame([(key["value"],)], "key string")
            tables[name] = provider.rows(df.sparkSession, keys)
        return query(df.sparkSession, text, **tables)

    return run


def json_to_arrow(value_field: str = VALUE, fields: list[str] | None = None, schema: str | T.StructType | None = None) -> Processor:
    """JSON payloads to columns, which replace the batch's. Without schema it is inferred from the first payload."""

    def run(df: DataFrame) -> DataFrame:
        rows = payloads(df, value_field)
        kind = schema or infer(rows, value_field)
        out = rows.select(F.from_json(F.col(value_field).cast("string"), kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        return keep_columns(out, fields) if fields else out

    return run


def arrow_to_json(value_field: str = VALUE, fields: list[str] | None = None) -> Processor:
    """Add each row as JSON text in `value_field`; `fields` limits the JSON, not the columns."""
    return lambda df: df.withColumn(value_field, to_json_value(df, fields))


def batch(count: int | None = None, timeout_ms: int | None = None) -> Processor:
    """Batches are Spark's own; rows stay as they are. In streams, triggers and source limits say how many come together."""
    if count is not None and count <= 0:
        raise ConfigError("count must be over 0")
    return lambda df: df


def python(function: Callable[[pa.RecordBatch], list[pa.RecordBatch]] | None = None, schema: str | T.StructType | None = None, script: str | None = None, module: str | None = None, name: str = "process", python_path: list[str] | None = None) -> Processor:
    """A function from a record batch to a list of record batches, called on Arrow batches in the executors' Python.

    Without schema the function is called once on the batch's first rows to learn it. script: Python text that defines `name`;
    module: an importable module that does.
    """
    if function is None:
        if (script is None) == (module is None):
            raise ConfigError("python takes one of function, script and module")
        if script is not None:
            space: dict = {}
            exec(compile(script, "<script>", "exec"), space)  # noqa: S102  the user's own code
            function = space.get(name)
        else:
            sys.path[:0] = python_path or []
            function = getattr(importlib.import_module(module), name, None)
        if not callable(function):
            raise ConfigError(f"no function {name}")

    def checked(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = function(batch)
        if not isinstance(out, list):
            raise ProcessError("a Python processor returns a list of record batches")
        return out

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from checked(b)

    def run(df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        kind = schema
        if kind is None:
            sample = df.limit(10).toArrow().combine_chunks().to_batches()
            made = checked(sample[0]) if sample else []
            if not made:
                return df.limit(0)
            from pyspark.sql.pandas.types import from_arrow_schema

            kind = from_arrow_schema(made[0].schema)
        return df.mapInArrow(apply, kind)

    return run
