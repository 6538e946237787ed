"""JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import ReadError
from rivulet.schema import VALUE, keep_columns, payloads


def infer(df: DataFrame, column: str = VALUE) -> str:
    """DDL of the first payload. Integers beyond 64 bits are decimals; null fields are strings."""
    first = df.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").first()
    if first is None:
        raise ReadError("no payload to infer a schema from")
    ddl = df.sparkSession.range(1).select(F.schema_of_json(F.lit(first["v"]))).first()[0]
    if not ddl.startswith("STRUCT<"):
        raise ReadError("a JSON payload must be an object")
    return ddl.replace(": VOID", ": STRING")


def decode(df: DataFrame, schema: str | T.StructType | None = None, column: str = VALUE) -> DataFrame:
    """Columns of the payloads' objects, in place of the payload; other columns stay. A bad payload is an error."""
    rows = payloads(df, column)
    parsed = F.from_json(F.col(column).cast("string"), schema or infer(rows, column), {"mode": "FAILFAST"})
    others = [c for c in df.columns if c != column]
    return rows.select(*others, parsed.alias("_r")).select(*others, "_r.*")


def to_json_value(df: DataFrame, fields: list[str] | None = None) -> Column:
    """Each row as JSON bytes; null fields are left out."""
    own = keep_columns(df, fields).columns if fields else df.columns
    return F.to_json(F.struct(*own)).cast("binary")


def encode(df: DataFrame) -> DataFrame:
    """One JSON line per row, in the payload column."""
    return df.select(to_json_value(df).alias(VALUE))
