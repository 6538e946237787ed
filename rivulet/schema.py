"""Metadata columns, raw payloads and the mapping between Arrow's type names and Spark's types."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import ConfigError, ReadError

#: The payload column and the metadata columns.
VALUE = "__value__"
META = {
    "__meta_source": T.StringType(),
    "__meta_partition": T.LongType(),
    "__meta_offset": T.LongType(),
    "__meta_key": T.BinaryType(),
    "__meta_timestamp": T.TimestampType(),
    "__meta_ingest_time": T.TimestampType(),
    "__meta_ext": T.MapType(T.StringType(), T.StringType()),
}
RAW = T.StructType([T.StructField(VALUE, T.BinaryType(), False)])

#: Arrow type names and what they are in Spark; unsigned types take the next wider signed one.
ARROW = {
    "Null": "void", "Boolean": "boolean", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)",
    "Float16": "float", "Float32": "float", "Float64": "double", "Utf8": "string", "LargeUtf8": "string", "Utf8View": "string", "Binary": "binary", "LargeBinary": "binary", "BinaryView": "binary",
    "Date32": "date", "Date64": "date",
}
SPARK_NAMES = {
    "void": "Null", "boolean": "Boolean", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "Utf8", "binary": "Binary", "date": "Date32",
    "timestamp": 'Timestamp(Microsecond, Some("UTC"))', "timestamp_ntz": "Timestamp(Microsecond, None)",
}


def spark_type(arrow: str) -> str:
    """Spark's DDL for an Arrow type name; parametric names too."""
    name = arrow.strip()
    if name in ARROW:
        return ARROW[name]
    if m := re.fullmatch(r"Timestamp\(\s*\w+\s*,\s*(None|Some\(.*\))\s*\)", name):
        return "timestamp_ntz" if m[1] == "None" else "timestamp"
    if m := re.fullmatch(r"Decimal(?:32|64|128|256)\(\s*(\d+)\s*,\s*(-?\d+)\s*\)", name):
        if int(m[1]) > 38 or int(m[2]) < 0:
            raise ConfigError(f"no decimal type of {m[1]} digits and scale {m[2]}")
        return f"decimal({m[1]},{m[2]})"
    if m := re.fullmatch(r"(?:Large|FixedSize)?List\((?:Field \{.*data_type: )?([A-Za-z0-9]+).*\)", name):
        return f"array<{spark_type(m[1])}>"
    if m := re.fullmatch(r"Dictionary\(\s*\w+\s*,\s*(.+)\)", name):
        return spark_type(m[1])
    if re.fullmatch(r"FixedSizeBinary\(\d+\)", name):
        return "binary"
    if name.startswith("Time"):
        return "time(6)"
    if name.startswith("Duration") or name == "Interval(DayTime)":
        return "interval day to second"
    if name == "Interval(YearMonth)":
        return "interval year to month"
    raise ConfigError(f"unknown Arrow type {arrow!r}")


def with_meta(df: DataFrame, source: str | None = None, partition: int | None = None, ext: dict[str, str] | None = None, ingest: bool = True) -> DataFrame:
    """Add the metadata columns that are given; constants, so they cost nothing until used."""
    if source is not None:
        df = df.withColumn("__meta_source", F.lit(source))
    if partition is not None:
        df = df.withColumn("__meta_partition", F.lit(partition).cast("bigint"))
    if ext is not None:
        df = df.withColumn("__meta_ext", F.create_map(*[F.lit(x) for kv in sorted(ext.items()) for x in kv]).cast("map<string,string>"))
    return df.withColumn("__meta_ingest_time", F.current_timestamp()) if ingest else df


def keep_columns(df: DataFrame, names: list[str] | set[str]) -> DataFrame:
    """The named columns in the order of the schema; unknown names are ignored."""
    return df.select([c for c in df.columns if c in set(names)])


def payloads(df: DataFrame, column: str = VALUE) -> DataFrame:
    """Rows with a payload. A missing column or one that isn't binary is an error; null payloads are left out."""
    if column not in df.columns:
        raise ReadError(f"not found column {column}")
    if not isinstance(df.schema[column].dataType, T.BinaryType):
        raise ReadError(f"column {column} isn't binary")
    return df.where(F.col(column).isNotNull())
