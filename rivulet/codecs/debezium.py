"""Change-data-capture envelopes (Debezium JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.codecs import json as json_codec
from rivulet.errors import ReadError
from rivulet.schema import VALUE, payloads


def decode(df: DataFrame, row: str | None = None, column: str = VALUE) -> DataFrame:
    """One row per envelope: the fields of `after` (of `before` for deletes), then op, ts_ms, source_db, source_table, and before
    and source as JSON text (`null` where they are missing).

    row: DDL of the row's fields (`id bigint, name string`); without it, the first envelope tells. A payload that isn't JSON
    raises an error.
    """
    rows = payloads(df, column).select(F.col(column).cast("string").alias("_v"))
    if row is None:
        first = rows.select(F.coalesce(F.get_json_object("_v", "$.after"), F.get_json_object("_v", "$.before")).alias("r")).where("r IS NOT NULL").first()
        if first is None:
            raise ReadError("no row to infer a schema from")
        ddl = df.sparkSession.range(1).select(F.schema_of_json(F.lit(first["r"]))).first()[0]
        row = ddl[len("STRUCT<") : -1]
    kind = T._parse_datatype_string(f"struct<{row}>" if ":" in row else row)
    envelope = T.StructType([T.StructField("before", kind), T.StructField("after", kind), T.StructField("op", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("source", T._parse_datatype_string("db string, table string"))])
    parsed = rows.select("_v", F.from_json("_v", envelope, {"mode": "FAILFAST"}).alias("_e"))
    own = [F.coalesce(F.col(f"_e.after.{f.name}"), F.when(F.col("_e.after").isNull(), F.col(f"_e.before.{f.name}"))).alias(f.name) for f in kind.fields]
    text = lambda name: F.coalesce(F.get_json_object("_v", f"$.{name}"), F.lit("null")).alias(name)
    return parsed.select(*own, F.col("_e.op").alias("op"), F.col("_e.ts_ms").alias("ts_ms"), F.col("_e.source.db").alias("source_db"), F.col("_e.source.table").alias("source_table"), text("before"), text("source"))


encode = json_codec.encode
