"""Protobuf payloads of flat messages, decoded and encoded in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import ConfigError, ReadError
from rivulet.packaging import ship_package
from rivulet.schema import VALUE, payloads

#: protobuf's scalar types and Spark's; unsigned ones take the next wider type.
TYPES = {
    "double": "double", "float": "float", "int32": "int", "sint32": "int", "sfixed32": "int", "int64": "bigint", "sint64": "bigint", "sfixed64": "bigint", "uint32": "bigint", "fixed32": "bigint",
    "uint64": "decimal(20,0)", "fixed64": "decimal(20,0)", "bool": "boolean", "string": "string", "bytes": "binary",
}


def parse(proto: str, message: str) -> tuple[str, list[tuple[str, str, int]], dict[str, list[tuple[str, int]]]]:
    """Package, the message's fields (type, name, number) and the enums of proto3 text. Only flat messages are supported."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", proto, flags=re.S)
    package = m[1] if (m := re.search(r"\bpackage\s+([\w.]+)\s*;", text)) else ""
    name = message.removeprefix(f"{package}.") if package else message
    m = re.search(rf"\bmessage\s+{re.escape(name)}\s*\{{([^{{}}]*)\}}", text)
    if not m:
        raise ConfigError(f"no flat message {message}")
    enums = {e[1]: [(k[0], int(k[1])) for k in re.findall(r"(\w+)\s*=\s*(-?\d+)\s*;", e[2])] for e in re.finditer(r"\benum\s+(\w+)\s*\{([^{}]*)\}", text)}
    fields = []
    for line in filter(None, (x.strip() for x in m[1].split(";"))):
        f = re.fullmatch(r"([\w.]+)\s+(\w+)\s*=\s*(\d+)(?:\s*\[.*\])?", line)
        if not f or f[1] in ("repeated", "optional", "map", "oneof") or (f[1] not in TYPES and f[1] not in enums):
            raise ConfigError(f"unsupported field: {line}")
        fields.append((f[1], f[2], int(f[3])))
    return package, fields, enums


def spark_schema(proto: str, message: str) -> T.StructType:
    _, fields, _ = parse(proto, message)
    return T.StructType([T.StructField(name, T._parse_datatype_string(TYPES.get(kind, "int"))) for kind, name, _ in fields])


@lru_cache(maxsize=64)
def message_class(proto: str, message: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    package, fields, enums = parse(proto, message)
    file = descriptor_pb2.FileDescriptorProto(name=f"rivulet_{abs(hash((proto, message)))}.proto", package=package, syntax="proto3")
    for name, values in enums.items():
        e = file.enum_type.add(name=name)
        for k, v in values:
            e.value.add(name=k, number=v)
    own = file.message_type.add(name=message.removeprefix(f"{package}."))
    for kind, name, number in fields:
        f = own.field.add(name=name, number=number, label=descriptor_pb2.FieldDescriptorProto.LABEL_OPTIONAL)
        if kind in enums:
            f.type, f.type_name = descriptor_pb2.FieldDescriptorProto.TYPE_ENUM, f".{package + '.' if package else ''}{kind}"
        else:
            f.type = getattr(descriptor_pb2.FieldDescriptorProto, f"TYPE_{kind.upper()}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"{package + '.' if package else ''}{own.name}"))


def load(paths: list[str]) -> str:
    """The text of .proto files and of those in folders."""
    files = [f for p in map(Path, paths) for f in (sorted(p.glob("*.proto")) if p.is_dir() else [p])]
    if not files:
        raise ConfigError("no .proto files")
    return "\n".join(f.read_text() for f in files)


def decode(df: DataFrame, proto: str, message: str, column: str = VALUE, fields: list[str] | None = None) -> DataFrame:
    """The message's fields as columns, in place of all others; fields that a payload leaves out have their default."""
    return decode_by_id(df.withColumn("schema_id", F.lit(0).cast("bigint")), {0: proto}, message, column, fields)


def decode_by_id(df: DataFrame, protos: dict[int, str], message: str, column: str = VALUE, fields: list[str] | None = None) -> DataFrame:
    """The fields of payloads of several versions of a message, told apart by the column schema_id, in one pass; null where a version
    has no such field. A field's type is that of the first version that has it."""
    versions = {number: spark_schema(proto, message) for number, proto in protos.items()}
    known: dict[str, T.StructField] = {}
    for schema in versions.values():
        for f in schema.fields:
            known.setdefault(f.name, f)
    own = [f for f in known.values() if not fields or f.name in fields]
    out, has = T.StructType(own), {number: set(schema.names) for number, schema in versions.items()}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        from pyspark.sql.pandas.types import to_arrow_schema

        kind, classes = to_arrow_schema(out), {number: message_class(proto, message) for number, proto in protos.items()}
        for batch in batches:
            rows = []
            for number, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = classes[number]()
                try:
                    m.ParseFromString(bytes(v))
                except Exception as e:
                    raise ReadError(f"no {message}: {e}") from e
                rows.append((has[number], m))
            columns = []
            for f in own:
                values = [getattr(m, f.name) if f.name in names else None for names, m in rows]
                if isinstance(f.dataType, T.DecimalType):
                    values = [None if v is None else Decimal(v) for v in values]
                columns.append(pa.array(values, kind.field(f.name).type))
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    ship_package(df.sparkSession)
    return payloads(df, column).select("schema_id", column).mapInArrow(apply, out)


def encode(df: DataFrame, proto: str, message: str, column: str = VALUE) -> DataFrame:
    """Add the payload of each row; null fields are left unset, columns without a field are left out."""
    known = [f.name for f in spark_schema(proto, message).fields if f.name in df.columns]
    others = [c for c in df.columns if c != column]
    out = T.StructType([*(df.schema[c] for c in others), T.StructField(column, T.BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = message_class(proto, message)
        for batch in batches:
            values = []
            for row in batch.select(known).to_pylist():
                m = cls()
                for k, v in row.items():
                    if v is not None:
                        setattr(m, k, int(v) if type(v).__name__ == "Decimal" else v)
                values.append(m.SerializeToString())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(values, pa.binary())], names=[*others, column])

    ship_package(df.sparkSession)
    return df.select(others).mapInArrow(apply, out) if others else df.select(F.lit(None).cast("binary").alias(column))
