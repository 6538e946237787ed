"""Codecs by name, as sources and sinks use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rivulet.codecs import debezium, json, protobuf, registry
from rivulet.errors import ConfigError, ReadError
from rivulet.schema import VALUE


def decoder(config: dict | None) -> Callable[[DataFrame], DataFrame]:
    """Payload DataFrames to columns; without a codec they stay as they are."""
    if not config:
        return lambda df: df
    kind = config.get("type")
    if kind == "json":
        return lambda df: json.decode(df, config.get("schema"))
    if kind == "debezium_json":
        return lambda df: debezium.decode(df, config.get("row"))
    if kind == "protobuf":
        proto = protobuf.load(config["proto_inputs"]) if "proto_inputs" in config else config["proto"]
        return lambda df: protobuf.decode(df, proto, config["message_type"])
    if kind == "schema_registry":
        if url := config.get("url") or config.get("registry_url"):
            resolver = registry.HttpResolver(url, config["message_type"], config.get("auth"))
            return lambda df: registry.decode(df, resolver)
        schemas = {int(k): v for k, v in config.get("schemas", {}).items()}
        resolve = {k: (lambda df, v=v: protobuf.decode(df, v["proto"], v["message_type"])) for k, v in schemas.items()}
        return lambda df: registry.decode(df, resolve)
    raise ConfigError(f"unknown codec {kind!r}")


def encoder(config: dict | None) -> Callable[[DataFrame], DataFrame]:
    """Columns to payloads; without a codec there must be a payload column."""
    kind = (config or {}).get("type")
    if kind in ("json", "debezium_json"):
        return json.encode
    if kind == "protobuf":
        proto = protobuf.load(config["proto_inputs"]) if "proto_inputs" in config else config["proto"]
        return lambda df: protobuf.encode(df, proto, config["message_type"]).select(VALUE)
    if kind is not None:
        raise ConfigError(f"codec {kind!r} doesn't encode")

    def own(df: DataFrame) -> DataFrame:
        if VALUE not in df.columns:
            raise ReadError(f"not found column {VALUE}, and no codec")
        return df.select(VALUE)

    return own
