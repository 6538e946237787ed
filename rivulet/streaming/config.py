"""Configurations: loading, checks before a start, redaction, kept versions, and the schema of what they may hold."""

from __future__ import annotations

import json
import os
import time
import tomllib
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

from rivulet.errors import ConfigError, EngineError, Unavailable

#: Parts of key names whose values are secret.
SECRET = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential", "authorization")
REDACTED = "******"
TEXT, NUMBER, FLAG, LIST, TABLE, ANY, PAIRS = ({"type": t} for t in ("string", "integer", "boolean", "array", "object", ["string", "object"], ["array", "object"]))
SPAN = {"type": "string", "description": "a length of time such as 500ms, 10s or 5 minutes"}

#: Components by kind and name: what each is for, its keys, and which of them it needs.
COMPONENTS: dict[str, dict[str, tuple[str, dict[str, dict], tuple[str, ...]]]] = {
    "input": {
        "file": ("files of one format", {"path": TEXT, "format": TEXT, "input_type": ANY, "query": ANY, "schema": TEXT, "options": TABLE, "store": TABLE, "max_files_per_batch": NUMBER}, ("path",)),
        "generate": ("one payload again and again", {"context": TEXT, "interval": SPAN, "batch_size": NUMBER, "count": NUMBER}, ("context",)),
        "http": ("payloads of requests, which a receiver lands as files", {"landing": TEXT, "address": TEXT, "path": TEXT, "method": TEXT, "interval": SPAN, "cors_enabled": FLAG, "auth": TABLE}, ()),
        "kafka": ("topics of Kafka", {"brokers": LIST, "topics": LIST, "consumer_group": TEXT, "client_id": TEXT, "start_from_latest": FLAG, "fetch_min_bytes": NUMBER, "fetch_max_bytes": NUMBER, "fetch_max_partition_bytes": NUMBER, "fetch_wait_max_ms": NUMBER, "max_rows_per_batch": NUMBER}, ("brokers", "topics")),
        "memory": ("a fixed list of messages", {"messages": LIST}, ()),
        "modbus": ("registers of Modbus devices", {"addr": TEXT, "slave_id": NUMBER, "points": LIST, "interval": SPAN}, ("addr", "points")),
        "mqtt": ("topics of an MQTT broker", {"host": TEXT, "port": NUMBER, "topics": LIST, "client_id": TEXT, "username": TEXT, "password": TEXT, "qos": NUMBER, "clean_session": FLAG, "keep_alive": NUMBER}, ("host", "port", "topics")),
        "multiple_inputs": ("several named inputs", {"inputs": LIST}, ("inputs",)),
        "nats": ("subjects of NATS", {"url": TEXT, "mode": ANY, "auth": TABLE}, ("url",)),
        "pulsar": ("a topic of Pulsar", {"service_url": TEXT, "topic": TEXT, "subscription_name": TEXT, "subscription_type": TEXT, "auth": TABLE, "retry_config": TABLE}, ("service_url", "topic")),
        "redis": ("channels or lists of Redis", {"mode": ANY, "redis_type": ANY}, ("mode",)),
        "sql": ("a SELECT over databases", {"url": TEXT, "select_sql": TEXT, "input_type": TABLE, "tables": TABLE, "fetchsize": NUMBER, "options": TABLE, "partition_column": TEXT, "lower_bound": ANY, "upper_bound": ANY, "num_partitions": NUMBER, "poll_interval": SPAN}, ("select_sql",)),
        "websocket": ("messages of a WebSocket", {"url": TEXT, "headers": TABLE, "timeout": SPAN}, ("url",)),
    },
    "output": {
        "drop": ("nothing is kept", {}, ()),
        "file": ("files of one format", {"path": TEXT, "format": TEXT, "mode": TEXT, "options": TABLE}, ("path",)),
        "http": ("a request for each payload", {"url": TEXT, "method": TEXT, "headers": TABLE, "auth": TABLE, "body_field": TEXT, "retry_count": NUMBER, "timeout_ms": NUMBER}, ("url",)),
        "influxdb": ("line protocol to InfluxDB", {"url": TEXT, "org": TEXT, "bucket": TEXT, "token": TEXT, "measurement": ANY, "tags": PAIRS, "fields": PAIRS, "timestamp": TEXT, "timestamp_field": TEXT, "flush_interval": SPAN, "batch_size": NUMBER, "retry_count": NUMBER, "timeout_ms": NUMBER}, ("url", "org", "bucket", "measurement", "fields")),
        "kafka": ("records of Kafka topics", {"brokers": LIST, "topic": ANY, "key": ANY, "acks": TEXT, "client_id": TEXT, "compression": TEXT, "value_field": TEXT, "exactly_once": FLAG, "transactional_id": TEXT}, ("brokers", "topic")),
        "memory": ("a list (tests)", {"rows": LIST}, ("rows",)),
        "mongodb": ("documents of MongoDB", {"uri": TEXT, "database": TEXT, "collection": TEXT}, ("uri", "database", "collection")),
        "mqtt": ("a topic of an MQTT broker", {"host": TEXT, "port": NUMBER, "topic": ANY, "client_id": TEXT, "username": TEXT, "password": TEXT, "qos": NUMBER, "clean_session": FLAG, "keep_alive": NUMBER, "retain": FLAG, "value_field": TEXT}, ("host", "port", "topic")),
        "nats": ("subjects of NATS", {"url": TEXT, "mode": ANY, "auth": TABLE, "value_field": TEXT}, ("url",)),
        "pulsar": ("a topic of Pulsar", {"service_url": TEXT, "topic": ANY, "auth": TABLE, "value_field": TEXT}, ("service_url", "topic")),
        "redis": ("channels or lists of Redis", {"mode": ANY, "redis_type": ANY, "value_field": TEXT}, ("mode",)),
        "sql": ("a table of a database", {"url": TEXT, "output_type": TABLE, "table_name": TEXT, "properties": TABLE}, ("table_name",)),
        "stdout": ("the driver's output", {"append_newline": FLAG, "pretty": FLAG}, ()),
    },
    "processor": {
        "arrow_to_json": ("rows to JSON payloads", {"value_field": TEXT, "fields_to_include": LIST}, ()),
        "arrow_to_protobuf": ("rows to Protobuf payloads", {"proto_inputs": LIST, "proto_includes": LIST, "proto": TEXT, "message_type": TEXT, "c": TABLE}, ()),
        "batch": ("batches as they come", {"count": NUMBER, "size": NUMBER, "timeout_ms": NUMBER, "interval": SPAN}, ()),
        "json_to_arrow": ("JSON payloads to columns", {"value_field": TEXT, "fields_to_include": LIST, "schema": TEXT}, ()),
        "protobuf_to_arrow": ("Protobuf payloads to columns", {"proto_inputs": LIST, "proto_includes": LIST, "proto": TEXT, "message_type": TEXT, "value_field": TEXT, "fields_to_include": LIST, "c": TABLE}, ()),
        "python": ("a function of record batches", {"script": TEXT, "module": TEXT, "function": TEXT, "python_path": LIST, "extra_packages": LIST, "schema": TEXT}, ()),
        "sql": ("a SELECT over the batch", {"query": TEXT, "table_name": TEXT, "temporary_list": LIST}, ("query",)),
        "vrl": ("a program for every row", {"statement": TEXT, "timezone": TEXT}, ("statement",)),
    },
    "buffer": {
        "memory": ("rows up to a number or a time", {"capacity": NUMBER, "timeout": SPAN}, ()),
        "session_window": ("rows until none came for a while", {"gap": SPAN, "join": TABLE}, ("gap",)),
        "sliding_window": ("windows of so many rows", {"window_size": NUMBER, "slide_size": NUMBER, "interval": SPAN}, ("window_size", "slide_size")),
        "tumbling_window": ("rows of a length of time", {"interval": SPAN, "join": TABLE}, ("interval",)),
    },
    "codec": {
        "debezium_json": ("change events", {"row": TEXT}, ()),
        "json": ("JSON objects", {"schema": TEXT, "pretty": FLAG}, ()),
        "protobuf": ("Protobuf messages", {"proto_inputs": LIST, "proto_includes": LIST, "proto": TEXT, "message_type": TEXT}, ("message_type",)),
        "schema_registry": ("Protobuf messages with a schema's number", {"url": TEXT, "registry_url": TEXT, "message_type": TEXT, "auth": TABLE, "schemas": TABLE}, ()),
    },
    "temporary": {
        "redis": ("lookups in Redis", {"name": TEXT, "mode": ANY, "redis_type": ANY}, ("name", "mode")),
        "table": ("lookups in a table that the program gives", {"name": TEXT}, ("name",)),
    },
}
#: What any component of a kind may have besides.
COMMON: dict[str, dict[str, dict]] = {"input": {"name": TEXT, "codec": TABLE}, "output": {"codec": TABLE}}
FORMATS = ("yaml", "json", "toml")


def schema_of(kind: str, name: str) -> dict:
    """JSON Schema of one component."""
    try:
        about, keys, needed = COMPONENTS[kind][name]
    except KeyError as e:
        raise ConfigError(f"no {kind} {name!r}") from e
    own = {"type": {"const": name}} | keys | COMMON.get(kind, {})
    return {"type": "object", "description": about, "properties": own, "required": ["type", *needed], "additionalProperties": False}


def schema() -> dict:
    """JSON Schema of a configuration."""

    def one(kind: str) -> dict:
        return {"oneOf": [schema_of(kind, name) for name in sorted(COMPONENTS[kind])]}

    stream = {
        "type": "object", "required": ["input", "output"],
        "properties": {
            "id": {"type": "string", "pattern": "^[A-Za-z0-9_.~-]+$"}, "input": one("input"), "output": one("output"), "error_output": one("output"), "buffer": one("buffer"), "temporary": {"type": "array", "items": one("temporary")},
            "pipeline": {"type": "object", "properties": {"thread_num": NUMBER, "processors": {"type": "array", "items": one("processor")}}},
        },
    }
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["streams"], "properties": {"streams": {"type": "array", "items": stream}, "logging": TABLE, "health_check": TABLE}}


def parse(text: str, kind: str) -> dict:
    """The configuration in a text; what can't be read is an error that says where."""
    try:
        if kind == "yaml":
            import yaml

            got = yaml.safe_load(text)
        elif kind == "json":
            got = json.loads(text)
        elif kind == "toml":
            got = tomllib.loads(text)
        else:
            raise ConfigError(f"unknown configuration format: {kind}")
    except ConfigError:
        raise
    except Exception as e:
        raise ConfigError(f"the configuration isn't {kind}: {e}") from e
    if not isinstance(got, dict):
        raise ConfigError("a configuration is a table of keys")
    return got


def load(path: str) -> dict:
    """A configuration file: YAML, JSON or TOML by its ending."""
    ending = path.rpartition(".")[2]
    return parse(Path(path).read_text(), "yaml" if ending == "yml" else ending)


@dataclass
class Issue:
    path: str
    message: str


def check_component(kind: str, config: object, path: str) -> list[Issue]:
    if not isinstance(config, dict):
        return [Issue(path, f"a {kind} is a table of keys")]
    name = config.get("type", "memory" if kind == "buffer" else None)
    if name not in COMPONENTS[kind]:
        return [Issue(f"{path}.type", f"unknown {kind} {name!r}")]
    keys, needed = schema_of(kind, name)["properties"], COMPONENTS[kind][name][2]
    out = [Issue(f"{path}.{k}", "is needed") for k in needed if config.get(k) is None]
    out += [Issue(f"{path}.{k}", f"{name} has no such key") for k in config if k not in keys and k != "type"]
    kinds = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict}
    for k, v in config.items():
        wanted = keys.get(k, {}).get("type")
        if wanted and v is not None and not isinstance(v, tuple(kinds[x] for x in ([wanted] if isinstance(wanted, str) else wanted))):
            out.append(Issue(f"{path}.{k}", f"must be of type {wanted if isinstance(wanted, str) else ' or '.join(wanted)}"))
    if kind == "input" and name == "multiple_inputs":
        out += [x for k, one in enumerate(config.get("inputs") or []) for x in check_component("input", one, f"{path}.inputs[{k}]")]
    if isinstance(config.get("codec"), dict):
        out += check_component("codec", config["codec"], f"{path}.codec")
    return out


def validate(config: dict, temporaries: dict | None = None) -> list[Issue]:
    """What is wrong with a configuration, without starting anything; an empty list if nothing is. Connectors without a client
    aren't wrong. temporaries: those that the program gives."""
    from rivulet.streaming import runtime

    out: list[Issue] = []
    streams = config.get("streams")
    if not isinstance(streams, list):
        return [Issue("streams", "must be a list")]
    seen: set[str] = set()
    for k, one in enumerate(streams):
        path = f"streams[{k}]"
        if not isinstance(one, dict):
            out.append(Issue(path, "a stream is a table of keys"))
            continue
        found = [Issue(f"{path}.{part}", "is needed") for part in ("input", "output") if part not in one]
        for part, kind in (("input", "input"), ("output", "output"), ("error_output", "output"), ("buffer", "buffer")):
            if part in one:
                found += check_component(kind, one[part], f"{path}.{part}")
        for n, p in enumerate((one.get("pipeline") or {}).get("processors") or []):
            found += check_component("processor", p, f"{path}.pipeline.processors[{n}]")
        name = one.get("id") or f"stream-{k}"
        if name in seen:
            found.append(Issue(f"{path}.id", f"two streams have the id {name!r}"))
        seen.add(name)
        if not found:  # its parts are built, but not run
            try:
                runtime.streams({"streams": [one | {"id": name}]}, temporaries)
            except Unavailable:
                pass
            except (EngineError, KeyError, TypeError, ValueError, OSError) as e:
                found.append(Issue(path, str(e)))
        out += found
    return out


def redact(value: object) -> object:
    """A copy in which the values of secret keys, and passwords in URLs, are asterisks."""
    import re

    if isinstance(value, dict):
        return {k: REDACTED if any(x in str(k).lower() for x in SECRET) and v is not None and not isinstance(v, (dict, list)) else redact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(x) for x in value]
    if isinstance(value, str):
        return re.sub(r"(\w+://[^/@:\s]*:)[^/@\s]+@", rf"\1{REDACTED}@", value)
    return value


@dataclass
class Version:
    id: str
    created_at_ms: int
    format: str
    parent_id: str | None = None


class Versions:
    """Kept configurations, a file each, that are there whole or not at all."""

    def __init__(self, root: str):
        self.root = Path(root)

    def save(self, text: str, kind: str, parent: str | None = None) -> Version:
        """Keep a configuration that can be read."""
        parse(text, kind)
        self.root.mkdir(parents=True, exist_ok=True)
        now = time.time_ns() // 1_000_000
        version = Version(f"{now}-{uuid.uuid4().hex[:8]}", now, kind, parent)
        part = self.root / f".{version.id}.tmp"
        part.write_text(json.dumps({"metadata": asdict(version), "content": text}, indent=2))
        os.replace(part, self.root / f"{version.id}.json")
        return version

    def all(self) -> list[Version]:
        """The latest first."""
        found = [Version(**json.loads(p.read_text())["metadata"]) for p in self.root.glob("*.json")] if self.root.exists() else []
        return sorted(found, key=lambda v: (-v.created_at_ms, v.id))

    def text(self, version: str) -> tuple[str, str]:
        """Text and format of a version."""
        path = self.root / f"{version}.json"
        if "/" in version or not path.exists():
            raise ConfigError(f"no version {version!r}")
        kept = json.loads(path.read_text())
        return kept["content"], kept["metadata"]["format"]

    def rollback(self, version: str) -> Version:
        """The version's configuration as the latest one again."""
        text, kind = self.text(version)
        return self.save(text, kind, version)
