"""Outputs, by type. Each builder takes a configuration and returns a function that writes one batch."""

from __future__ import annotations

import base64
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.codecs.hook import encoder
from rivulet.errors import ConfigError, ProcessError, Unavailable
from rivulet.packaging import ship_package
from rivulet.plans.dialect import expression
from rivulet.schema import VALUE
from rivulet.sources import jdbc

Writer = Callable[[DataFrame], None]
OUTPUTS: dict[str, Callable[[dict], Writer]] = {}


def sink(name: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        OUTPUTS[name] = f
        return f

    return add


def build(config: dict) -> Writer:
    """The output's function of a batch. value_field or body_field: the column that is sent, in place of the payload."""
    if config.get("type") not in OUTPUTS:
        raise ConfigError(f"unknown output {config.get('type')!r}")
    write, own = OUTPUTS[config["type"]](config), config.get("value_field") or config.get("body_field")
    return (lambda df: write(df.withColumn(VALUE, F.col(own).cast("binary")))) if own else write


def dynamic(value: str | dict | None) -> Column | None:
    """A constant or an expression of the row: {"value": text} or {"expr": text}, or plain text."""
    if value is None:
        return None
    if isinstance(value, str):
        return F.lit(value)
    if ("expr" in value) == ("value" in value):
        raise ConfigError("give one of expr and value")
    return F.expr(expression(value["expr"])) if "expr" in value else F.lit(value["value"])


@sink("drop")
def drop(config: dict) -> Writer:
    return lambda df: df.write.format("noop").mode("overwrite").save()


@sink("stdout")
def stdout(config: dict) -> Writer:
    """Prints each payload on the driver, a partition at a time."""
    encode, end = encoder(config.get("codec")), "\n" if config.get("append_newline", True) else ""

    def write(df: DataFrame) -> None:
        for row in encode(df).toLocalIterator():
            print(bytes(row[0]).decode("utf-8", "replace"), end=end)

    return write


@sink("memory")
def memory(config: dict) -> Writer:
    """Adds rows to the list given as `rows` (tests)."""
    return lambda df: config["rows"].extend(df.collect())


@sink("file")
def file(config: dict) -> Writer:
    """Appends files of any format of Spark's to `path`."""
    return lambda df: df.write.mode(config.get("mode", "append")).format(config.get("format", "parquet")).options(**config.get("options", {})).save(config["path"])


#: Column types that the sql output takes.
SQL_TYPES = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType, T.DoubleType, T.FloatType, T.BooleanType)


@sink("sql")
def sql(config: dict) -> Writer:
    """Appends rows to a table by JDBC; columns of other than text, number and boolean type are an error. The address is `url`, or `uri`
    of output_type."""
    url = config.get("url") or (config.get("output_type") or {}).get("uri")
    if not url or not config.get("table_name"):
        raise ConfigError("a sql output needs url and table_name")
    url, who = jdbc.address(url)

    def write(df: DataFrame) -> None:
        if bad := [f.name for f in df.schema.fields if not isinstance(f.dataType, SQL_TYPES)]:
            raise ProcessError(f"unsupported column types: {', '.join(bad)}")
        df.write.jdbc(url, config["table_name"], mode="append", properties={"batchsize": "1000"} | who | config.get("properties", {}))

    return write


def escaped(value: Column, marks: str) -> Column:
    """Backslashes before the marks."""
    return F.regexp_replace(value.cast("string"), f"([{marks}])", r"\\$1")


def line_protocol(df: DataFrame, measurement: str | dict, tags: dict[str, str], fields: dict[str, str], timestamp: str | None = None) -> DataFrame:
    """One payload per row: measurement,tags fields timestamp (ns). A pure column expression.

    tags and fields map a key to a column. Null tags and fields are left out, rows without fields too. Integers end in i,
    texts are quoted. Without a timestamp column the time is now.
    """
    name = dynamic(measurement)
    parts = [F.when(F.col(c).isNotNull(), F.concat(escaped(F.lit(k), r",= \\"), F.lit("="), escaped(F.col(c), r",= \\"))) for k, c in tags.items()]
    values = []
    for k, c in fields.items():
        kind, v = df.schema[c].dataType, F.col(c)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            text = F.concat(v.cast("string"), F.lit("i"))
        elif isinstance(kind, T.StringType):
            text = F.concat(F.lit('"'), escaped(v, r'"\\\\'), F.lit('"'))
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)):
            text = v.cast("string")
        else:
            raise ProcessError(f"field {c} has type {kind.simpleString()}")
        values.append(F.when(v.isNotNull(), F.concat(escaped(F.lit(k), r",= \\"), F.lit("="), text)))
    head = F.concat_ws(",", escaped(name, r", \\"), *parts)
    if timestamp is None:
        nanos = F.unix_micros(F.current_timestamp()) * 1000
    elif isinstance(df.schema[timestamp].dataType, (T.TimestampType, T.TimestampNTZType)):
        nanos = F.unix_micros(F.col(timestamp).cast("timestamp")) * 1000
    else:
        nanos = F.col(timestamp).cast("bigint")
    body = F.concat_ws(",", *values)
    return df.where(F.length(body) > 0).select(F.concat_ws(" ", head, body, nanos.cast("string")).cast("binary").alias(VALUE))


def post(url: str, bodies: Iterable[bytes], method: str, headers: dict[str, str], retries: int, timeout: float) -> None:
    """Send each body, with waits of 100 ms times a power of two between tries."""
    for body in bodies:
        for k in range(retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, data=body, method=method, headers=headers), timeout=timeout) as answer:
                    answer.read()
                break
            except (urllib.error.URLError, TimeoutError) as e:
                if k == retries:
                    raise ProcessError(f"{method} {url}: {e}") from e
                time.sleep(0.1 * 2**k)


def http_headers(config: dict) -> dict[str, str]:
    headers = {"Content-Type": "application/json"} | config.get("headers", {})
    auth = config.get("auth")
    if auth:
        headers["Authorization"] = f"Bearer {auth['token']}" if auth["type"] == "bearer" else "Basic " + base64.b64encode(f"{auth['username']}:{auth['password']}".encode()).decode()
    return headers


@sink("http")
def http(config: dict) -> Writer:
    """One request per payload, from the executors."""
    encode, url, method = encoder(config.get("codec")), config["url"], config.get("method", "POST").upper()
    if method not in ("GET", "POST", "PUT", "DELETE", "PATCH"):
        raise ConfigError(f"unsupported method {method}")
    headers, retries, timeout = http_headers(config), int(config.get("retry_count", 0)), float(config.get("timeout_ms", 5000)) / 1000

    def write(df: DataFrame) -> None:
        ship_package(df.sparkSession)
        encode(df).foreachPartition(lambda rows: post(url, (bytes(r[0]) for r in rows), method, headers, retries, timeout))

    return write


@sink("influxdb")
def influxdb(config: dict) -> Writer:
    """Line protocol in requests of up to `batch_size` lines; what a batch leaves is sent at its end.

    tags and fields: a key's column, or a list of {field: column, tag_name or field_name: key}.
    """
    named = lambda given, key: given if isinstance(given, dict) else {x[key]: x["field"] for x in given or []}
    tags, fields = named(config.get("tags", {}), "tag_name"), named(config["fields"], "field_name")
    url = f"{config['url']}/api/v2/write?org={config['org']}&bucket={config['bucket']}&precision=ns"
    size, headers = int(config.get("batch_size", 1000)), {"Authorization": f"Token {config.get('token', '')}", "Content-Type": "text/plain; charset=utf-8"}
    retries, timeout = int(config.get("retry_count", 3)), float(config.get("timeout_ms", 5000)) / 1000

    def write(df: DataFrame) -> None:
        lines = line_protocol(df, config["measurement"], tags, fields, config.get("timestamp") or config.get("timestamp_field"))

        def send(rows: Iterable) -> None:
            held: list[bytes] = []
            for r in rows:
                held.append(bytes(r[0]))
                if len(held) == size:
                    post(url, [b"\n".join(held)], "POST", headers, retries, timeout)
                    held = []
            if held:
                post(url, [b"\n".join(held)], "POST", headers, retries, timeout)

        ship_package(df.sparkSession)
        lines.foreachPartition(send)

    return write


def routed(df: DataFrame, config: dict) -> DataFrame:
    """Payloads with the columns that brokers take: topic (or channel, subject, key) and key, from constants or expressions."""
    columns = {name: dynamic(config.get(name)) for name in ("topic", "subject", "channel", "key") if config.get(name) is not None}
    keyed = df.withColumns({f"_{k}": v for k, v in columns.items()})
    encode = encoder(config.get("codec"))
    payload = F.col(VALUE) if not config.get("codec") else F.to_json(F.struct(*df.columns)).cast("binary")
    encode(df.limit(0))  # the checks of the codec
    return keyed.select(*[F.col(f"_{k}").alias(k) for k in columns], payload.alias("value"))


@sink("kafka")
def kafka(config: dict) -> Writer:
    """Rows as topic, key and value to Spark's Kafka sink; at least once. A transactional producer isn't what that sink has."""
    if not config.get("brokers") or not config.get("topic"):
        raise ConfigError("a kafka output needs brokers and topic")
    if config.get("exactly_once") or config.get("transactional_id"):
        raise ConfigError("Spark's Kafka sink delivers at least once; it has no transactions")

    def write(df: DataFrame) -> None:
        try:
            routed(df, config).write.format("kafka").option("kafka.bootstrap.servers", ",".join(config["brokers"])).option("kafka.acks", str(config.get("acks", "all"))).save()
        except Exception as e:
            if "kafka" in str(e).lower():
                raise Unavailable("the kafka output needs Spark's kafka package") from e
            raise

    return write


def absent(name: str, needs: str, required: tuple[str, ...]) -> None:
    def make(config: dict) -> Writer:
        if missing := [k for k in required if not config.get(k)]:
            raise ConfigError(f"{name} needs {', '.join(missing)}")
        raise Unavailable(f"the {name} output needs {needs}, which isn't installed")

    OUTPUTS[name] = make


absent("mongodb", "a MongoDB client", ("uri", "database", "collection"))
absent("mqtt", "an MQTT client", ("host", "port", "topic"))
absent("nats", "a NATS client", ("url",))
absent("pulsar", "a Pulsar client", ("service_url", "topic"))
absent("redis", "a Redis client", ("mode",))
