"""Bounded and streaming inputs, by type.

Each builder takes (spark, config) and returns a DataFrame; `streaming=True` asks for an unbounded one where Spark has it.
Connectors whose client or Spark package isn't installed raise Unavailable, with their column contract kept here.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rivulet.codecs.hook import decoder
from rivulet.errors import ConfigError, ReadError, Unavailable
from rivulet.operators.windows import seconds
from rivulet.packaging import ship_package
from rivulet.plans.dialect import query
from rivulet.schema import META, RAW, VALUE, with_meta
from rivulet.session import shared_folder
from rivulet.sources import jdbc, stores
from rivulet.sources.receiver import Receiver

INPUTS: dict[str, Callable[..., DataFrame]] = {}


def source(name: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        INPUTS[name] = f
        return f

    return add


def build(spark: SparkSession, config: dict, streaming: bool = False) -> DataFrame:
    """The input's DataFrame, decoded by its codec, with __meta_source if it is named."""
    kind = config.get("type")
    if kind not in INPUTS:
        raise ConfigError(f"unknown input {kind!r}")
    df = decoder(config.get("codec"))(INPUTS[kind](spark, config, streaming))
    return with_meta(df, source=config["name"], ingest=False) if config.get("name") and "__meta_source" not in df.columns else df


class ArrowSource(DataSource):
    """Arrow IPC files, stream or file format, one task a file."""

    @classmethod
    def name(cls) -> str:
        return "rivulet_arrow"

    def files(self) -> list[str]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.options["path"])
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [self.options["path"]]
        prefix = self.options["path"].removesuffix(path)
        return sorted(prefix + f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File)

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        with arrow_reader(self.files()[0]) as r:
            return from_arrow_schema(r.schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowReader(self.files())


def arrow_reader(uri: str):
    import pyarrow as pa
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    f = store.open_input_file(path)
    try:
        return pa.ipc.open_file(f)
    except pa.ArrowInvalid:
        f.seek(0)
        return pa.ipc.open_stream(f)


class ArrowReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.paths = files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator:
        with arrow_reader(partition.value) as r:
            if hasattr(r, "num_record_batches"):
                for k in range(r.num_record_batches):
                    yield r.get_batch(k)
            else:
                yield from r


FORMATS = ("json", "csv", "parquet", "arrow", "avro", "orc", "text")


@source("file")
def file(spark: SparkSession, config: dict, streaming: bool = False) -> DataFrame:
    """Files of one format, once; an optional query runs over them as a table (by default `flow`).

    Paths may be in any store that Spark's Hadoop settings reach; `store` gives those of one (sources.stores). Filters and columns of the query reach the scan.
    """
    kind = config.get("input_type", config.get("format", "parquet"))
    kind = kind.get("type") if isinstance(kind, dict) else kind
    path = config.get("path")
    if kind not in FORMATS:
        raise ConfigError(f"unknown file format {kind!r}")
    if not path:
        raise ConfigError("a file input needs a path")
    path = stores.use(spark, config.get("store"), path)
    if kind == "arrow":
        ship_package(spark)
        spark.dataSource.register(ArrowSource)
        df = spark.read.format("rivulet_arrow").option("path", path).load()
    else:
        options = {"header": "true", "inferSchema": "true"} if kind == "csv" else {}
        reader = spark.readStream if streaming else spark.read
        if streaming and config.get("max_files_per_batch"):
            options["maxFilesPerTrigger"] = str(config["max_files_per_batch"])
        schema = config.get("schema")
        if schema:
            reader, options = reader.schema(schema), {k: v for k, v in options.items() if k != "inferSchema"}
        elif streaming:
            reader = reader.schema(spark.read.format(kind).options(**options).load(path).schema)
        try:
            df = reader.format(kind).options(**options | config.get("options", {})).load(path)
        except Exception as e:
            if kind == "avro":
                raise Unavailable("avro files need Spark's avro package") from e
            raise
    wanted = config.get("query")
    if not wanted:
        return df
    text, table = (wanted, "flow") if isinstance(wanted, str) else (wanted["query"], wanted.get("table", "flow"))
    return query(spark, text, **{table: df})


@source("sql")
def sql(spark: SparkSession, config: dict, streaming: bool = False) -> DataFrame:
    """A SELECT that a database runs, read by JDBC; partition_column with bounds and num_partitions reads it in parallel.

    input_type: a database's address (`uri`), or files (`type` is a format, `path`, `object_store`), over which the SELECT runs as
    over `flow`. tables: several of them by name, see joined_tables.
    """
    kind = config.get("input_type", {})
    if config.get("tables"):
        return joined_tables(spark, config)
    if kind.get("type") in FORMATS and kind.get("path") and config.get("select_sql"):
        return file(spark, {"format": kind["type"], "path": kind["path"], "store": kind.get("object_store"), "query": {"query": config["select_sql"], "table": kind.get("table_name", "flow")}}, streaming)
    url = config.get("url") or kind.get("uri")
    if not url or not config.get("select_sql"):
        raise ConfigError("a sql input needs url and select_sql")
    url, who = jdbc.address(url)
    options = {"url": url, "query": config["select_sql"], "fetchsize": str(config.get("fetchsize", 10_000))} | who | config.get("options", {})
    if "partition_column" in config:
        options.pop("query")
        options |= {"dbtable": f"({config['select_sql']}) flow", "partitionColumn": config["partition_column"], "lowerBound": str(config["lower_bound"]), "upperBound": str(config["upper_bound"]), "numPartitions": str(config["num_partitions"])}
    return spark.read.format("jdbc").options(**options).load()


def joined_tables(spark: SparkSession, config: dict) -> DataFrame:
    """select_sql over `tables`, of several databases: a name each, with `url` and `table` (or `select_sql`) as a sql input has them, or
    any other input. Filters and columns reach the databases; the joins are Spark's."""
    if not config.get("select_sql"):
        raise ConfigError("a sql input needs select_sql")
    named = {}
    for name, own in config["tables"].items():
        if "type" in own:
            named[name] = build(spark, own)
        elif not own.get("url") or not (own.get("table") or own.get("select_sql")):
            raise ConfigError(f"table {name} needs url, and table or select_sql")
        elif own.get("table"):
            url, who = jdbc.address(own["url"])
            named[name] = spark.read.format("jdbc").options(**{"url": url, "dbtable": own["table"]} | who | own.get("options", {})).load()
        else:
            named[name] = sql(spark, own)
    return query(spark, config["select_sql"], **named)


@source("generate")
def generate(spark: SparkSession, config: dict, streaming: bool = False) -> DataFrame:
    """`context` as a payload: batch_size rows every interval, count rows at most. A batch that would pass count isn't sent."""
    size, count = int(config.get("batch_size", 1)), config.get("count")
    text = F.lit(config["context"]).cast("binary").alias(VALUE)
    if streaming:
        interval = seconds(config.get("interval", "1s"))  # also the stream's trigger (streaming.runtime)
        df = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", size).option("advanceMillisPerBatch", int(interval * 1000)).load()
        if count is not None:
            df = df.where(F.col("value") < count // size * size)
        return df.select(text)
    if count is None:
        raise ConfigError("a bounded generate input needs count")
    return spark.range(int(count) // size * size).select(text)


@source("memory")
def memory(spark: SparkSession, config: dict, streaming: bool = False) -> DataFrame:
    """A fixed list of messages."""
    rows = [(m.encode() if isinstance(m, str) else bytes(m),) for m in config.get("messages", [])]
    return spark.createDataFrame(rows, RAW)


def named_inputs(spark: SparkSession, config: dict, streaming: bool = False) -> dict[str, DataFrame]:
    """Inputs of a multiple_inputs configuration by name; names must be there and differ."""
    inputs = config.get("inputs", [])
    names = [i.get("name") for i in inputs]
    if not inputs or any(not n for n in names) or len(set(names)) != len(names):
        raise ConfigError("multiple_inputs needs inputs with names that differ")
    return {i["name"]: build(spark, i, streaming) for i in inputs}


@source("multiple_inputs")
def multiple_inputs(spark: SparkSession, config: dict, streaming: bool = False) -> DataFrame:
    """All inputs' rows, columns by name, with __meta_source telling which one they come from."""
    out = None
    for df in named_inputs(spark, config, streaming).values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def kafka_columns(df: DataFrame) -> DataFrame:
    """Kafka's columns as payload and metadata; the topic is in __meta_ext. Only producers' timestamps (type 0) are taken."""
    return df.select(
        F.col("value").alias(VALUE),
        F.concat(F.lit("kafka://"), "topic").alias("__meta_source"),
        F.col("partition").cast("bigint").alias("__meta_partition"),
        F.col("offset").alias("__meta_offset"),
        F.col("key").alias("__meta_key"),
        F.when(F.col("timestampType") == 0, F.col("timestamp")).alias("__meta_timestamp"),
        F.current_timestamp().alias("__meta_ingest_time"),
        F.create_map(F.lit("topic"), F.col("topic")).alias("__meta_ext"),
    ).select(VALUE, *META)


@source("kafka")
def kafka(spark: SparkSession, config: dict, streaming: bool = True) -> DataFrame:
    options = {
        "kafka.bootstrap.servers": ",".join(config["brokers"]), "subscribe": ",".join(config["topics"]), "kafka.group.id": config.get("consumer_group", ""), "startingOffsets": "latest" if config.get("start_from_latest") else "earliest",
        "maxOffsetsPerTrigger": str(config.get("max_rows_per_batch", "")),
    }
    try:
        reader = spark.readStream if streaming else spark.read
        return kafka_columns(reader.format("kafka").options(**{k: v for k, v in options.items() if v}).load())
    except Exception as e:
        if "kafka" in str(e).lower():
            raise Unavailable("the kafka input needs Spark's kafka package") from e
        raise


def modbus_schema(points: list[dict]) -> T.StructType:
    """One array column per point: booleans for coils and discrete inputs, integers for registers."""
    kinds = {"coils": "array<boolean>", "discrete_inputs": "array<boolean>", "holding_registers": "array<int>", "input_registers": "array<int>"}
    try:
        return T.StructType([T.StructField(p["name"], T._parse_datatype_string(kinds[p["type"]])) for p in points])
    except KeyError as e:
        raise ConfigError(f"unknown point type {e}") from e


def absent(name: str, needs: str, required: tuple[str, ...]) -> None:
    """An input that is checked here but can't run without its client."""

    def make(spark: SparkSession, config: dict, streaming: bool = True) -> DataFrame:
        if missing := [k for k in required if not config.get(k)]:
            raise ConfigError(f"{name} needs {', '.join(missing)}")
        raise Unavailable(f"the {name} input needs {needs}, which isn't installed")

    INPUTS[name] = make


absent("mqtt", "an MQTT client", ("host", "port", "topics"))
absent("nats", "a NATS client", ("url",))
absent("pulsar", "a Pulsar client", ("service_url", "topic"))
absent("redis", "a Redis client", ("mode",))
absent("websocket", "a WebSocket client", ("url",))
absent("modbus", "a Modbus client", ("addr", "points"))


#: Receivers that run beside this driver, by address and path.
RECEIVERS: dict[tuple[str, str], tuple[Receiver, str]] = {}


def received(spark: SparkSession, config: dict) -> str:
    """The landing folder of the receiver of an address, which is started if it doesn't run."""
    key = config["address"], config.get("path", "/")
    if key not in RECEIVERS:
        host, _, port = config["address"].rpartition(":")
        if not host or not port.isdigit():
            raise ConfigError(f"no address of host and port: {config['address']!r}")
        folder = config.get("landing") or f"{shared_folder(spark)}/rivulet/landing-{uuid.uuid4().hex}"
        RECEIVERS[key] = Receiver(folder, key[1], host, int(port), config.get("auth"), bool(config.get("cors_enabled"))).start(), folder
    return RECEIVERS[key][1]


@source("http")
def http(spark: SparkSession, config: dict, streaming: bool = True) -> DataFrame:
    """Payloads that a receiver (sources.receiver) lands as files in `landing`. With `address` (host:port) one runs beside the driver,
    which takes POSTs to `path`; without landing it has a folder in the one that the cluster shares."""
    folder = config.get("landing")
    if not folder and not config.get("address"):
        raise ConfigError("an http input needs address, or landing: the folder that its receiver writes to")
    if config.get("address"):
        folder = received(spark, config)
    kind = T.StructType([T.StructField("value", T.StringType())])
    reader = (spark.readStream if streaming else spark.read).schema(kind)
    try:
        return reader.text(folder).select(F.col("value").cast("binary").alias(VALUE))
    except Exception as e:
        raise ReadError(str(e)) from e
