"""Streams from configuration: inputs, buffer, processors, output and error output, as one Spark query each."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulet.codecs.hook import decoder
from rivulet.errors import ConfigError
from rivulet.operators import processors
from rivulet.operators.lookup import Provider, RedisProvider
from rivulet.operators.vrl import vrl
from rivulet.operators.windows import seconds
from rivulet.operators.windows import sliding_count as windows_of_rows
from rivulet.schema import VALUE
from rivulet.sinks import outputs
from rivulet.sources import inputs
from rivulet.streaming import buffers
from rivulet.streaming.config import COMPONENTS, load  # noqa: F401  load is part of this module

log = logging.getLogger(__name__)


@dataclass
class Metrics:
    batches_in: int = 0
    rows_in: int = 0
    rows_out: int = 0
    errors: int = 0


@dataclass
class Stream:
    """One input-to-output flow. run() takes bounded inputs; start() runs it on streams with a checkpoint."""

    id: str
    config: dict
    temporaries: dict[str, Provider] = field(default_factory=dict)
    metrics: Metrics = field(default_factory=Metrics)
    query: StreamingQuery | buffers.BufferedQuery | None = None

    def __post_init__(self) -> None:
        for key in ("input", "output"):
            if key not in self.config:
                raise ConfigError(f"stream {self.id} has no {key}")
        buffers.check(self.buffer())
        self.process = processors.chain(*[processor(p, self.temporaries) for p in self.steps()])
        self.write = outputs.build(self.config["output"])
        error = self.config.get("error_output")
        self.write_error = outputs.build(error) if error else None

    def steps(self) -> list[dict]:
        """The processors' configurations."""
        return (self.config.get("pipeline") or {}).get("processors") or []

    def buffer(self) -> dict:
        """The stream's buffer; a batch processor is one too, where there is no other."""
        if self.config.get("buffer"):
            return self.config["buffer"]
        for p in self.steps():
            if p.get("type") == "batch":
                count, wait = p.get("count") or p.get("size"), f"{p['timeout_ms']}ms" if p.get("timeout_ms") else p.get("interval")
                return {"type": "memory", "capacity": count, "timeout": wait} if count or wait else {}
        return {}

    def progress(self) -> dict:
        """What Spark says of the last micro-batch: its number, rows, rates and times."""
        last = self.query.lastProgress if self.query is not None else None
        return {} if last is None else {"batch": last.batchId, "rows": last.numInputRows, "rows_per_second": last.processedRowsPerSecond, "milliseconds": dict(last.durationMs)}

    def batch(self, df: DataFrame) -> None:
        """Process and write one batch. A failure sends the input batch to the error output; without one it is logged."""
        self.metrics.batches_in += 1
        df = df.persist()
        try:
            n = df.count()
            self.metrics.rows_in += n
            if not n:
                return
            try:
                out = self.process(df).persist()
                try:
                    self.write(out)
                    self.metrics.rows_out += out.count()
                finally:
                    out.unpersist()
            except Exception as e:
                self.metrics.errors += 1
                log.warning("stream %s: %s", self.id, e)
                if self.write_error:
                    self.write_error(df)
        finally:
            df.unpersist()

    def run(self, spark: SparkSession) -> Metrics:
        """Read the whole input once, as one window; a join buffer joins the inputs in it. With a sliding_window the rows come once
        for each full window that they lie in, with its number in window_no, by which the processors' SQL groups."""
        join = self.buffer().get("join")
        if join:
            named = inputs.named_inputs(spark, self.config["input"])
            self.batch(bounded_join(spark, named, self.buffer()))
        elif self.buffer().get("type") == "sliding_window":
            rows = inputs.build(spark, self.config["input"]).withColumn("_arrival", F.monotonically_increasing_id())
            self.batch(windows_of_rows(rows, ["_arrival"], int(self.buffer()["window_size"]), int(self.buffer()["slide_size"])).drop("_arrival"))
        else:
            self.batch(inputs.build(spark, self.config["input"]))
        return self.metrics

    def start(self, spark: SparkSession, checkpoint: str, once: bool = False) -> StreamingQuery | buffers.BufferedQuery:
        """Run on streams; a micro-batch, or with a buffer a window of them, is a batch. After a restart from the checkpoint no input is
        lost. once: what is there is read, and the last window closed when its query has been waited for."""
        if self.state() == "running":
            raise ConfigError(f"stream {self.id} is running")
        source, buffer = self.config["input"], None
        if self.buffer().get("join"):
            named = inputs.named_inputs(spark, source, streaming=True)
            df = None
            for name, rows in named.items():
                own = rows.select(F.lit(name).alias("__meta_source"), VALUE)
                df = own if df is None else df.union(own)
            work = lambda window: self.batch(bounded_join(spark, {n: window.where(F.col("__meta_source") == n).select(VALUE) for n in named}, self.buffer()))
        else:
            df, work = inputs.build(spark, source, streaming=True), self.batch
        if self.buffer():
            buffer = buffers.Buffer(spark, f"{checkpoint}/buffer", self.buffer(), work)
        writer = df.writeStream.queryName(self.id).option("checkpointLocation", checkpoint).foreachBatch(buffer.add if buffer else lambda batch, _: self.batch(batch))
        if once:
            writer = writer.trigger(availableNow=True)
        elif source.get("type") == "generate":
            writer = writer.trigger(processingTime=f"{seconds(source.get('interval', '1s'))} seconds")
        query = writer.start()
        self.query = buffers.BufferedQuery(query, buffer, once) if buffer else query
        return self.query

    def stop(self) -> None:
        """Stop the running query; the checkpoint keeps its place."""
        if self.query is not None:
            self.query.stop()

    def restart(self, spark: SparkSession, checkpoint: str) -> StreamingQuery | buffers.BufferedQuery:
        self.stop()
        return self.start(spark, checkpoint)

    def state(self) -> str:
        """created, running, failed or stopped."""
        if self.query is None:
            return "created"
        if self.query.isActive:
            return "running"
        return "failed" if self.query.exception() is not None or getattr(self.query, "error", None) else "stopped"


def bounded_join(spark: SparkSession, named: dict[str, DataFrame], buffer: dict) -> DataFrame:
    """A join buffer over bounded inputs: all their rows are one window, which needs rows of every input."""
    from rivulet.plans.dialect import query

    decode = decoder(buffer["join"].get("codec"))
    tables = {k: decode(df) for k, df in named.items()}
    out = query(spark, buffer["join"]["query"], **tables)
    if any(df.isEmpty() for df in tables.values()):
        return out.limit(0)
    return out


def processor(config: dict, temporaries: dict[str, Provider]) -> Callable[[DataFrame], DataFrame]:
    kind = config.get("type")
    if kind == "sql":
        own = {t["table_name"]: (temporaries[t["name"]], t.get("key")) for t in config.get("temporary_list", [])}
        return processors.sql(config["query"], config.get("table_name", "flow"), own)
    if kind == "json_to_arrow":
        return processors.json_to_arrow(config.get("value_field", "__value__"), config.get("fields_to_include"), config.get("schema"))
    if kind == "arrow_to_json":
        return processors.arrow_to_json(config.get("value_field", "__value__"), config.get("fields_to_include"))
    if kind in ("protobuf_to_arrow", "arrow_to_protobuf"):
        from rivulet.codecs import protobuf

        own = config | config.get("c", {})
        proto = protobuf.load(own["proto_inputs"]) if "proto_inputs" in own else own["proto"]
        if kind == "protobuf_to_arrow":
            return lambda df: protobuf.decode(df, proto, own["message_type"], own.get("value_field", "__value__"), own.get("fields_to_include"))
        return lambda df: protobuf.encode(df, proto, own["message_type"])
    if kind == "batch":
        return processors.batch(config.get("count"), config.get("timeout_ms"))
    if kind == "python":
        return processors.python(schema=config.get("schema"), script=config.get("script"), module=config.get("module"), name=config.get("function", "process"), python_path=config.get("python_path"))
    if kind == "vrl":
        return vrl(config["statement"], config.get("timezone"))
    raise ConfigError(f"unknown processor {kind!r}")


def streams(config: dict, temporaries: dict[str, Provider] | None = None) -> list[Stream]:
    """All streams of a configuration. Ids differ and fit into URLs; without one a stream is stream-<i>."""
    out, ids = [], set()
    for k, s in enumerate(config.get("streams", [])):
        name = s.get("id") or f"stream-{k}"
        if not re.fullmatch(r"[A-Za-z0-9_.~-]+", name):
            raise ConfigError(f"stream id {name!r} doesn't fit into a URL")
        if name in ids:
            raise ConfigError(f"two streams have the id {name!r}")
        ids.add(name)
        own = dict(temporaries or {})
        for t in s.get("temporary", []):
            if t["name"] not in own and t.get("type") == "redis":
                RedisProvider(**t)
        out.append(Stream(name, s, own))
    return out


def components() -> dict[str, list[str]]:
    """Names of all components by kind."""
    return {kind: sorted(named) for kind, named in COMPONENTS.items()}
