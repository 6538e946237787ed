"""Queries for windows, codecs, metadata, sinks' columns and users' functions, on bounded data."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from rivulet.codecs import debezium, protobuf, registry
from rivulet.codecs import json as json_codec
from rivulet.operators import processors, windows
from rivulet.operators.lookup import TableProvider
from rivulet.operators.vrl import vrl
from rivulet.plans.tables import frame, load
from rivulet.schema import VALUE, with_meta
from rivulet.session import shared_folder
from rivulet.sinks.outputs import line_protocol, routed
from rivulet.sources import inputs
from rivulet.streaming import windows as stream_windows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


@frame("win_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def win_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(events(spark, sf_dir), "ts", "1 hour").groupBy("window_start").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@frame(
    "win_sliding_time",
    """SELECT window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS window_start FROM events) GROUP BY 1""",
)
def win_sliding_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(events(spark, sf_dir), "ts", "2 hours", "1 hour").groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))


SESSIONS = """WITH e AS (SELECT {k} ts, lag(ts) OVER ({p} ORDER BY ts) AS before FROM events), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL {g} THEN 1 ELSE 0 END) OVER ({p} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT {k} min(ts) AS session_start, max(ts) + INTERVAL {g} AS session_end, count(*) AS rows FROM s GROUP BY {k} no"""


@frame("win_session", SESSIONS.format(k="", p="", g="10 MINUTE").replace("SELECT  min", "SELECT min"))
def win_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.session_bounds(events(spark, sf_dir), "ts", "10 minutes")


@frame("win_session_keyed", SESSIONS.format(k="user_id,", p="PARTITION BY user_id", g="12 HOUR"))
def win_session_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.session_bounds(events(spark, sf_dir), "ts", "12 hours", "user_id")


@frame(
    "win_sliding_count",
    """WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM events), w AS (SELECT *, unnest(range(greatest((rn - 30) // 10, 0), rn // 10 + 1)) AS window_no FROM r)
    SELECT window_no, count(*) AS rows, round(sum(value), 4) AS total FROM w WHERE window_no * 10 <= rn AND rn < window_no * 10 + 30 AND window_no * 10 + 30 <= n GROUP BY window_no""",
)
def win_sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_count(events(spark, sf_dir).select("event_id", "ts", "value"), ["ts", "event_id"], 30, 10).groupBy("window_no").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@frame(
    "window_join",
    """SELECT time_bucket(INTERVAL '1 day', a.ts, TIMESTAMP '1970-01-01') AS window_start, a.user_id, a.event_id AS clicks_event_id, b.event_id AS views_event_id
    FROM events a JOIN events b ON a.user_id = b.user_id AND time_bucket(INTERVAL '1 day', a.ts, TIMESTAMP '1970-01-01') = time_bucket(INTERVAL '1 day', b.ts, TIMESTAMP '1970-01-01')
    WHERE a.event_type = 'click' AND b.event_type = 'view' AND a.value > b.value""",
)
def window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id", "value", "event_type")
    sides = {"clicks": rows.where("event_type = 'click'").drop("event_type"), "views": rows.where("event_type = 'view'").drop("event_type")}
    joined = windows.window_join(sides, "ts", "1 day", ["user_id"])
    return joined.where("clicks_value > views_value").select("window_start", "user_id", "clicks_event_id", "views_event_id")


@frame("json_roundtrip", "SELECT event_id, event_type, user_id FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "event_type", "user_id")
    return json_codec.decode(json_codec.encode(rows), "event_id bigint, event_type string, user_id bigint")


@frame("json_to_arrow_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_to_arrow_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    one = processors.chain(processors.arrow_to_json(fields=["event_id", "props"]), processors.json_to_arrow(fields=["event_id", "props"], schema="event_id bigint, props string"))
    return rows.transform(one).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@frame("debezium_flatten", "SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'c' ELSE 'u' END AS op, c_custkey * 1000 AS ts_ms, 'shop' AS source_db, 'customer' AS source_table FROM customer")
def debezium_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    op = F.when(F.col("c_custkey") % 3 == 0, "d").when(F.col("c_custkey") % 3 == 1, "c").otherwise("u")
    envelope = F.struct(
        F.when(op == "d", row).alias("before"), F.when(op != "d", row).alias("after"), op.alias("op"), (F.col("c_custkey") * 1000).alias("ts_ms"), F.struct(F.lit("shop").alias("db"), F.lit("customer").alias("table")).alias("source")
    )
    raw = load(spark, sf_dir, "customer").select(F.to_json(envelope).cast("binary").alias(VALUE))
    return debezium.decode(raw, "id bigint, name string").select("id", "name", "op", "ts_ms", "source_db", "source_table")


@frame("metadata_columns", "SELECT o_orderkey, 'kafka://orders' AS source, CAST(3 AS BIGINT) AS part, 'eu' AS region FROM orders WHERE o_totalprice > 100000")
def metadata_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_meta(load(spark, sf_dir, "orders"), source="kafka://orders", partition=3, ext={"region": "eu"}, ingest=False)
    return processors.sql("SELECT o_orderkey, __meta_source AS source, __meta_partition AS part, __meta_ext['region'] AS region FROM flow WHERE o_totalprice > 100000 AND __meta_partition = 3")(rows)


@frame("line_protocol", "SELECT 'orders,status=' || o_orderstatus || ' key=' || o_orderkey || 'i,priority=\"' || o_orderpriority || '\" ' || CAST(epoch_us(o_orderdate) * 1000 AS VARCHAR) AS line FROM orders")
def line_protocol_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_protocol(load(spark, sf_dir, "orders"), "orders", {"status": "o_orderstatus"}, {"key": "o_orderkey", "priority": "o_orderpriority"}, "o_orderdate")
    return lines.select(F.col(VALUE).cast("string").alias("line"))


@frame("generate_source", "SELECT '{\"v\": 1}' AS payload, 20 AS n")
def generate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.build(spark, {"type": "generate", "context": '{"v": 1}', "batch_size": 10, "count": 25})
    return rows.groupBy(F.col(VALUE).cast("string").alias("payload")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@frame("multiple_inputs", "SELECT n_name AS name, 'nations' AS source FROM nation UNION ALL SELECT r_name, 'regions' FROM region")
def multiple_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, table, column: {"name": name, "type": "file", "format": "parquet", "path": f"{sf_dir}/{table}.parquet", "query": f"SELECT {column} AS name FROM flow"}
    rows = inputs.build(spark, {"type": "multiple_inputs", "inputs": [part("nations", "nation", "n_name"), part("regions", "region", "r_name")]})
    return rows.select("name", F.col("__meta_source").alias("source"))


@frame("vrl_program", "SELECT p_partkey, upper(p_brand) AS brand, p_size * 2 AS double_size, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS class FROM part")
def vrl_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = """
    .brand = upcase(.p_brand)
    .double_size, err = .p_size * 2
    if .p_size > 25 { .class = "big" } else { .class = "small" }
    del(.p_brand)
    del(.p_size)
    .
    """
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").transform(vrl(program))


@frame("python_batch", "SELECT event_id, value, value * 2 AS value_doubled FROM events")
def python_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    def doubled(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        import pyarrow.compute as pc

        return [pa.RecordBatch.from_arrays([*batch.columns, pc.multiply(batch.column(1), 2.0)], names=["event_id", "value", "value_doubled"])]

    return processors.python(doubled, "event_id bigint, value double, value_doubled double")(events(spark, sf_dir).select("event_id", "value"))


@frame("udf_scalar", "SELECT p_partkey, p_retailprice * 1.1 AS taxed FROM part")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxed = F.pandas_udf(lambda s: s * 1.1, "double")
    spark.udf.register("taxed", taxed)
    return processors.sql("SELECT p_partkey, taxed(p_retailprice) AS taxed FROM flow")(load(spark, sf_dir, "part"))


@frame("udf_aggregate", "SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY p_brand")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    spark.udf.register("spread", F.pandas_udf(spread, "double", PandasUDFType.GROUPED_AGG))
    return processors.sql("SELECT p_brand, round(spread(p_retailprice), 4) AS spread FROM flow GROUP BY p_brand")(load(spark, sf_dir, "part"))


@frame("udf_window", "SELECT p_partkey, round(max(p_retailprice) OVER (PARTITION BY p_brand) - min(p_retailprice) OVER (PARTITION BY p_brand), 4) AS spread FROM part")
def udf_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    def width(s: pd.Series) -> float:
        return float(s.max() - s.min())

    spark.udf.register("width", F.pandas_udf(width, "double", PandasUDFType.GROUPED_AGG))
    return processors.sql("SELECT p_partkey, round(width(p_retailprice) OVER (PARTITION BY p_brand), 4) AS spread FROM flow")(load(spark, sf_dir, "part"))


@frame("udf_window_rows", "SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS most FROM events")
def udf_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function of all rows of a partition."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "value")
    return windows.over_partitions(rows, lambda v: v.cummax(), "most", "double", ["value"], ["user_id"], ["event_id"]).select("event_id", F.round("most", 6).alias("most"))


PROTO = 'syntax = "proto3"; package demo; message Event { int64 event_id = 1; double value = 2; string event_type = 3; }'


@frame("protobuf_roundtrip", "SELECT event_id, value, event_type FROM events")
def protobuf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = protobuf.encode(events(spark, sf_dir).select("event_id", "value", "event_type"), PROTO, "demo.Event")
    return protobuf.decode(sent.select(VALUE), PROTO, "demo.Event")


@frame("schema_registry_decode", "SELECT event_id, event_type FROM events")
def schema_registry_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = protobuf.encode(events(spark, sf_dir).select("event_id", "value", "event_type"), PROTO, "demo.Event").select(VALUE)
    framed = registry.frame(sent, 7)
    return registry.decode(framed, {7: lambda df: protobuf.decode(df, PROTO, "demo.Event")}).select("event_id", "event_type")


@frame("kafka_metadata", "SELECT o_orderkey AS id, 'kafka://orders' AS source, CAST(o_orderkey % 4 AS BIGINT) AS part, 'orders' AS topic FROM orders")
def kafka_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of Spark's Kafka source as payload and metadata, then SQL over them."""
    rows = load(spark, sf_dir, "orders").select(
        F.lit(None).cast("binary").alias("key"), F.col("o_orderkey").cast("string").cast("binary").alias("value"), F.lit("orders").alias("topic"), (F.col("o_orderkey") % 4).cast("int").alias("partition"), F.col("o_orderkey").alias("offset"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"),
    )
    return processors.sql("SELECT CAST(CAST(__value__ AS STRING) AS BIGINT) AS id, __meta_source AS source, __meta_partition AS part, __meta_ext['topic'] AS topic FROM flow")(inputs.kafka_columns(rows))


@frame("dynamic_routing", "SELECT 'orders-' || lower(o_orderstatus) AS topic, CAST(o_custkey AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def dynamic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").withColumn(VALUE, F.col("o_orderkey").cast("string").cast("binary"))
    sent = routed(rows, {"topic": {"expr": "'orders-' || lower(o_orderstatus)"}, "key": {"expr": "o_custkey::STRING"}})
    return sent.select("topic", "key", F.col("value").cast("string").alias("value"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_folder(spark)}/rivulet/{name}-{uuid.uuid4().hex}"


@frame("vrl_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || '!' AS label, 'seen' AS state FROM events")
def vrl_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = """
    data = parse_json!(.props)
    .k = to_int!(data.k)
    parts = split(.event_type, ",")
    .label = join([parts[0], "!"])
    if .k < 0 { abort }
    . = merge(., {"state": "seen"})
    del(.props)
    del(.event_type)
    .
    """
    rows = events(spark, sf_dir).select("event_id", F.concat("event_type", F.lit(",x")).alias("event_type"), "props")
    return rows.transform(vrl(program))


@frame("vrl_rows", "SELECT n_nationkey AS id, 'name' AS what, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation")
def vrl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = '[{"id": .n_nationkey, "what": "name", "value": .n_name}, {"id": .n_nationkey, "what": "region", "value": to_string(.n_regionkey)}]'
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").transform(vrl(program))


@frame("lookup_in_sql", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def lookup_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL processor with a lookup table that has the rows of the batch's keys."""
    from rivulet.streaming import runtime

    config = {
        "type": "sql", "query": "SELECT f.o_orderkey, c.c_name FROM flow f JOIN customers c ON c.c_custkey = f.o_custkey",
        "temporary_list": [{"name": "by_key", "table_name": "customers", "key": {"expr": "o_custkey"}}],
    }
    own = TableProvider(lambda s: load(s, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return runtime.processor(config, {"by_key": own})(load(spark, sf_dir, "orders").where("o_totalprice > 300000"))


@frame("stream_from_config", "SELECT event_type, count(*) AS cnt FROM events WHERE value >= 10 GROUP BY event_type")
def stream_from_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured stream, from a file input through SQL and JSON to a file output, run over its whole input."""
    from rivulet.streaming import runtime

    out = scratch(spark, "stream")
    one = {
        "id": "counts", "input": {"type": "file", "format": "parquet", "path": f"{sf_dir}/events.parquet"}, "output": {"type": "file", "path": out},
        "pipeline": {"processors": [{"type": "sql", "query": "SELECT event_type, count(*) AS cnt FROM flow WHERE value >= 10 GROUP BY event_type"}, {"type": "arrow_to_json"}, {"type": "json_to_arrow", "schema": "event_type string, cnt bigint"}]},
    }
    runtime.streams({"streams": [one]})[0].run(spark)
    return spark.read.parquet(out)


@frame("stream_error_output", "SELECT event_id, event_type FROM events")
def stream_error_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose SQL fails goes to the error output as it came in."""
    from rivulet.streaming import runtime

    out, failed = scratch(spark, "out"), scratch(spark, "failed")
    one = {
        "input": {"type": "file", "format": "parquet", "path": f"{sf_dir}/events.parquet", "query": "SELECT event_id, event_type FROM flow"}, "output": {"type": "file", "path": out}, "error_output": {"type": "file", "path": failed},
        "pipeline": {"processors": [{"type": "sql", "query": "SELECT event_id / 0 AS x FROM flow"}]},
    }
    runtime.streams({"streams": [one]})[0].run(spark)
    return spark.read.parquet(failed)


def stream_of(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    kind = load(spark, sf_dir, table).schema
    rows = spark.readStream.schema(kind).parquet(f"{sf_dir}/{table}.parque[t]")  # a pattern: file streams take no single file
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def replayed(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its input ends, as files. mode complete: the windows that are still open too."""
    spark, out = df.sparkSession, scratch(df.sparkSession, name)
    own = "overwrite" if mode == "complete" else "append"
    df.writeStream.foreachBatch(lambda batch, _: batch.write.mode(own).parquet(out)).outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@frame("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded windows again, by Structured Streaming: all windows, the open ones too, as the input ends."""
    return replayed(stream_windows.tumbling(stream_of(spark, sf_dir), "ts", "1 hour", F.count(F.lit(1)).alias("n")).select("window_start", "n"), "tumbling", "complete")


@frame("stream_session", SESSIONS.format(k="user_id,", p="PARTITION BY user_id", g="12 HOUR"))
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(stream_windows.session(stream_of(spark, sf_dir), "ts", "12 hours", F.count(F.lit(1)).alias("rows"), keys=("user_id",)).select("user_id", "session_start", "session_end", "rows"), "session", "complete")


@frame(
    "stream_sliding",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events), w AS (SELECT *, unnest(range(greatest((rn - 20) // 10, 0), rn // 10 + 1)) AS window_no FROM r)
    SELECT event_type, window_no, round(sum(value), 4) AS total FROM w WHERE window_no * 10 <= rn AND rn < window_no * 10 + 20 AND window_no * 10 + 20 <= n GROUP BY event_type, window_no""",
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    slid = stream_windows.sliding_count(stream_of(spark, sf_dir), "event_type", "event_id", "value", 20, 10)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return replayed(slid, "sliding").select(F.col("key").alias("event_type"), "window_no", F.round(total, 4).alias("total"))


@frame(
    "stream_window_join",
    """SELECT time_bucket(INTERVAL '1 day', a.ts, TIMESTAMP '1970-01-01') AS window_start, a.user_id, a.event_id AS clicks_event_id, b.event_id AS views_event_id
    FROM events a JOIN events b ON a.user_id = b.user_id AND time_bucket(INTERVAL '1 day', a.ts, TIMESTAMP '1970-01-01') = time_bucket(INTERVAL '1 day', b.ts, TIMESTAMP '1970-01-01')
    WHERE a.event_type = 'click' AND b.event_type = 'view'""",
)
def stream_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda kind: stream_of(spark, sf_dir).where(F.col("event_type") == kind).select("ts", "user_id", "event_id")
    joined = stream_windows.window_join({"clicks": side("click"), "views": side("view")}, "ts", "1 day", ["user_id"])
    return replayed(joined.select("window_start", "user_id", "clicks_event_id", "views_event_id"), "join")


@frame("stream_buffer_join", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def stream_buffer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs that land as files, joined in a configured window, which closes as the replay ends."""
    from rivulet.streaming import runtime

    out = scratch(spark, "joined")
    sources = []
    for name, table in (("nations", "nation"), ("regions", "region")):
        landing = scratch(spark, name)
        load(spark, sf_dir, table).select(F.to_json(F.struct("*")).alias("value")).write.text(landing)
        sources.append({"name": name, "type": "http", "landing": landing, "codec": None})
    one = {
        "id": f"joined-{uuid.uuid4().hex}", "input": {"type": "multiple_inputs", "inputs": sources}, "output": {"type": "file", "path": out},
        "buffer": {"type": "tumbling_window", "interval": "1h", "join": {"query": "SELECT n.n_name AS nation, r.r_name AS region FROM nations n JOIN regions r ON n.n_regionkey = r.r_regionkey", "codec": {"type": "json"}}},
    }
    runtime.streams({"streams": [one]})[0].start(spark, scratch(spark, "joined-checkpoint"), once=True).awaitTermination()
    return spark.read.parquet(out)
