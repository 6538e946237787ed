"""Sources, sinks, codecs, processors, windows, lookups, streams."""

import datetime as dt
import json
import threading
import time
import urllib.error
import urllib.request
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.codecs import debezium, protobuf, registry
from rivulet.codecs import json as json_codec
from rivulet.codecs.hook import decoder, encoder
from rivulet.errors import ConfigError, ProcessError, QueryError, ReadError, Unavailable
from rivulet.functions import python as functions
from rivulet.operators import processors, windows
from rivulet.operators.lookup import TableProvider, enrich
from rivulet.operators.vrl import vrl
from rivulet.schema import META, RAW, VALUE, keep_columns, payloads, spark_type, with_meta
from rivulet.sinks import outputs
from rivulet.sources import inputs, jdbc, stores
from rivulet.sources.receiver import Receiver
from rivulet.__main__ import main as command
from rivulet.streaming import buffers, runtime
from rivulet.streaming import config as configurations
from rivulet.streaming import windows as stream_windows


def raw(spark, *texts):
    return spark.createDataFrame([(x if isinstance(x, bytes) else x.encode(),) for x in texts], RAW)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# Schema -------------------------------------------------------------------------------------------------------------


def test_payloads(spark):
    assert payloads(spark.createDataFrame([(b"a",), (None,)], f"{VALUE} binary")).count() == 1
    with pytest.raises(ReadError, match="not found column"):
        payloads(spark.range(1))
    with pytest.raises(ReadError, match="binary"):
        payloads(spark.range(1), "id")


def test_metadata(spark):
    df = with_meta(spark.range(2), source="kafka://orders", partition=2, ext={"a": "b"})
    assert df.first()["__meta_ext"] == {"a": "b"} and df.schema["__meta_partition"].dataType.simpleString() == "bigint"
    assert keep_columns(df, ["nothing", "__meta_source", "id"]).columns == ["id", "__meta_source"]
    assert processors.sql("SELECT count(*) AS n FROM flow WHERE __meta_partition = 2 AND __meta_source LIKE 'kafka%'")(df).first().n == 2


def test_arrow_names():
    assert spark_type("UInt64") == "decimal(20,0)" and spark_type("Timestamp(Nanosecond, None)") == "timestamp_ntz" and spark_type("List(Int32)") == "array<int>" and spark_type("Dictionary(Int32, Utf8)") == "string"
    with pytest.raises(ConfigError):
        spark_type("Decimal256(50, 2)")


# Codecs -------------------------------------------------------------------------------------------------------------
EVERY = '{"null_field":null,"bool_field":true,"int_field":42,"uint_field":18446744073709551615,"float_field":1.5,"string_field":"hello","array_field":[1,2,3],"object_field":{"key":"value"}}'


def test_json_types(spark):
    row = json_codec.decode(raw(spark, EVERY)).first()
    assert (row.bool_field, row.int_field, int(row.uint_field), row.float_field, row.string_field, row.array_field, row.object_field.key, row.null_field) == (True, 42, 18446744073709551615, 1.5, "hello", [1, 2, 3], "value", None)


def test_json_fields_and_errors(spark):
    out = processors.json_to_arrow(fields=["string_field", "int_field"])(raw(spark, EVERY))
    assert set(out.columns) == {"int_field", "string_field"}
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        json_codec.decode(raw(spark, '{"a": 1}', "nope")).collect()
    with pytest.raises(ReadError):
        json_codec.decode(raw(spark, "[1]"))
    back = processors.arrow_to_json(fields=["id"])(spark.range(1).withColumn("x", F.lit(2))).first()
    assert json.loads(bytes(back[VALUE])) == {"id": 0} and back.x == 2


def test_debezium(spark):
    env = lambda op, before, after: json.dumps({"before": before, "after": after, "op": op, "ts_ms": 5, "source": {"db": "d", "table": "t"}})
    df = raw(spark, env("c", None, {"id": 1, "name": "a"}), env("u", {"id": 1, "name": "a"}, {"id": 1, "name": "b"}), env("d", {"id": 1, "name": "b"}, None), env("r", None, {"id": 2, "name": "s"}), '{"after": {"id": 3, "name": "n"}, "op": "c", "ts_ms": 1}')
    got = debezium.decode(df).collect()
    assert [(r.id, r.name, r.op, r.source_db) for r in got] == [(1, "a", "c", "d"), (1, "b", "u", "d"), (1, "b", "d", "d"), (2, "s", "r", "d"), (3, "n", "c", None)]
    assert got[0].before == "null" and json.loads(got[1].before) == {"id": 1, "name": "a"} and got[4].source == "null"
    assert got[0].__fields__ == ["id", "name", "op", "ts_ms", "source_db", "source_table", "before", "source"]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        debezium.decode(raw(spark, "x"), "id bigint").collect()


PROTO = 'syntax = "proto3"; package demo; enum Kind { A = 0; B = 1; } message Message { int64 timestamp = 1; double value = 2; string sensor = 3; // note\n Kind kind = 4; uint64 big = 5; }'


def test_protobuf(spark):
    pytest.importorskip("google.protobuf")
    df = spark.createDataFrame([(1625000000000, 1.5, "t1", 1, Decimal(2**64 - 1), 9), (None, None, None, None, None, None)], "timestamp bigint, value double, sensor string, kind int, big decimal(20,0), other int")
    sent = protobuf.encode(df, PROTO, "demo.Message")
    assert sent.columns == [*df.columns, VALUE]
    got = protobuf.decode(sent.select(VALUE), PROTO, "demo.Message").collect()
    assert [tuple(r)[:4] + (int(r.big),) for r in got] == [(1625000000000, 1.5, "t1", 1, 2**64 - 1), (0, 0.0, "", 0, 0)]
    with pytest.raises(ConfigError):
        protobuf.spark_schema("message M { repeated int32 x = 1; }", "M")
    with pytest.raises(Exception, match="no demo.Message"):
        protobuf.decode(raw(spark, b"\xff\xff\xff"), PROTO, "demo.Message").collect()


def test_schema_registry(spark):
    pytest.importorskip("google.protobuf")
    one = protobuf.encode(spark.createDataFrame([(7, 2.0, "s")], "timestamp bigint, value double, sensor string"), PROTO, "demo.Message").select(VALUE)
    framed = registry.frame(one, 258)
    assert bytes(framed.first()[0])[:5] == b"\x00\x00\x00\x01\x02"
    got = decoder({"type": "schema_registry", "schemas": {258: {"proto": PROTO, "message_type": "demo.Message"}}})(framed).first()
    assert (got.timestamp, got.sensor) == (7, "s")
    for bad in (b"\x00\x01", b"\x01\x00\x00\x00\x01x"):
        with pytest.raises(Exception, match="header"):
            registry.unframe(raw(spark, bad)).collect()
    with pytest.raises(ReadError, match="unknown schema"):
        registry.decode(framed, {})


def test_schema_registry_over_http(spark):
    """Versions of a message are fetched once each and decoded in one pass."""
    pytest.importorskip("google.protobuf")
    newer = PROTO.replace("uint64 big = 5;", "uint64 big = 5; string unit = 6;")
    asked = []

    class Registry(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["Authorization"]))
            body = {"/schemas/ids/1": PROTO, "/schemas/ids/2": newer}.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(json.dumps({"schema": body}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Registry)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        one = registry.frame(protobuf.encode(spark.createDataFrame([(7, 2.0, "s")], "timestamp bigint, value double, sensor string"), PROTO, "demo.Message").select(VALUE), 1)
        two = registry.frame(protobuf.encode(spark.createDataFrame([(8, 3.0, "u", "kg")], "timestamp bigint, value double, sensor string, unit string"), newer, "demo.Message").select(VALUE), 2)
        decode = decoder({"type": "schema_registry", "url": f"http://127.0.0.1:{server.server_address[1]}/", "message_type": "demo.Message", "auth": {"type": "bearer", "token": "t"}})
        for _ in range(2):
            got = sorted(decode(one.union(two)).collect(), key=lambda r: r.timestamp)
            assert [(r.timestamp, r.value, r.sensor, r.unit) for r in got] == [(7, 2.0, "s", None), (8, 3.0, "u", "kg")]
        assert sorted(asked) == [("/schemas/ids/1", "Bearer t"), ("/schemas/ids/2", "Bearer t")]
        with pytest.raises(ReadError, match="unknown schema 9"):
            decode(registry.frame(raw(spark, b""), 9))
    finally:
        server.shutdown()


def test_codec_hooks(spark):
    assert encoder(None)(raw(spark, "a")).count() == 1
    with pytest.raises(ReadError):
        encoder(None)(spark.range(1))
    with pytest.raises(ConfigError):
        decoder({"type": "nope"})


# Sources ------------------------------------------------------------------------------------------------------------


def test_file_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, data string")
    df.write.parquet(str(tmp_path / "p"))
    df.write.json(str(tmp_path / "j"))
    df.write.orc(str(tmp_path / "o"))
    (tmp_path / "c.csv").write_text("id,data\n1,a\n2,b\n")
    table = pa.table({"id": [1, 2], "data": ["a", "b"]})
    (tmp_path / "arrow").mkdir()
    with pa.ipc.new_file(str(tmp_path / "arrow" / "f.arrow"), table.schema) as w:
        w.write_table(table.slice(0, 1))
    with pa.ipc.new_stream(str(tmp_path / "arrow" / "s.arrow"), table.schema) as w:
        w.write_table(table.slice(1, 1))
    for kind, name in (("parquet", "p"), ("json", "j"), ("orc", "o"), ("csv", "c.csv"), ("arrow", "arrow")):
        got = inputs.build(spark, {"type": "file", "format": kind, "path": str(tmp_path / name), "query": {"query": "SELECT id, data FROM t WHERE id > 0", "table": "t"}})
        assert rows(got) == [(1, "a"), (2, "b")], kind
    with pytest.raises(QueryError):
        inputs.build(spark, {"type": "file", "path": str(tmp_path / "p"), "query": "DROP TABLE flow"})
    with pytest.raises(ConfigError):
        inputs.build(spark, {"type": "file", "format": "xls", "path": "x"})
    with pytest.raises(Unavailable):
        inputs.build(spark, {"type": "file", "format": "avro", "path": str(tmp_path / "p")})


S3 = {"type": "s3", "bucket_name": "b", "access_key_id": "k", "secret_access_key": "s"}


def test_stores(spark, tmp_path):
    assert stores.settings(S3 | {"endpoint": "https://e", "region": "r"})["fs.s3a.bucket.b.endpoint"] == "https://e" and stores.settings(S3)["fs.s3a.bucket.b.connection.ssl.enabled"] == "true"
    assert stores.location(S3, "a/b.parquet") == "s3a://b/a/b.parquet" and stores.location(S3, "s3://b/x") == "s3a://b/x"
    gs = {"type": "gs", "bucket_name": "b", "service_account_path": "/k.json"}
    assert stores.location(gs, "/x") == "gs://b/x" and stores.settings(gs)["fs.gs.auth.service.account.json.keyfile"] == "/k.json"
    az = {"type": "az", "account": "acc", "container_name": "c", "access_key": "a2V5"}
    assert stores.location(az, "x") == "abfss://c@acc.dfs.core.windows.net/x" and stores.settings(az) == {"fs.azure.account.key.acc.dfs.core.windows.net": "a2V5"}
    assert stores.location({"type": "hdfs", "url": "hdfs://n:9000/"}, "/x") == "hdfs://n:9000/x" and "fs.http.impl" in stores.settings({"type": "http", "url": "http://h"})
    for bad in ({"type": "ftp"}, {"type": "s3", "bucket_name": "b"}, S3 | {"endpoint": "http://e"}, {"type": "gs", "bucket_name": "b"}, gs | {"service_account_key": "{}"}, {"type": "az", "account": "a"}, az | {"access_key": "?"}, {"type": "http", "url": "x"}, {"type": "hdfs", "url": "x"}):
        with pytest.raises(ConfigError):
            stores.settings(bad)
    spark.range(3).write.parquet(str(tmp_path / "p"))
    conf = spark._jsc.hadoopConfiguration()
    got = inputs.build(spark, {"type": "file", "path": f"file://{tmp_path}/p", "store": {"type": "hdfs", "url": "hdfs://n", "ha_config": {"dfs.nameservices": "n"}}})
    assert got.count() == 3 and conf.get("dfs.nameservices") == "n"
    conf.unset("dfs.nameservices")


def test_generate_memory_and_named_inputs(spark):
    assert inputs.build(spark, {"type": "generate", "context": "x", "batch_size": 10, "count": 25}).count() == 20
    assert rows(inputs.build(spark, {"type": "memory", "messages": ['{"a": 1}'], "codec": {"type": "json"}})) == [(1,)]
    two = {"type": "multiple_inputs", "inputs": [{"name": "x", "type": "memory", "messages": ["1"]}, {"name": "y", "type": "memory", "messages": ["2", "3"]}]}
    assert rows(inputs.build(spark, two).groupBy("__meta_source").count()) == [("x", 1), ("y", 2)]
    for bad in ([], [{"name": "x"}, {"name": "x"}], [{"type": "memory"}]):
        with pytest.raises(ConfigError):
            inputs.build(spark, {"type": "multiple_inputs", "inputs": bad})


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    outputs.build({"type": "sql", "url": url, "table_name": "t", "properties": options})(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, s string"))
    got = inputs.build(spark, {"type": "sql", "url": url, "select_sql": 'SELECT "id", "s" FROM t WHERE "id" > 1', "options": options})
    assert [tuple(r) for r in got.collect()] == [(2, "b")]
    with pytest.raises(ProcessError, match="unsupported"):
        outputs.build({"type": "sql", "url": url, "table_name": "t"})(spark.createDataFrame([([1],)], "a array<int>"))


def test_database_addresses(spark, tmp_path):
    assert jdbc.address("mysql://u:p%40w@h:3306/db?x=1") == ("jdbc:mysql://h:3306/db?x=1", {"user": "u", "password": "p@w"}) and jdbc.address("postgres://h/db") == ("jdbc:postgresql://h/db", {})
    assert jdbc.address("sqlite:///a/b.db") == ("jdbc:sqlite:/a/b.db", {}) and jdbc.address("jdbc:derby:x") == ("jdbc:derby:x", {})
    for bad in ("oracle://u:secret@h/db", "h/db", "mysql:///db"):
        with pytest.raises(ConfigError) as e:
            jdbc.address(bad)
        assert "secret" not in str(e.value)
    outputs.build({"type": "sql", "output_type": {"type": "mysql", "uri": "mysql://u:p@h/db"}, "table_name": "t"})
    (tmp_path / "d.json").write_text('{"value": 1}\n{"value": 5}\n')
    got = inputs.build(spark, {"type": "sql", "input_type": {"type": "json", "path": str(tmp_path / "d.json")}, "select_sql": "SELECT *, value + 10 AS more FROM flow WHERE value > 2"})
    assert rows(got) == [(5, 15)]


def test_tables_of_several_databases(spark, tmp_path):
    names, options = {}, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for k, name in enumerate(("left", "right")):
        url = f"jdbc:derby:{tmp_path}/{name};create=true"
        outputs.build({"type": "sql", "url": url, "table_name": "t", "properties": options})(spark.createDataFrame([(1, f"{name}1"), (2, f"{name}2")][: 2 - k], "id bigint, s string"))
        names[name[0]] = {"url": url, "table": "t", "options": options}
    names["m"] = {"type": "memory", "messages": ['{"id": 1}'], "codec": {"type": "json", "schema": "id bigint"}}
    got = inputs.build(spark, {"type": "sql", "tables": names, "select_sql": "SELECT l.s AS a, r.s AS b FROM l JOIN r ON l.id = r.id JOIN m ON m.id = l.id"})
    assert rows(got) == [("left1", "right1")]
    for bad in ({"tables": names}, {"tables": {"x": {"url": "u"}}, "select_sql": "SELECT 1 FROM x"}):
        with pytest.raises(ConfigError):
            inputs.build(spark, {"type": "sql"} | bad)


def test_generate_intervals(spark):
    """All intervals that windows take; the stream gets its trigger from them."""
    for interval in ("1m", "5min", "250ms", "2 hours"):
        assert inputs.build(spark, {"type": "generate", "context": "x", "interval": interval}, streaming=True).isStreaming
    with pytest.raises(ConfigError):
        inputs.build(spark, {"type": "generate", "context": "x", "interval": "soon"}, streaming=True)


def test_kafka_columns(spark):
    df = spark.createDataFrame([(b"k", b"v", "orders", 2, 9, dt.datetime(2024, 1, 1), 0), (None, b"w", "orders", 2, 10, dt.datetime(2024, 1, 1), 1)], "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int")
    got = inputs.kafka_columns(df)
    assert got.columns == [VALUE, *META] and {f.name: f.dataType for f in got.schema.fields[1:]} == META
    assert got.collect()[0]["__meta_ext"] == {"topic": "orders"} and got.collect()[1]["__meta_timestamp"] is None


@pytest.mark.parametrize("config", [{"type": "mqtt", "host": "h", "port": 1, "topics": ["t"]}, {"type": "nats", "url": "u"}, {"type": "pulsar", "service_url": "u", "topic": "t"}, {"type": "redis", "mode": {}}, {"type": "redis", "mode": "single"}, {"type": "websocket", "url": "u"}, {"type": "modbus", "addr": "a", "points": [1]}, {"type": "nope"}, {"type": "mqtt"}])
def test_absent_inputs(spark, config):
    with pytest.raises(ConfigError):
        inputs.build(spark, config)


def test_modbus_schema():
    assert inputs.modbus_schema([{"name": "c", "type": "coils"}, {"name": "r", "type": "holding_registers"}]).simpleString() == "struct<c:array<boolean>,r:array<int>>"


def test_receiver(spark, tmp_path):
    server = Receiver(str(tmp_path / "land"), "/in", auth={"type": "bearer", "token": "t"}).start()

    def send(path, body, token="t"):
        request = urllib.request.Request(f"http://127.0.0.1:{server.port}{path}", data=body, headers={"Authorization": f"Bearer {token}"})
        try:
            return urllib.request.urlopen(request, timeout=5).status
        except urllib.error.HTTPError as e:
            return e.code

    assert [send("/in", b'{"a": 1}'), send("/in", b"no"), send("/in", b"{}", "x"), send("/else", b"{}")] == [200, 400, 401, 404]
    server.stop()
    got = inputs.build(spark, {"type": "http", "landing": str(tmp_path / "land"), "codec": {"type": "json"}})
    assert rows(got) == [(1,)]


def test_http_input_with_an_address(spark, tmp_path):
    """A receiver beside the driver, for pages of other origins too; a stream reads what it lands."""
    import socket

    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    found = []
    one = {"id": "posted", "input": {"type": "http", "address": f"127.0.0.1:{port}", "path": "/in", "cors_enabled": True, "codec": {"type": "json", "schema": "a bigint"}}, "output": {"type": "memory", "rows": found}}
    stream = runtime.streams({"streams": [one]})[0]
    stream.start(spark, str(tmp_path / "cp"))
    ask = lambda method, body=None: urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}/in", data=body, method=method), timeout=5)
    assert ask("OPTIONS").headers["Access-Control-Allow-Origin"] == "*" and ask("POST", b'{"a": 5}').status == 200
    for _ in range(100):
        time.sleep(0.1)
        if found and stream.progress():
            break
    assert stream.progress()["rows"] >= 0
    stream.stop()
    inputs.RECEIVERS.pop((f"127.0.0.1:{port}", "/in"))[0].stop()
    assert [r.a for r in found] == [5]
    for bad in ({}, {"address": "nowhere"}):
        with pytest.raises(ConfigError):
            inputs.build(spark, {"type": "http"} | bad, streaming=True)


# Sinks --------------------------------------------------------------------------------------------------------------


def test_line_protocol(spark):
    df = spark.createDataFrame([("a b", 1, 2.5, True, 'q"x', 5), (None, None, None, None, None, 6), ("t,=", 3, None, None, None, 7)], "tag string, i int, f double, b boolean, s string, ts bigint")
    got = outputs.line_protocol(df, "my meas,x", {"tag": "tag"}, {"i": "i", "f": "f", "b": "b", "s": "s"}, "ts")
    assert [bytes(r[0]).decode() for r in got.collect()] == ['my\\ meas\\,x,tag=a\\ b i=1i,f=2.5,b=true,s="q\\"x" 5', "my\\ meas\\,x,tag=t\\,\\= i=3i 7"]


class Recorder(BaseHTTPRequestHandler):
    seen: list = []
    fail = 0

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if Recorder.fail:
            Recorder.fail -= 1
            self.send_response(500)
        else:
            Recorder.seen.append((self.path, self.headers["Authorization"], self.headers["Content-Type"], body))
            self.send_response(200)
        self.end_headers()

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Recorder)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Recorder.seen, Recorder.fail = [], 0
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_http_output(spark, server):
    Recorder.fail = 1
    outputs.build({"type": "http", "url": server, "retry_count": 2, "auth": {"type": "basic", "username": "u", "password": "p"}})(raw(spark, "x", "y").coalesce(1))
    assert [b for *_, b in Recorder.seen] == [b"x", b"y"] and Recorder.seen[0][1] == "Basic dTpw" and Recorder.seen[0][2] == "application/json"
    outputs.build({"type": "http", "url": server, "body_field": "s"})(spark.createDataFrame([("one", 1)], "s string, n int"))
    assert Recorder.seen[-1][-1] == b"one"
    with pytest.raises(ConfigError):
        outputs.build({"type": "http", "url": server, "method": "BREW"})


def test_influx_output(spark, server):
    outputs.build({"type": "influxdb", "url": server, "org": "o", "bucket": "b", "token": "t", "measurement": "m", "fields": {"v": "id"}, "batch_size": 2})(spark.range(3).coalesce(1))
    outputs.build({"type": "influxdb", "url": server, "org": "o", "bucket": "b", "token": "t", "measurement": "m", "tags": [{"field": "t", "tag_name": "k"}], "fields": [{"field": "id", "field_name": "v"}], "timestamp_field": "id"})(spark.range(1).withColumn("t", F.lit("x")))
    assert Recorder.seen.pop()[-1] == b"m,k=x v=0i 0"
    assert [len(b.split(b"\n")) for *_, b in Recorder.seen] == [2, 1] and Recorder.seen[0][0].startswith("/api/v2/write?org=o") and Recorder.seen[0][1] == "Token t"


def test_routing(spark):
    got = outputs.routed(spark.createDataFrame([(1, "a")], "id int, s string"), {"topic": {"expr": "'t-' || s"}, "key": {"value": "k"}, "codec": {"type": "json"}}).first()
    assert (got.topic, got.key, json.loads(bytes(got.value))) == ("t-a", "k", {"id": 1, "s": "a"})
    with pytest.raises(ConfigError):
        outputs.dynamic({"expr": "a", "value": "b"})


def test_simple_outputs(spark, capsys, tmp_path):
    outputs.build({"type": "drop"})(spark.range(3))
    outputs.build({"type": "stdout"})(raw(spark, "hi"))
    assert capsys.readouterr().out == "hi\n"
    outputs.build({"type": "file", "path": str(tmp_path / "f")})(spark.range(3))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 3
    for config in ({"type": "mongodb", "uri": "u", "database": "d", "collection": "c"}, {"type": "nope"}, {"type": "mqtt"}, {"type": "kafka"}, {"type": "kafka", "brokers": ["b"], "topic": "t", "transactional_id": "x"}):
        with pytest.raises(ConfigError):
            outputs.build(config)
    with pytest.raises(Exception):  # noqa: B017, PT011  Spark's kafka package isn't here
        outputs.build({"type": "kafka", "brokers": ["b"], "topic": "t"})(raw(spark, "x"))


# Processors ---------------------------------------------------------------------------------------------------------


def test_sql_processor(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "id int, amount int")
    assert rows(processors.sql("SELECT sum(amount) AS s FROM my", table="my")(df)) == [(30,)]
    with pytest.raises(QueryError):
        processors.sql("DELETE FROM flow")
    names = spark.createDataFrame([(1, "one")], "k int, name string")
    got = processors.sql("SELECT f.id, n.name FROM flow f LEFT JOIN names n ON f.id = n.k", temporaries={"names": TableProvider(names, "k")})(df)
    assert rows(got) == [(1, "one"), (2, None)]


def test_lookup_by_key(spark):
    """A lookup table has the rows of the batch's keys, or of one."""
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, s string")
    names = TableProvider(spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k bigint, name string"), "k")
    got = lambda key: sorted(r.name for r in processors.sql("SELECT n.name FROM names n", temporaries={"names": (names, key)})(df).collect())
    assert got({"expr": "id + 1"}) == ["three", "two"] and got({"value": "3"}) == ["three"] and got({"expr": "id * 10"}) == [] and got(None) == ["one", "three", "two"]
    for bad in ({}, {"expr": "id", "value": "1"}):
        with pytest.raises(ConfigError):
            processors.sql("SELECT 1 FROM names", temporaries={"names": (names, bad)})
    config = {"type": "sql", "query": "SELECT f.id, n.name FROM flow f JOIN names n ON f.id = n.k", "temporary_list": [{"name": "t", "table_name": "names", "key": {"expr": "id"}}]}
    assert rows(runtime.processor(config, {"t": names})(df.distinct())) == [(1, "one"), (2, "two")]


def test_lookup(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(enrich(df, TableProvider(lambda s: s.createDataFrame([(2, "b")], "k int, v string"), "k"), "id", "k")) == [(1, None, None), (2, 2, "b")]
    with pytest.raises(ConfigError):
        enrich(df, TableProvider(df, "zz"), "id", "zz")


def test_python_processor(spark):
    script = "import pyarrow as pa\nimport pyarrow.compute as pc\ndef double(b):\n    return [pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(0), 2)], names=['v', 'v2'])]\n"
    df = spark.createDataFrame([(10,), (19,), (11,)], "v bigint")
    assert rows(processors.python(script=script, name="double")(df)) == [(10, 20), (11, 22), (19, 38)]
    assert processors.python(lambda b: [], "v bigint")(df).count() == 0
    with pytest.raises(Exception, match="list"):
        processors.python(lambda b: b, "v bigint")(df).collect()
    for bad in ({}, {"script": "x = 1", "name": "nope"}, {"script": "x = 1", "module": "json"}):
        with pytest.raises(ConfigError):
            processors.python(**bad)


def test_batch_processor(spark):
    assert processors.batch(count=2, timeout_ms=5)(spark.range(3)).count() == 3
    with pytest.raises(ConfigError):
        processors.batch(count=0)


def test_vrl(spark):
    df = spark.createDataFrame([(3, "abc"), (30, None)], "value int, s string")
    got = vrl('.v2, err = .value * 2\n.t = upcase(.s) ?? "none"\nif .value > 10 && !is_null(.value) { .c = "big" } else if .value > 2 { .c = "mid" } else { .c = "low" }\nhalf = .value / 2\n.h = half\ndel(.s)\n.')(df)
    assert got.columns == ["value", "v2", "t", "c", "h"] and rows(got) == [(3, 6, "ABC", "mid", 1.5), (30, 60, "none", "big", 15.0)]
    for bad, error in (("", QueryError), (".a = nope(.b)", QueryError), ("1 + 1", ProcessError), (".a.b = 1", QueryError), (".a = {", QueryError), ("for x in y", QueryError), (". = .s", ProcessError), ("[1, 2]", ProcessError), (".a = parse_timestamp(.s, .s)", QueryError), (".a = upcase()", QueryError)):
        with pytest.raises(error):
            vrl(bad)(df)


def test_vrl_json(spark):
    """Parsed JSON: nested fields, text again in the result, as the whole event; bad text is an error with !, else null."""
    df = spark.createDataFrame([('{"a": {"b": [1, 2]}, "c": "x"}', 5), ('{"a": {"b": []}, "c": "y"}', 6)], "message string, n int")
    got = vrl('data = parse_json!(.message)\n.b = to_int(data.a.b[1])\n.c = data.c\n.all = data.a\ndel(.message)')(df)
    assert got.columns == ["n", "b", "c", "all"] and rows(got) == [(5, 2, "x", '{"b":[1,2]}'), (6, None, "y", '{"b":[]}')]
    assert rows(vrl(". = parse_json!(.message)\n.c = upcase(.c)\ndel(.a)")(df)) == [("X",), ("Y",)]
    assert rows(vrl('. = merge(., {"k": .n + 1, "o": {"z": .n}})\n.p = .o.z\ndel(.message)\ndel(.o)')(df)) == [(5, 6, 5), (6, 7, 6)]
    broken = spark.createDataFrame([("not json",)], "message string")
    assert rows(vrl('.x = parse_json(.message) ?? "none"\n.y, err = parse_json(.message)\n.e = err\ndel(.message)')(broken.withColumn("n", F.lit(1)).drop("n")))[0][-1] == "the expression failed"
    for program in ("parse_json!(.message)", ".x = parse_json!(.message).a", ".x = to_int!(.message)"):
        with pytest.raises(Exception, match="MALFORMED|Malformed|CAST_INVALID|JsonParse"):
            vrl(program)(broken).collect()


def test_vrl_rows_abort_and_time(spark):
    df = spark.createDataFrame([(1, "2024-01-31 10:00", "a,b"), (2, "2024-02-29 23:30", "c")], "n int, t string, s string")
    got = vrl('[{"n": .n, "k": "one"}, {"n": .n * 10, "m": .s}]')(df)
    assert got.columns == ["n", "k", "m"] and rows(got) == [(1, "one", None), (10, None, "a,b"), (2, "one", None), (20, None, "c")]
    got = vrl('.at = parse_timestamp!(.t, format: "%Y-%m-%d %H:%M")\n.day = format_timestamp!(.at, "%d.%m.%Y")\n.unix = to_unix_timestamp(.at)\n.parts = split(.s, ",")\n.first = .parts[0]\n.m = match(.s, r\'^a\')\ndel(.t)\ndel(.at)\ndel(.s)')(df)
    assert rows(got) == [(1, "31.01.2024", 1706695200, ["a", "b"], "a", True), (2, "29.02.2024", 1709249400, ["c"], "c", False)]
    tokyo = vrl('.unix = to_unix_timestamp(parse_timestamp!(.t, "%Y-%m-%d %H:%M"))\n.d = format_timestamp!(parse_timestamp!(.t, "%Y-%m-%d %H:%M"), "%H")\ndel(.t)\ndel(.s)', "Asia/Tokyo")(df)
    assert rows(tokyo) == [(1, 1706695200 - 9 * 3600, "10"), (2, 1709249400 - 9 * 3600, "23")]
    assert rows(vrl(".", "Not/A_Zone")(df)) == rows(df)
    assert rows(vrl("if .n > 5 { abort }\n.")(df)) == rows(df)
    for program in ("if .n > 1 { abort }", "if .n > 5 { .x = 1 } else if .n > 1 { abort } else { .x = 2 }", "abort"):
        with pytest.raises(Exception, match="aborted"):
            vrl(program + "\n.")(df).collect()


def test_user_functions(spark):
    functions.SCALAR.clear()

    @functions.scalar("plus_one", "bigint")
    def plus_one(s):
        return s + 1

    with pytest.raises(ConfigError, match="already"):
        functions.scalar("plus_one", "bigint")(lambda s: s)
    functions.aggregate("spread_", "double")(lambda s: float(s.max() - s.min()))
    assert processors.sql("SELECT spread_(plus_one(id)) AS v FROM flow")(spark.range(5)).first().v == 4.0
    assert processors.sql("SELECT id, spread_(id) OVER (PARTITION BY id % 2) AS v FROM flow")(spark.range(4)).count() == 4


# Windows ------------------------------------------------------------------------------------------------------------


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_sliding_count(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "n bigint")
    got = windows.sliding_count(df, ["n"], 3, 2).groupBy("window_no").agg(F.sort_array(F.collect_list("n")).alias("v"))
    assert rows(got) == [(0, [0, 1, 2]), (1, [2, 3, 4])]
    assert windows.sliding_count(df, ["n"], 6, 1).count() == 0 and windows.sliding_count(df.limit(0), ["n"], 2, 1).count() == 0
    for size, slide in ((0, 1), (2, 0), (2, 3)):
        with pytest.raises(ConfigError):
            windows.sliding_count(df, ["n"], size, slide)


def test_sessions_and_tumbling(spark):
    df = spark.createDataFrame([(at(s), s) for s in (0, 1, 5, 20, 21)], "ts timestamp, v int")
    assert [(r.session_start, r.rows) for r in windows.session_bounds(df, "ts", "10 seconds").orderBy("session_start").collect()] == [(at(0), 3), (at(20), 2)]
    assert rows(windows.tumbling(df, "ts", "10 seconds").groupBy("window_start").count()) == [(at(0), 3), (at(20), 2)]


def test_sessions_over_ranges(spark):
    """Sessions that go on over several sorted ranges, with ties, gaps of just the length and rows without time."""
    r = np.random.default_rng(2)
    for gap, times in ((3, np.cumsum(r.integers(0, 7, 400))), (5, np.arange(0, 900, 5)), (1, np.array([])), (2, np.repeat([4, 9, 11], 60))):
        df = spark.createDataFrame([(at(int(t)),) for t in times] + [(None,)], "ts timestamp").repartition(9)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = windows.session_bounds(df, "ts", f"{gap} seconds").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        want, last = [], None
        for t in times.tolist():
            if last is None or t > last + gap:
                want.append([t, t, 0])
            want[-1][1:], last = [t, want[-1][2] + 1], t
        assert sorted((x.session_start, x.session_end, x.rows) for x in got) == [(at(int(a)), at(int(b) + gap), n) for a, b, n in want]


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from rivulet.session import shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ConfigError, match="checkpoint"):
            shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master)))


def test_functions_over_partitions(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 1, 5), ("b", 2, 7), ("a", 2, 2)], "k string, o int, v int")
    got = windows.over_partitions(df, lambda v, o: v.cumsum() - o, "s", "bigint", ["v", "o"], ["k"], ["o"])
    assert rows(got.select("k", "o", "s")) == [("a", 1, 4), ("a", 2, 5), ("a", 3, 5), ("b", 2, 5)]
    with pytest.raises(Exception, match="1 values for 3 rows"):
        windows.over_partitions(df, lambda v: v[:1], "s", "int", ["v"], ["k"], ["o"]).collect()
    with pytest.raises(ConfigError):
        windows.over_partitions(df, lambda v: v, "s", "int", ["v"], [], ["o"])


def test_window_join_needs_both_inputs(spark):
    a = spark.createDataFrame([(at(1), 1, 10), (at(31), 1, 11)], "ts timestamp, id int, v int")
    b = spark.createDataFrame([(at(2), 1, 20)], "ts timestamp, id int, v int")
    got = windows.window_join({"a": a, "b": b}, "ts", "10 seconds", ["id"])
    assert [(r.a_v, r.b_v) for r in got.collect()] == [(10, 20)]


def stream_of(spark, tmp_path, name, batches, schema):
    """A file stream whose files are micro-batches."""
    folder = tmp_path / name
    folder.mkdir()
    for k, b in enumerate(batches):
        path = folder / f"{k}.json"
        path.write_text("\n".join(json.dumps(r) for r in b) + "\n")
        import os

        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_windows_equal_bounded_ones(spark, tmp_path):
    data = [[{"ts": str(at(s)), "k": s % 2, "v": s} for s in part] for part in (range(0, 10), range(10, 25), range(60, 61), range(100, 101))]
    schema = "ts timestamp, k int, v int"
    got = run(stream_windows.tumbling(stream_of(spark, tmp_path, "a", data, schema), "ts", "10 seconds", F.count(F.lit(1)).alias("n")), tmp_path, "tumbled")
    closed = rows(got.select("window_start", "n"))
    assert closed[:3] == [(at(0), 10), (at(10), 10), (at(20), 5)]
    got = run(stream_windows.session(stream_of(spark, tmp_path, "b", data, schema), "ts", "5 seconds", F.sum("v").alias("s"), keys=("k",)), tmp_path, "sessions")
    assert (at(0), sum(range(0, 25, 2))) in [(r.session_start, r.s) for r in got.collect()]


def test_stream_sliding_count(spark, tmp_path):
    df = stream_of(spark, tmp_path, "c", [[{"k": "x", "o": 0, "v": 0}, {"k": "x", "o": 1, "v": 1}], [{"k": "x", "o": 2, "v": 2}, {"k": "y", "o": 3, "v": 9}], [{"k": "x", "o": 4, "v": 3}, {"k": "x", "o": 5, "v": 4}]], "k string, o int, v double")
    got = run(stream_windows.sliding_count(df, "k", "o", "v", 3, 2), tmp_path, "slid")
    assert rows(got) == [("x", 0, [0.0, 1.0, 2.0]), ("x", 1, [2.0, 3.0, 4.0])]


def test_stream_window_join(spark, tmp_path):
    schema = "ts timestamp, id int, v int"
    a = stream_of(spark, tmp_path, "d", [[{"ts": str(at(1)), "id": 1, "v": 10}], [{"ts": str(at(31)), "id": 1, "v": 11}]], schema)
    b = stream_of(spark, tmp_path, "e", [[{"ts": str(at(2)), "id": 1, "v": 20}], [{"ts": str(at(50)), "id": 1, "v": 21}]], schema)
    got = run(stream_windows.window_join({"a": a, "b": b}, "ts", "10 seconds", ["id"]), tmp_path, "joined")
    assert [(r.a_v, r.b_v) for r in got.collect()] == [(10, 20)]


# Runtime ------------------------------------------------------------------------------------------------------------


def config(tmp_path, found, errors=None, sql="SELECT id, v / 2 AS h FROM flow"):
    one = {"id": "s1", "input": {"type": "memory", "messages": ['{"id": 1, "v": 7}', '{"id": 2, "v": 9}'], "codec": {"type": "json"}}, "pipeline": {"processors": [{"type": "sql", "query": sql}]}, "output": {"type": "memory", "rows": found}}
    if errors is not None:
        one["error_output"] = {"type": "memory", "rows": errors}
    return {"streams": [one]}


def test_run(spark, tmp_path):
    found = []
    stream = runtime.streams(config(tmp_path, found))[0]
    metrics = stream.run(spark)
    assert sorted(map(tuple, found)) == [(1, 3), (2, 4)] and (metrics.batches_in, metrics.rows_in, metrics.rows_out, metrics.errors) == (1, 2, 2, 0)


def test_error_output_gets_the_input(spark, tmp_path):
    found, errors = [], []
    stream = runtime.streams(config(tmp_path, found, errors, "SELECT id / 0 AS x FROM flow"))[0]
    assert stream.run(spark).errors == 1 and not found and sorted(r.id for r in errors) == [1, 2]


def test_configuration(tmp_path):
    found = []
    with pytest.raises(ConfigError):
        runtime.streams({"streams": [{"input": {}}]})
    two = config(tmp_path, found)["streams"] * 2
    with pytest.raises(ConfigError, match="two streams"):
        runtime.streams({"streams": two})
    with pytest.raises(ConfigError, match="URL"):
        runtime.streams({"streams": [two[0] | {"id": "a b"}]})
    assert runtime.streams({"streams": [{k: v for k, v in two[0].items() if k != "id"}]})[0].id == "stream-0"
    (tmp_path / "c.json").write_text('{"streams": []}')
    (tmp_path / "c.toml").write_text("streams = []")
    assert runtime.load(str(tmp_path / "c.json")) == runtime.load(str(tmp_path / "c.toml")) == {"streams": []}
    with pytest.raises(ConfigError):
        (tmp_path / "c.ini").write_text("")
        runtime.load(str(tmp_path / "c.ini"))
    assert set(runtime.components()) == {"input", "output", "codec", "processor", "buffer", "temporary"}


def test_components_have_schemas():
    """The components that are described are those that can be built."""
    assert set(configurations.COMPONENTS["input"]) == set(inputs.INPUTS) and set(configurations.COMPONENTS["output"]) == set(outputs.OUTPUTS) and set(configurations.COMPONENTS["buffer"]) == set(buffers.KINDS)
    whole = configurations.schema()
    assert len(whole["properties"]["streams"]["items"]["properties"]["input"]["oneOf"]) == len(inputs.INPUTS)
    for kind, named in configurations.COMPONENTS.items():
        for name in named:
            own = configurations.schema_of(kind, name)
            assert set(own["required"]) <= set(own["properties"])
    with pytest.raises(ConfigError):
        configurations.schema_of("input", "nope")


def test_validation(tmp_path):
    good = config(tmp_path, [])["streams"][0]
    assert configurations.validate({"streams": [good]}) == [] and configurations.validate({"streams": [good | {"pipeline": {"processors": None}}]}) == []
    assert configurations.validate({"streams": [good | {"input": {"type": "mqtt", "host": "h", "port": 1, "topics": ["t"]}, "output": {"type": "mongodb", "uri": "u", "database": "d", "collection": "c"}}]}) == []
    issues = {i.path for i in configurations.validate({"streams": [
        {"input": {"type": "file"}}, good | {"output": {"type": "nope"}}, good | {"buffer": {"type": "tumbling_window", "interval": "soon"}}, good | {"pipeline": {"processors": [{"type": "sql", "query": "DROP TABLE x"}]}}, 7,
        good | {"id": "a b"}, good | {"id": "x", "input": {"type": "generate", "context": 5, "speed": 1}}, good | {"id": "x", "input": {"type": "memory", "codec": {"type": "xml"}}}, {"input": 3, "output": {"type": "drop"}},
        good | {"id": "m", "input": {"type": "multiple_inputs", "inputs": [{"type": "memory"}, {"type": "zzz"}]}},
    ]})}
    assert issues == {
        "streams[0].input.path", "streams[0].output", "streams[1].output.type", "streams[2].id", "streams[3].id", "streams[4]", "streams[5]", "streams[6].input.context", "streams[6].input.speed", "streams[7].input.codec.type",
        "streams[7].id", "streams[8].input", "streams[9].input.inputs[1].type",
    }
    assert [i.path for i in configurations.validate({"streams": [good | {"buffer": {"type": "tumbling_window", "interval": "soon"}}]})] == ["streams[0]"]
    assert [i.path for i in configurations.validate({"streams": [good | {"pipeline": {"processors": [{"type": "sql", "query": "DROP TABLE x"}]}}]})] == ["streams[0]"]
    assert [i.path for i in configurations.validate({})] == ["streams"]


def test_redaction():
    given = {"input": {"url": "postgres://u:pw@h/db", "password": "p", "auth": {"token": "t", "user": "u"}, "Api_Key": 5, "list": [{"secret_key": "s"}], "password_file": None}}
    assert configurations.redact(given) == {"input": {"url": "postgres://u:******@h/db", "password": "******", "auth": {"token": "******", "user": "u"}, "Api_Key": "******", "list": [{"secret_key": "******"}], "password_file": None}}
    assert given["input"]["password"] == "p"


def test_versions(tmp_path):
    kept = configurations.Versions(str(tmp_path / "versions"))
    assert kept.all() == []
    first = kept.save('{"streams": []}', "json")
    second = kept.save("streams = []", "toml", first.id)
    assert {v.id for v in kept.all()} == {first.id, second.id} and kept.text(second.id) == ("streams = []", "toml")
    again = kept.rollback(first.id)
    assert again.parent_id == first.id and kept.text(again.id) == kept.text(first.id) and len(kept.all()) == 3
    for bad in (lambda: kept.save("{", "json"), lambda: kept.text("../x"), lambda: kept.rollback("none"), lambda: kept.save("[]", "json")):
        with pytest.raises(ConfigError):
            bad()


def test_command_line(tmp_path, capsys):
    def says(*words):
        code = command(list(words))
        out = capsys.readouterr()
        return code, out.out + out.err

    assert "sliding_window" in says("components", "list")[1] and says("components", "list", "--kind", "codec")[1].startswith("codec: ")
    assert json.loads(says("components", "show", "input", "file", "--format", "json")[1])["required"] == ["type", "path"] and "path (string, needed)" in says("components", "show", "input", "file")[1]
    assert json.loads(says("schema")[1])["required"] == ["streams"] and says("components", "show", "input", "nope")[0] == 1 and says()[0] == 1
    good, bad = tmp_path / "good.json", tmp_path / "bad.toml"
    good.write_text(json.dumps({"streams": [{"input": {"type": "memory", "messages": ["a"]}, "output": {"type": "drop"}}]}))
    bad.write_text('[[streams]]\ninput = {type = "file"}\n')
    assert says("--config", str(good), "--validate") == (0, "the configuration is valid\n")
    assert says("-c", str(bad), "-v") == (1, "streams[0].output: is needed\nstreams[0].input.path: is needed\n")
    assert says("-c", str(tmp_path / "none.json"))[0] == 1


def test_bounded_window_join(spark):
    found = []
    one = {
        "input": {"type": "multiple_inputs", "inputs": [{"name": "flow_input1", "type": "memory", "messages": ['{"id": 1, "value": 10}']}, {"name": "flow_input2", "type": "memory", "messages": ['{"id": 1, "value": 20}']}]},
        "buffer": {"type": "session_window", "gap": "1s", "join": {"query": "SELECT a.value AS x, b.value AS y FROM flow_input1 a JOIN flow_input2 b ON (a.id = b.id)", "codec": {"type": "json"}}}, "output": {"type": "memory", "rows": found},
    }
    runtime.streams({"streams": [one]})[0].run(spark)
    assert [tuple(r) for r in found] == [(10, 20)]


def test_sliding_window_buffer(spark, tmp_path):
    found = []
    one = config(tmp_path, found, sql="SELECT window_no, count(*) AS n, sum(v) AS s FROM flow GROUP BY window_no")["streams"][0]
    one["input"]["messages"] = [json.dumps({"v": k}) for k in range(5)]
    one["buffer"] = {"type": "sliding_window", "window_size": 3, "slide_size": 2, "interval": "1s"}
    stream = runtime.streams({"streams": [one]})[0]
    stream.run(spark)
    assert sorted(map(tuple, found)) == [(0, 3, 3), (1, 3, 9)]
    for buffer in ({"type": "nope"}, {"type": "sliding_window", "window_size": 3}, {"type": "sliding_window", "window_size": 3, "slide_size": 4}, {"type": "tumbling_window"}, {"type": "session_window", "gap": "soon"}, {"type": "memory", "capacity": 0}, {"type": "memory", "capacity": 5, "join": {"query": "SELECT 1"}}):
        with pytest.raises(ConfigError):
            runtime.streams({"streams": [one | {"buffer": buffer}]})


class Clock:
    def __init__(self):
        self.at = 100.0

    def __call__(self):
        return self.at


def buffered(spark, tmp_path, config, clock, found):
    return buffers.Buffer(spark, str(tmp_path / "buffer"), config, lambda df: found.append(sorted(tuple(r) for r in df.collect())), clock)


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v bigint")


def test_buffer_windows_by_the_clock(spark, tmp_path):
    """Tumbling windows close every interval, sessions after a gap, memory at its capacity or timeout; empty windows give nothing."""
    for k, (config, times, want) in enumerate([
        ({"type": "tumbling_window", "interval": "10s"}, (1, 8, 9, 25, 26, 41), [[(1,), (2,), (3,)], [(4,), (5,)]]),
        ({"type": "session_window", "gap": "5s"}, (1, 4, 8, 14, 18, 30), [[(1,), (2,), (3,)], [(4,), (5,)]]),
        ({"type": "memory", "capacity": 2, "timeout": "4s"}, (1, 2, 3, 20, 21, 40), [[(1,), (2,)], [(3,)], [(4,), (5,)]]),
    ]):
        found, clock = [], Clock()
        buffer = buffered(spark, tmp_path / str(k), config, clock, found)
        for n, t in enumerate(times, 1):
            for at in np.arange(clock.at - 100 + 0.5, t, 0.5):  # the clock is looked at in between
                clock.at = 100 + at
                buffer.tick()
            clock.at = 100 + t
            if n < len(times):
                buffer.add(numbers(spark, n), n)
        assert found == want, config
        assert not buffer.staged


def test_sliding_buffer_and_restart(spark, tmp_path):
    """Windows of rows over micro-batches, numbered on; what is staged is there after a restart, a batch that comes again counts once."""
    found, clock, config = [], Clock(), {"type": "sliding_window", "window_size": 3, "slide_size": 2}
    buffer = buffered(spark, tmp_path, config, clock, found)
    buffer.add(numbers(spark, 0, 1), 0)
    buffer = buffered(spark, tmp_path, config, clock, found)
    buffer.add(numbers(spark, 2), 1)
    assert found == [[(0, 0), (1, 0), (2, 0)]] and [s.rows for s in buffer.staged] == [1]
    buffer = buffered(spark, tmp_path, config, clock, found)
    buffer.add(numbers(spark, 3), 2)
    buffer.add(numbers(spark, 3), 2)
    buffer.add(numbers(spark, 4, 5, 6, 7), 3)
    assert found[1:] == [[(2, 1), (3, 1), (4, 1), (4, 2), (5, 2), (6, 2)]] and [s.rows for s in buffer.staged] == [2]


def test_stream_with_buffer(spark, tmp_path):
    """Micro-batches of a configured stream are one window; a bounded replay closes it at its end, a stopped one keeps it staged."""
    folder, found = tmp_path / "in", []
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text(json.dumps({"id": k}) + "\n")
    one = {"id": "buffered", "input": {"type": "file", "format": "json", "path": str(folder), "schema": "id bigint", "max_files_per_batch": 1}, "buffer": {"type": "session_window", "gap": "1h"}, "pipeline": {"processors": [{"type": "sql", "query": "SELECT count(*) AS n, sum(id) AS s FROM flow"}]}, "output": {"type": "memory", "rows": found}}
    stream = runtime.streams({"streams": [one]})[0]
    assert stream.state() == "created"
    stream.start(spark, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert [tuple(r) for r in found] == [(3, 3)] and stream.state() == "stopped"
    (folder / "3.json").write_text(json.dumps({"id": 30}) + "\n")
    stream.start(spark, str(tmp_path / "cp"))
    with pytest.raises(ConfigError, match="running"):
        stream.start(spark, str(tmp_path / "cp"))
    stream.query.processAllAvailable()
    assert stream.state() == "running" and stream.metrics.batches_in == 1
    stream.stop()
    assert stream.state() == "stopped" and len(found) == 1
    stream.start(spark, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert [tuple(r) for r in found] == [(3, 3), (1, 30)]


def test_batch_processor_collects_micro_batches(spark, tmp_path):
    folder, found = tmp_path / "in", []
    folder.mkdir()
    for k in range(5):
        (folder / f"{k}.json").write_text(json.dumps({"id": k}) + "\n")
    one = {"id": "batched", "input": {"type": "file", "format": "json", "path": str(folder), "schema": "id bigint", "max_files_per_batch": 1}, "pipeline": {"processors": [{"type": "batch", "count": 2, "timeout_ms": 3600000}, {"type": "sql", "query": "SELECT count(*) AS n FROM flow"}]}, "output": {"type": "memory", "rows": found}}
    runtime.streams({"streams": [one]})[0].start(spark, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert [r.n for r in found] == [2, 2, 1]


def test_stream_with_buffer_on_the_clock(spark, tmp_path):
    folder, found = tmp_path / "in", []
    folder.mkdir()
    (folder / "0.json").write_text(json.dumps({"id": 1}) + "\n")
    one = {"id": "ticking", "input": {"type": "file", "format": "json", "path": str(folder), "schema": "id bigint"}, "buffer": {"type": "tumbling_window", "interval": "500ms"}, "output": {"type": "memory", "rows": found}}
    stream = runtime.streams({"streams": [one]})[0]
    stream.start(spark, str(tmp_path / "cp"))
    for _ in range(200):
        time.sleep(0.1)
        if found:
            break
    stream.stop()
    assert [r.id for r in found] == [1]


def test_stream_window_join_of_buffers(spark, tmp_path):
    """Inputs that are joined within a window; a window that misses an input gives nothing."""
    found = []

    def source(name):
        (tmp_path / name).mkdir()
        return {"name": name, "type": "http", "landing": str(tmp_path / name)}

    one = {
        "id": "joined", "input": {"type": "multiple_inputs", "inputs": [source("a"), source("b")]}, "output": {"type": "memory", "rows": found},
        "buffer": {"type": "tumbling_window", "interval": "1h", "join": {"query": "SELECT a.id, a.v AS x, b.v AS y FROM a JOIN b ON a.id = b.id", "codec": {"type": "json", "schema": "id bigint, v bigint"}}},
    }
    stream = runtime.streams({"streams": [one]})[0]
    for n, names in enumerate((("a", "b"), ("a",))):
        for name in names:
            (tmp_path / name / f"{n}.json").write_text("".join(json.dumps({"id": k, "v": 10 * n + k}) + "\n" for k in range(2)))
        stream.start(spark, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert sorted(map(tuple, found)) == [(0, 0, 0), (1, 1, 1)]


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    """A stopped stream goes on from its checkpoint with the files that came meanwhile."""
    folder = tmp_path / "in"
    folder.mkdir()
    found: list = []
    one = {"id": "files", "input": {"type": "file", "format": "json", "path": str(folder), "schema": "id bigint"}, "pipeline": {"processors": [{"type": "sql", "query": "SELECT id * 10 AS x FROM flow"}]}, "output": {"type": "memory", "rows": found}}
    stream = runtime.streams({"streams": [one]})[0]
    for k in range(3):
        (folder / f"{k}.json").write_text(json.dumps({"id": k}) + "\n")
        stream.start(spark, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert sorted(r.x for r in found) == [0, 10, 20] and stream.metrics.rows_in == 3


def test_intervals():
    assert [windows.seconds(x) for x in ("500ms", "1s", "5 minutes", "2 hours")] == [0.5, 1, 300, 7200]
    with pytest.raises(ConfigError):
        windows.seconds("soon")


def test_speed_of_small_batches(spark):
    """Planning of a query over a small batch stays short once the session is warm."""
    p = processors.sql("SELECT id, id + 1 AS n FROM flow")
    df = spark.range(5)
    p(df).collect()
    start = time.perf_counter()
    for _ in range(10):
        p(df).collect()
    assert time.perf_counter() - start < 10
