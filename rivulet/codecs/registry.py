"""Schema-registry framing: a zero byte, the schema's id in four big-endian bytes, the payload."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.errors import ReadError
from rivulet.schema import VALUE, payloads


def unframe(df: DataFrame, column: str = VALUE) -> DataFrame:
    """Add schema_id and replace the payload by what follows the header; a wrong header is an error."""
    v = F.col(column)
    good = (F.length(v) >= 5) & (F.hex(F.substring(v, 1, 1)) == "00")
    fail = F.raise_error(F.lit("no schema registry header")).cast("int")
    number = F.conv(F.hex(F.substring(v, 2, 4)), 16, 10).cast("bigint")
    return payloads(df, column).withColumn("schema_id", F.when(good, number).otherwise(fail)).withColumn(column, F.expr(f"substring(`{column}`, 6)"))


def frame(df: DataFrame, schema_id: int, column: str = VALUE) -> DataFrame:
    """The reverse of unframe for one schema."""
    return df.withColumn(column, F.concat(F.unhex(F.lit(f"00{schema_id:08x}")), F.col(column)))


class HttpResolver:
    """Protobuf decoders by schema id, from a schema registry's HTTP interface (GET <url>/schemas/ids/<id>). A schema is fetched once."""

    def __init__(self, url: str, message: str, auth: dict | None = None, timeout: float = 10.0):
        self.url, self.message, self.timeout, self.schemas = url.rstrip("/"), message, timeout, {}
        self.headers = {"Accept": "application/vnd.schemaregistry.v1+json, application/json"}
        if auth:
            self.headers["Authorization"] = f"Bearer {auth['token']}" if auth.get("type") == "bearer" else "Basic " + base64.b64encode(f"{auth['username']}:{auth['password']}".encode()).decode()

    def schema(self, number: int) -> str:
        if number not in self.schemas:
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.url}/schemas/ids/{number}", headers=self.headers), timeout=self.timeout) as answer:
                    self.schemas[number] = json.load(answer)["schema"]
            except urllib.error.HTTPError as e:
                raise ReadError(f"unknown schema {number}" if e.code == 404 else f"schema {number}: {e}") from e
            except (urllib.error.URLError, TimeoutError, ValueError, KeyError) as e:
                raise ReadError(f"schema {number}: {e}") from e
        return self.schemas[number]

    def __call__(self, number: int) -> Callable[[DataFrame], DataFrame]:
        from rivulet.codecs import protobuf

        proto = self.schema(number)
        return lambda df: protobuf.decode(df, proto, self.message)


def decode(df: DataFrame, resolve: Mapping[int, Callable[[DataFrame], DataFrame]] | Callable[[int], Callable[[DataFrame], DataFrame]], column: str = VALUE) -> DataFrame:
    """Decode each schema's payloads by its own decoder and put the rows together by name.

    resolve: from an id to a decoder of payload DataFrames. The ids that occur are found first; a batch has as many as its
    topic has versions. An HttpResolver's schemas are decoded in one pass, other decoders get the rows of their id each.
    """
    rows = unframe(df, column)
    ids = sorted(r["schema_id"] for r in rows.select("schema_id").distinct().collect())
    if ids and isinstance(resolve, HttpResolver):
        from rivulet.codecs import protobuf

        return protobuf.decode_by_id(rows, {number: resolve.schema(number) for number in ids}, resolve.message, column)
    out = None
    for number in ids:
        decoder = resolve(number) if callable(resolve) else resolve.get(number)
        if decoder is None:
            raise ReadError(f"unknown schema {number}")
        part = decoder(rows.where(F.col("schema_id") == number).drop("schema_id"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return rows.limit(0) if out is None else out
