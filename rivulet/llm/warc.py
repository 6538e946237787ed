"""WARC writing and reading over a chunked record table.

Oversized payloads are rows of (record, chunk number, at most chunk_bytes of payload) from the scan on: such rows are what is
shuffled, written and read, with a digest that grows from chunk to chunk, so nothing beyond the input row holds a whole record.
Which record is a response is decided on digests alone, before any payload moves. Archives are gzip members, one a record, in
files that a manifest lists. The manifest is written by Spark's committer, so the files of failed or repeated attempts are
never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import limit_batches, maybe_in, utf8, work_path, written

#: Payload bytes of a chunk row, compressed bytes read at once, and compressed bytes after which a new archive is begun.
CHUNK, READ, ROLL = 1 << 20, 1 << 18, 1 << 30
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("7d5a3a0e-3f0b-5c43-9a35-0d1c5f2b9e11")
MANIFEST = "archive string, records long, bytes long"
CHUNKS = "archive string, record_id string, record_type string, page_id string, refers_to string, uri string, payload_bytes long, payload_digest string, chunk long, data binary, so_far long, digest_so_far string, last boolean"


def base32_sha1(h: "hashlib._Hash") -> str:
    return base64.b32encode(h.digest()).decode()


def record_id(page: str, proof: str, row: int | None = None) -> str:
    """Of a response that revisits refer to: of its page and payload; of others: also of its row."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}/{proof}' if row is None else f'{page}/{proof}/{row}')}>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; URIs of any store pyarrow knows, or plain paths."""
    return fs.FileSystem.from_uri(path)


class Archive:
    """One file of gzip members; a record is begun, gets pieces, which are compressed as they come, and is ended."""

    def __init__(self, path: str):
        store, name = opened(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.out, self.records, self.bytes, self.z = path, store.open_output_stream(name, compression=None), 0, 0, None

    def begin(self) -> None:
        self.z = zlib.compressobj(1, zlib.DEFLATED, 31)

    def piece(self, data: bytes | memoryview) -> None:
        self._put(self.z.compress(data))

    def end(self) -> None:
        self._put(self.z.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def line(text: str | None) -> str:
    """A header's value on one line."""
    return "" if text is None else "".join(c if c >= " " else f"%{ord(c):02X}" for c in text)


def head_of(page: str | None, uri: str | None, row: int, proof: str, size: int, sha: str, keeper: str | None, several: bool) -> tuple[bytes, bool]:
    """A record's head, and whether it is a response. keeper: the page that its group's revisits refer to, if it has a group;
    several: more than one record of the keeper's page has the payload, so that none can be referred to by its identifier."""
    response = keeper is None or page == keeper
    name = "null" if page is None else page
    own = record_id(name, proof, None if response and keeper is not None and not several else row)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", "Content-Type: application/octet-stream",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}", f"Content-Length: {size if response else 0}", f"X-Payload-Length: {size}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {line(page)}")
    if uri is not None:
        head.append(f"WARC-Target-URI: {line(uri)}")
    if not response:
        head += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page-ID: {line(keeper)}"]
        if not several:
            head.append(f"WARC-Refers-To: {record_id(keeper, proof)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode(), response


def keepers_of(marks: DataFrame, least_revisit: int) -> DataFrame:
    """proof, bytes, keeper (the largest page), several: for payloads that several records have. marks: page, proof, bytes."""
    by_page = marks.where(F.col("bytes") >= least_revisit).groupBy("proof", "bytes", "page").agg(F.count(F.lit(1)).alias("n"))
    groups = by_page.groupBy("proof", "bytes").agg(F.max(F.struct("page", "n")).alias("last"), F.sum("n").alias("copies")).where("copies > 1 AND last.page IS NOT NULL")
    return groups.select("proof", "bytes", F.col("last.page").cast("string").alias("keeper"), (F.col("last.n") > 1).alias("several"))


def write_archives(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, least_revisit: int, chunk_bytes: int) -> DataFrame:
    """Write pages as WARC records; the manifest, read back."""
    spark = pages.sparkSession
    limit_batches(spark)
    payload = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("uri"), utf8(payload_col).alias("payload"))
    rows = payload.withColumns({"row": F.monotonically_increasing_id(), "proof": F.sha2("payload", 256), "sha": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    marks = written(rows.select("page", "proof", "bytes"), "warc-marks")
    # written, so that the joins have an exchange of their own on this side and Spark can split a common payload's partition
    keepers = written(keepers_of(marks, least_revisit), "warc-keepers")
    maybe = maybe_in(keepers.select(F.xxhash64("proof").alias("h")), "h", keepers.count(), pages)
    same = [F.col("page").cast("string").alias("page"), "uri", "row", "proof", "bytes", "sha", "keeper", "several"]
    response = F.col("keeper").isNull() | F.col("page").cast("string").eqNullSafe(F.col("keeper"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, archive, done, left, sha = TaskContext.get(), None, [], 0, None
        for batch in batches:
            pieces = batch.column(9)
            for k, (page, uri, row, proof, size, digest, keeper, several, chunk) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(9)))):
                if chunk == 0:
                    if archive is None or archive.bytes > ROLL:
                        if archive:
                            done.append(archive.close())
                        archive = Archive(f"{folder}/archives/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc.gz")
                    head, whole = head_of(page, uri, row, proof, size, digest, keeper, several)
                    archive.begin()
                    archive.piece(head)
                    left, sha = size if whole else 0, hashlib.sha1()
                if left:
                    piece = memoryview(pieces[k].as_buffer())
                    sha.update(piece)
                    archive.piece(piece)
                    left -= len(piece)
                    if not left and sha.hexdigest() != digest:
                        raise ValueError(f"the chunks of page {page} aren't its payload")
                if not left:
                    archive.piece(b"\r\n\r\n")
                    archive.end()
        if left:
            raise ValueError("the last record's chunks aren't all there")
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done]) for c in range(3)], names=["archive", "records", "bytes"])

    def judged(some: DataFrame) -> DataFrame:
        """With keeper and several. Payloads that a filter of the common ones leaves out don't go through the join."""
        if maybe is None:
            return some.join(keepers, ["proof", "bytes"], "left")
        known = maybe(F.xxhash64("proof"))
        alone = some.where(~known).withColumns({"keeper": F.lit(None).cast("string"), "several": F.lit(None).cast("boolean")})
        return some.where(known).join(keepers, ["proof", "bytes"], "left").unionByName(alone)

    # a record of one chunk is a row; those of several are chunk rows, which are brought together by record
    one = judged(rows.where(F.col("bytes") <= chunk_bytes))
    manifest = one.select(*same, F.lit(0).alias("chunk"), F.when(response, F.col("payload")).otherwise(F.lit(b"")).alias("piece")).mapInArrow(write, MANIFEST)
    if (marks.agg(F.max("bytes")).first()[0] or 0) > chunk_bytes:
        long = rows.where(F.col("bytes") > chunk_bytes).withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.col("bytes") - 1) / chunk_bytes).cast("int"))))
        long = judged(long.withColumn("payload", F.expr(f"substring(payload, chunk * {chunk_bytes} + 1, {chunk_bytes})")))
        long = long.where((F.col("chunk") == 0) | response).select(*same, "chunk", F.col("payload").alias("piece"))
        manifest = manifest.union(long.repartition("row", "proof").sortWithinPartitions("row", "proof", "chunk").mapInArrow(write, MANIFEST))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Reader:
    """The uncompressed bytes of an archive (gzip members or plain), a bounded piece at a time."""

    def __init__(self, path: str):
        store, name = opened(path)
        self.source, self.z, self.held, self.plain = store.open_input_stream(name, compression=None), None, b"", None

    def more(self) -> bool:
        """Get further bytes; False at the end."""
        while True:
            data = self.z.unused_data if self.z is not None and self.z.eof else b""
            if self.z is not None and not self.z.eof and self.z.unconsumed_tail:
                data = self.z.unconsumed_tail
            data = data or self.source.read(READ)
            if not data:
                if self.z is not None and not self.z.eof:
                    raise EOFError("an archive ends inside a record")
                return False
            if self.plain is None:
                self.plain = bytes(data[:2]) != b"\x1f\x8b"
            if self.plain:
                self.held += data
                return True
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data, READ * 4)
            if out:
                self.held += out
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """Bytes up to and with the mark; None at the end of the archive."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > most:
                raise ValueError("a record's head is too long")
            if not self.more():
                if self.held.strip():
                    raise EOFError("an archive ends inside a record")
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def pieces(self, size: int, chunk: int) -> Iterator[bytes]:
        """The next `size` bytes in pieces of `chunk` bytes, the last one shorter."""
        while size:
            want = min(size, chunk)
            while len(self.held) < want:
                if not self.more():
                    raise EOFError("an archive ends inside a record")
            out, self.held = self.held[:want], self.held[want:]
            size -= want
            yield out


def read_chunks(path: str, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of one archive. A record without payload has one empty chunk."""
    reader = Reader(path)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        lines = head.decode().strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, sha, so_far, number = int(h["content-length"]), hashlib.sha1(), 0, 0
        same = {
            "archive": path, "record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "page_id": h.get("x-page-id"), "refers_to": h.get("x-refers-to-page-id"), "uri": h.get("warc-target-uri"),
            "payload_bytes": int(h.get("x-payload-length", size)), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        }
        for piece in reader.pieces(size, chunk_bytes) if size else iter([b""]):
            sha.update(piece)
            so_far += len(piece)
            yield same | {"chunk": number, "data": piece, "so_far": so_far, "digest_so_far": base32_sha1(sha), "last": so_far == size}
            number += 1
        if same["record_type"] == "response" and same["payload_digest"] not in (None, base32_sha1(sha)):
            raise ValueError(f"{same['record_id']}: the payload doesn't match its digest")
        if reader.until(b"\r\n\r\n") is None:
            raise EOFError("an archive ends inside a record")


def read_archives(spark: SparkSession, manifest: DataFrame, chunk_bytes: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives that the manifest lists. payloads: keep the chunks' bytes, else null."""
    kinds = {"payload_bytes": pa.int64(), "chunk": pa.int64(), "so_far": pa.int64(), "data": pa.binary(), "last": pa.bool_()}
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in read_chunks(path, chunk_bytes):
                    rows.append(row if payloads else row | {"data": None})
                    held += len(row["data"]) if payloads else 64
                    if held >= 4 * chunk_bytes or len(rows) >= 5000:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    limit_batches(spark)
    return manifest.select("archive").repartition(max(1, min(manifest.count(), 20_000))).mapInArrow(read, CHUNKS)


def warc_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write one record per row, read the archives back, and return per row: id_col, payload_bytes, payload_digest, record_type, refers_to, uri.

    Of rows with equal payloads of at least `least_revisit` bytes the largest id's is the response, the others revisit it.
    A null payload is empty; empty payloads are equal to each other. Null ids revisit a non-null one if there is any; groups of
    null ids only are all responses, and so are rows that repeat the largest id with the same payload (their revisits name the
    page, but no record identifier). Equality is that of SHA-256 and length. Null URLs give records without target. Payloads of
    over chunk_bytes are cut at the scan. folder: where archives and manifest go (shared; default a new one).
    """
    spark = pages.sparkSession
    manifest = write_archives(pages, folder or work_path(spark, "warc"), id_col, url_col, payload_col, least_revisit, chunk_bytes)
    kind = pages.schema[id_col].dataType
    ends = read_archives(spark, manifest, chunk_bytes, payloads=False).where("last")
    return ends.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "uri")
