"""WARC archives: a writer with revisit records and a splittable reader.

Writing: every attempt of a task writes one ``.warc.gz`` file, a gzip member for each record, under a name of its own; nothing is renamed
or replaced. Spark commits one attempt's row of each task to a manifest (file, length, records), and the reader takes the files that it
names, so what a lost or doubled attempt leaves behind is never read. Of records with equal payloads of at least
``min_bytes`` bytes the one with the largest id is a response; the others are revisits that name it and carry no payload. If
several rows have that id and payload, each of them is a response.

Reading: a table of byte ranges is made from the files' lengths and dealt to a bounded number of tasks, each with many ranges when there
is much to read. In each a task looks for gzip magic, takes a place for a
member only if it decodes to the beginning of a WARC record, and owns the records whose members start in its range; it reads
on past the range's end to finish the last one.

Null html counts as empty, a null url is left out of the record, a null id stays null. An empty table gives no archive and
an empty result. Very long payloads are held one at a time. Columns of pages beside page_id, url and html are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, staged

RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 18
#: Written by write(); archives from elsewhere have none, and all files of the folder are read.
MANIFEST, MANIFEST_COLUMNS = "manifest", "file string, length long, records long"
#: Reading tasks for each of the cluster's cores, at most.
TASKS_A_CORE = 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest32(sha1_hex)}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with sha1 (hex) and refers_to: null for a response."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"))
    narrow = base.where(F.octet_length("html") >= min_bytes).select("page_id", "sha1")
    many = narrow.groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1").select("sha1", "last")
    joined = base.join(staged(many, "revisits"), "sha1", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).drop("last")


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> int:
    """Write pages as archives into a folder; the number of records."""
    small_batches(pages.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path)
        own, out, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{own}", compression=None)
                out.write(gzip_member(record(page_id, url, html.encode(), sha1, refers_to)))
                n += 1
        if out is not None:
            out.close()
            length = fs.get_file_info(f"{root}/{own}").size
            yield pa.RecordBatch.from_pydict({"file": pa.array([own]), "length": pa.array([length], pa.int64()), "records": pa.array([n], pa.int64())})

    rows = decided(pages, min_bytes).select("page_id", "url", "html", "sha1", "refers_to")
    rows.mapInArrow(run, MANIFEST_COLUMNS).write.parquet(f"{path}/{MANIFEST}")
    return pages.sparkSession.read.schema(MANIFEST_COLUMNS).parquet(f"{path}/{MANIFEST}").agg(F.sum("records")).first()[0] or 0


def opened(uri: str):
    """A file system and a path in it that tasks open without Spark."""
    return pa.fs.FileSystem.from_uri(f"s3://{uri[6:]}" if uri.startswith("s3a://") else uri)


class _File:
    """Random access with one block in memory."""

    def __init__(self, stream, length: int):
        self.stream, self.length, self.at, self.block = stream, length, 0, b""

    def read(self, start: int) -> bytes:
        """Some bytes from start on; none at the end."""
        if not self.at <= start < self.at + len(self.block):
            self.stream.seek(start)
            self.at, self.block = start, self.stream.read(READ_BYTES)
        return self.block[start - self.at :]

    def find(self, start: int, stop: int) -> int:
        """The next place in [start, stop) where gzip magic begins, or -1."""
        while start < stop:
            block = self.read(start)
            if len(block) < len(MAGIC) and start + len(block) < self.length:
                self.stream.seek(start)
                self.at, self.block = start, self.stream.read(READ_BYTES)
                block = self.block
            k = block.find(MAGIC)
            if k >= 0:
                return start + k if start + k < stop else -1
            if start + len(block) >= self.length:
                return -1
            start += max(1, len(block) - len(MAGIC) + 1)
        return -1

    def member(self, start: int) -> tuple[bytes, int] | None:
        """The decoded member at start and where it ends; None if no WARC record begins there."""
        z, out, at, known = zlib.decompressobj(31), io.BytesIO(), start, False
        while not z.eof:
            block = self.read(at)
            if not block:
                if known:
                    raise ValueError(f"a record that starts at {start} is cut short")
                return None
            try:
                out.write(z.decompress(block if known else block[:512]))
            except zlib.error:
                if known:
                    raise
                return None
            at += len(block) if known else min(512, len(block))
            if not known and out.tell() >= 7:
                if not out.getvalue().startswith(b"WARC/1."):
                    return None
                known = True
        return (out.getvalue(), at - len(z.unused_data)) if known else None


def parse(data: bytes) -> dict:
    """A record's headers, lower-cased names, with http (bytes before the payload) and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(found["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return found | {"http": http, "payload": payload}


def _id(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None


def records(stream, length: int, start: int, stop: int) -> Iterator[dict]:
    """The records whose members start in [start, stop) of a file."""
    f, at = _File(stream, length), start
    while (at := f.find(at, stop)) >= 0:
        got = f.member(at)
        if got is None:
            at += 1
            continue
        data, at = got
        yield parse(data)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """The records of a folder of archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if asked for,
    payload (null in a revisit). A response's digest is computed from its payload and held against its header."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()))] + [T.StructField("payload", T.BinaryType())] * payload)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, MANIFEST)):
        files = spark.read.schema(MANIFEST_COLUMNS).parquet(f"{path}/{MANIFEST}").select(F.concat(F.lit(path.rstrip("/") + "/"), "file").alias("path"), "length")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, start in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = opened(file)
                rows, held = [], 0
                with fs.open_input_file(name) as stream:
                    for r in records(stream, length, start, start + range_bytes):
                        body, digest = r["payload"], r["warc-payload-digest"].removeprefix("sha1:")
                        if r["warc-type"] == "response":
                            if digest != base64.b32encode(hashlib.sha1(body).digest()).decode():
                                raise ValueError(f"a payload of {file} does not match its digest")
                            size = len(body)
                        else:
                            size = next(int(x.split(b":")[1]) for x in r["http"].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        row = (_id(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], _id(r.get("warc-refers-to")), size, digest)
                        rows.append(row + ((body if r["warc-type"] == "response" else None,) if payload else ()))
                        held += len(body) if payload else 100
                        if held > 1 << 24 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    tasks = min(ranges.count(), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return ranges.repartition(max(1, tasks)).mapInArrow(run, schema)
