"""WARC archives: writing, normalising monolithic gzip files to one member per record, and reading by offset.

`write_archives` writes records into archives that are one gzip stream each,
as careless tools do. `normalise` inflates such a stream once, rewrites every
record as a gzip member of its own and writes a sidecar index of offsets
beside it (one JSON line per record). `read_records` reads an archive back
through its index, member by member.

Archives are written by Spark tasks straight to the shared folder, under
a temporary name that is renamed when complete, so a repeated or speculative task
leaves one whole file. They are read with Spark's binary reader. An archive is
closed at ARCHIVE_BYTES of records, which bounds the memory of a task.

Defined results: null html is an empty payload, and empty payloads are equal; null
page ids are never the response of a group that has an id (without any, all are
responses); rows that repeat both id and payload are one page and all responses;
an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import portions, record, shared_dir

#: Parameters: bytes of records after which an archive is closed, and the least payload that is revisited.
ARCHIVE_BYTES = 32 << 20
MIN_REVISIT_BYTES = 0
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, url: str, kind: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has no payload; an extension field keeps the length of the payload it stands for."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", " ".join(url.split())), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields[4:4] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def split_records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records out of the running bytes of an archive, by their Content-Length."""
    buffer = bytearray()
    for piece in pieces:
        buffer += piece
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) >= 0:
            length = int(header(bytes(buffer[at:end]))["content-length"])
            if len(buffer) < end + 4 + length + 4:
                break
            yield bytes(buffer[at : end + 8 + length])
            at = end + 8 + length
        del buffer[:at]
    if buffer.strip():
        raise ValueError("the archive ends inside a record")


def header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The running content of a gzip file of one or more members."""
    at = 0
    while at < len(data):
        stream = zlib.decompressobj(31)
        while not stream.eof:
            out = stream.decompress(data[at : at + step])
            at += min(step, len(data) - at) - len(stream.unused_data)
            yield out
            if at >= len(data) and not stream.eof:
                raise ValueError("the gzip stream is cut short")


def put(uri: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder so that only a whole one is ever seen."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, f"{base}/{name}")


def get(uri: str, name: str) -> bytes:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{base}/{name}") as file:
        return file.read()


def with_roles(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with payload, digest, record type and what a revisit refers to; the largest page_id of equal payloads is the response."""
    data = F.col("html").cast("binary")
    page = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumns({"size": F.octet_length(data).cast("long"), "sha": F.unhex(F.sha2(data, 256))})
    first = page.select("size", "sha", "page_id").groupBy("size", "sha").agg(F.max("page_id").alias("first_id")).withColumnsRenamed({"size": "f_size", "sha": "f_sha"})
    joined = page.join(first, (F.col("size") == F.col("f_size")) & (F.col("sha") == F.col("f_sha")))
    revisit = (F.col("size") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", data.alias("payload"), "size", F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each partition's records into monolithic gzip archives; returns the archives' names and sizes.

    A partition's records come in one order however they arrive, so another attempt at a task cuts the same archives with the same
    bytes under the same names: what a lost attempt has left is replaced by its equal, and no page is lost or repeated.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, stream, out = None, 0, 0, None, bytearray()

        def close() -> pa.RecordBatch:
            name = f"part-{part:05d}-{n:05d}.warc.gz"
            data = bytes(out + stream.flush())
            put(folder, name, data)
            return record(name=[name], bytes=pa.array([len(data)], pa.int64()))

        for batch in portions(batches, "payload"):
            for part, page_id, url, payload, size, refers_to in zip(*(batch.column(c).to_pylist() for c in ("part", "page_id", "url", "payload", "size", "refers_to")), strict=True):  # noqa: B007
                if stream is None:
                    stream, out, held = zlib.compressobj(6, wbits=31), bytearray(), 0
                raw = make_record(page_id, url, "response" if refers_to is None else "revisit", payload, sha1_base32(payload), size, refers_to)
                out += stream.compress(raw)
                held += len(raw)
                if held > limit:
                    yield close()
                    stream, n = None, n + 1
        if stream is not None:
            yield close()

    ordered = records.withColumn("part", F.spark_partition_id()).sortWithinPartitions("page_id", "url", "size", F.xxhash64("payload"), "refers_to")
    return ordered.mapInArrow(write, "name string, bytes long")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")


def normalise(monolithic: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (path, content) with one gzip member per record, each with an index `name.idx` of offsets."""

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name, out, index = path.as_py().rpartition("/")[2], bytearray(), []
                for raw in split_records(inflated(content.as_py())):
                    packer = zlib.compressobj(6, wbits=31)
                    member = packer.compress(raw) + packer.flush()
                    fields = header(raw[: raw.index(b"\r\n\r\n")])
                    index.append(json.dumps({"offset": len(out), "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"]}))
                    out += member
                put(folder, name, bytes(out))
                put(folder, f"{name}.idx", "".join(f"{x}\n" for x in index).encode())
                yield record(name=[name], records=pa.array([len(index)], pa.int64()))

    return monolithic.mapInArrow(rewrite, "name string, records long")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of normalised archives, read member by member at the offsets of the index; payloads are checked."""
    def page(text: str) -> int | None:
        number = text.removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data, rows = memoryview(content.as_buffer()), []
                for entry in map(json.loads, get(folder, path.as_py().rpartition("/")[2] + ".idx").decode().splitlines()):
                    raw = zlib.decompress(data[entry["offset"] : entry["offset"] + entry["length"]], wbits=31)
                    end = raw.index(b"\r\n\r\n")
                    fields = header(raw[:end])
                    block = raw[end + 4 : end + 4 + int(fields["content-length"])]
                    payload, kind, digest = block[block.index(b"\r\n\r\n") + 4 :], fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (sha1_base32(payload) != digest or len(payload) != int(fields["warc-payload-length"])):
                        raise ValueError(f"damaged payload of {entry['id']}")
                    rows.append((page(fields["warc-record-id"]), int(fields["warc-payload-length"]), digest, kind, page(fields["warc-refers-to"]) if kind == "revisit" else None))
                c = list(zip(*rows, strict=True)) or [[]] * 5
                yield record(page_id=pa.array(c[0], pa.int64()), payload_bytes=pa.array(c[1], pa.int64()), payload_digest=pa.array(c[2], pa.string()), record_type=pa.array(c[3], pa.string()), refers_to=pa.array(c[4], pa.int64()))

    return archives(spark, folder).mapInArrow(read, READ)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back all pages; one row per page. Files stay in `folder` (a new one of the shared folder by default)."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = write_archives(with_roles(pages), f"{folder}/monolithic").agg(F.count("*").alias("n")).first()["n"]
    if not written:
        return spark.createDataFrame([], READ)
    normalise(archives(spark, f"{folder}/monolithic"), f"{folder}/records").agg(F.sum("records")).collect()
    return read_records(spark, f"{folder}/records")
