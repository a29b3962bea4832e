"""WARC archives: writing, normalising monolithic gzip, a sidecar offset index, and reading back.

``write_monolithic`` writes records as archives that are one gzip stream each, as some crawlers leave
them. ``normalise`` inflates each stream once and writes every record as a gzip member of its own, so
that a record can be read alone, with an index of (shard, offset, length) beside it. ``read_records`` reads
normalised archives whole and holds them against their index, ``fetch`` single records by the index.

All files go through Spark's own readers and writers, so they can lie in any store that Spark reaches,
and a task that runs again leaves no half-written file. The text writer ends each row with a separator;
here that is the byte 0, which is the last byte of a gzip member of less than 16 MiB. A longer one is
followed by an empty member. What is written is exactly the stream of members. Spark names the files
``part-<shard>-...``; the shard is the number in the index. Records and index must agree both ways, or
reading fails: no record is lost silently.

Defined cases: null html counts as empty; records of equal payload refer to the one with the largest
page_id; rows that repeat it are responses too, and rows with a null page_id refer to it; a group of
null page_ids only has responses; a null url becomes ``urn:page:<id>``; an empty table gives empty
archives; extra columns are left alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folder_exists, remove_folder, shared_folder, small_batches

LEVEL = 4
#: Uncompressed bytes after which a monolithic archive ends.
ROLL = 8 << 20
STEP = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_origins(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, packed, refers_to): refers_to is null for what becomes a response.

    Payloads are shuffled once, to meet what they refer to, and packed before.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    page_id = F.col("page_id").cast("long").alias("page_id")
    rows = pages.select(page_id, F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array([zlib.compress(x.as_buffer(), 1) for x in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], ["page_id", "url", "digest", "packed"])

    rows = rows.mapInArrow(pack, "page_id long, url string, digest string, packed binary")
    known = pages.select(page_id, F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    origins = known.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("origin"), F.count("*").alias("n"))
    revisits = (
        known.join(origins.filter("n > 1 and origin is not null"), "digest")
        .filter("page_id is null or page_id != origin")
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("origin").alias("refers_to"))
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    return rows.join(revisits, same, "left").select("page_id", "url", "packed", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed WARC record."""
    name = "" if page_id is None else str(page_id)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{name}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    block = HTTP % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(rec: bytes) -> tuple[dict[str, str], int]:
    """The headers of a record, and where its block begins."""
    end = rec.index(b"\r\n\r\n")
    lines = rec[:end].decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def parse(rec: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, refers_to) of a record; a response's payload is measured anew."""
    head, at = headers_of(rec)
    number = lambda x: int(m[1]) if (m := re.search(r"page:(-?\d+)>", x or "")) else None
    size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response":
        block = rec[at : at + int(head["content-length"])]
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if (len(payload), payload_digest(payload)) != (size, digest):
            raise ValueError(f"the payload of {head['warc-record-id']} doesn't match its digest")
    return number(head["warc-record-id"]), size, digest, head["warc-type"], number(head.get("warc-refers-to"))


def deflate(data: bytes) -> bytes:
    """A gzip member that ends with the byte 0."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out.endswith(b"\0") else out + EMPTY_MEMBER


def inflate(content: bytes) -> Iterator[tuple[int, bytes]]:
    """The members of a gzip file in pieces: (file offset behind the piece's input if a member ends there, else 0; bytes)."""
    view, at = memoryview(content), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a gzip member")
            fed = view[at : at + STEP]
            piece = z.decompress(fed)
            at += len(fed) - len(z.unused_data)
            yield (at if z.eof else 0), piece


def split_records(pieces: Iterator[tuple[int, bytes]]) -> Iterator[bytes]:
    """The records of a stream, however it is cut into pieces; it holds one record at a time."""
    buffer = bytearray()
    need = 0
    for _, piece in pieces:
        buffer += piece
        while True:
            if not need:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", bytes(buffer[:end]))[1]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = 0
    if buffer:
        raise ValueError("the archive ends within a record")


def _write(rows: DataFrame, column: str, folder: str, by: list[str] | None = None, **options: str) -> None:
    """The binary column, row after row; each value must end with the byte 0, which the writer puts there."""
    cut_off = F.expr(f"substring({column}, 1, octet_length({column}) - 1)").cast("string")
    rows.select(*(by or []), cut_off.alias("value")).write.options(lineSep="\0", **options).partitionBy(*(by or [])).mode("overwrite").text(folder)


def write_monolithic(pages: DataFrame, folder: str, roll: int = ROLL) -> None:
    """Write ``pages(page_id, url, packed, refers_to)`` as archives of one gzip stream each."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, size, out = None, 0, []
        for b in batches:
            for page_id, url, packed, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                z = z or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                rec = record(page_id, url, zlib.decompress(packed), refers_to)
                size += len(rec)
                out.append(z.compress(rec))
                if size >= roll:
                    yield one(out, z)
                    z, size, out = None, 0, []
        if z:
            yield one(out, z)

    def one(out: list[bytes], z) -> pa.RecordBatch:
        data = b"".join([*out, z.flush()])
        return pa.RecordBatch.from_arrays([pa.array([data if data.endswith(b"\0") else data + EMPTY_MEMBER], pa.binary())], ["archive"])

    _write(pages.mapInArrow(run, "archive binary"), "archive", folder, maxRecordsPerFile="1")


INDEX = "shard int, offset long, length long, record_id string, record_type string"
RECORD = "shard int, offset long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
_MEMBERS, _SIDECAR = "sidecar=0", "sidecar=1"


def normalise(spark: SparkSession, source: str, folder: str) -> None:
    """Rewrite the archives in ``source`` record by record, and write the offset index beside them, in one pass.

    Members go to ``folder``/sidecar=0 and the index to ``folder``/sidecar=1; both are committed together. A task
    writes one file of each, part-<shard>, whatever number of records a file may have elsewhere in the session.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, rows, held = 0, [], 0
        types = (pa.int32(), pa.int64(), pa.binary())
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["sidecar", "place", "value"])
        for b in batches:
            for content in b.column(0):
                for rec in split_records(inflate(content.as_buffer())):
                    head, _ = headers_of(rec)
                    member = deflate(rec)
                    name = re.sub(r"[\x00\t]", " ", head["warc-record-id"])
                    rows.append((0, offset, member))
                    rows.append((1, offset, f"{offset}\t{len(member)}\t{name}\t{head['warc-type']}\0".encode()))
                    offset += len(member)
                    held += len(member)
                    if held > 4 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    files = spark.read.format("binaryFile").load(source).select("content")
    written = files.mapInArrow(run, "sidecar int, place long, value binary").sortWithinPartitions("sidecar", "place")
    _write(written, "value", folder, ["sidecar"], maxRecordsPerFile="0")


def _shard() -> Column:
    return F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("shard")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of a normalised folder: shard, offset, length, record_id, record_type."""
    if not folder_exists(spark, f"{folder}/{_SIDECAR}"):  # nothing was written
        return spark.createDataFrame([], INDEX)
    lines = spark.read.option("lineSep", "\0").text(f"{folder}/{_SIDECAR}").select(_shard(), F.split("value", "\t").alias("x"))
    fields = [f.split() for f in INDEX.split(", ")[1:]]
    return lines.select("shard", *[F.col("x")[k].cast(kind).alias(name) for k, (name, kind) in enumerate(fields)])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    if not folder_exists(spark, f"{folder}/{_MEMBERS}"):
        return spark.createDataFrame([], "shard int, content binary")
    return spark.read.format("binaryFile").load(f"{folder}/{_MEMBERS}").select(_shard(), "content")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of a normalised folder. A record that the index doesn't name, or names elsewhere, is an error."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, start, parts = [], 0, []
                for end, piece in inflate(content.as_buffer()):
                    parts.append(piece)
                    if end:
                        if rec := b"".join(parts):
                            rows.append((shard, start, end - start, *parse(rec)))
                        elif rows:  # an empty member belongs to the one before it
                            rows[-1] = (shard, rows[-1][1], end - rows[-1][1], *rows[-1][3:])
                        start, parts = end, []
                if rows:
                    yield _batch(rows)

    found = _files(spark, folder).mapInArrow(run, RECORD)
    index = read_index(spark, folder).select("shard", "offset", "length", F.col("record_type").alias("kind"))
    both = found.join(index, ["shard", "offset", "length"], "full_outer")
    agreed = F.when(F.col("kind") == F.col("record_type"), F.col("record_type")).otherwise(F.raise_error(F.lit("the index and the archives of a normalised folder don't agree")))
    return both.withColumn("record_type", agreed).select([f.split()[0] for f in RECORD.split(", ")])


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records that ``wanted(record_id)`` names, cut out of the archives at the places that the index gives.

    Nothing else is inflated. The places of a shard are brought together with its file, so this is for looking
    records up; ``read_records`` reads them all without moving archives.
    """
    small_batches(spark)
    named = read_index(spark, folder).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    places = named.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                yield _batch([(shard, x["offset"], x["length"], *parse(gzip.decompress(view[x["offset"] : x["offset"] + x["length"]]))) for x in places])

    return _files(spark, folder).join(places, "shard").select("shard", "content", "places").mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages, normalise the archives and read them back: one row per page.

    The monolithic archives are removed when their normal form is committed; that one stays in the shared folder,
    as the rows are read from it.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_monolithic(with_origins(pages, least_bytes), f"{folder}/raw")
    normalise(spark, f"{folder}/raw", f"{folder}/normal")
    remove_folder(spark, f"{folder}/raw")  # the normal form is committed
    return read_records(spark, f"{folder}/normal").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
