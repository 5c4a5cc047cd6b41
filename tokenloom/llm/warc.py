"""Dictionary-compressed web archives.

A Zstandard dictionary is trained on a bounded sample of the records. Every archive opens with a
skippable frame that holds the dictionary; each record behind it is a frame of its own, compressed
with that dictionary. Records with equal payloads are stored once: one is the response, the others
revisit it.

Archives are written by Spark's text writer, one row and one file each, so that the commit protocol
and any file system Spark knows are kept. What the writer puts behind a row is an empty skippable
frame, which every decoder passes over.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import bounded_sample, ship_package

#: Fixed values of the archive format.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICT_BYTES = 110 << 10
SAMPLE_ROWS = 512  # records the dictionary is trained on, about
SAMPLE_BYTES = 16 << 10  # of one such record, at most
ARCHIVE_BYTES = 16 << 20  # an archive ends when it is larger
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan_records(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``refers_to`` of every row.

    The payload is the text in UTF-8, empty for null. Of rows with equal payloads of at least
    ``min_bytes`` the largest id is the response and the others refer to it. Null ids are the smallest
    and all null ones of a payload without another id are responses; rows that repeat the largest id
    are all responses, as no record revisits its own id. The payloads move once; which of them are
    equal is found on their digests.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256))
    shared = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("key")
    largest = shared.agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top")
    refers = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return keyed.join(largest, "key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def train_dictionary(records: DataFrame) -> bytes:
    """A dictionary from a sample of records; empty if there are too few to train on."""
    import zstandard

    cut = records.withColumn("payload", F.substring("payload", 1, SAMPLE_BYTES))
    sample = bounded_sample(cut, [F.col("page_id"), F.col("url")], SAMPLE_ROWS).orderBy("page_id", "url", "payload")
    parts = [_record(r.page_id, r.url, bytes(r.payload), None, 0) for r in sample.collect()]
    try:
        size = min(DICT_BYTES, max(256, sum(map(len, parts)) // 10))
        return zstandard.train_dictionary(size, parts, k=256, d=8).as_bytes() if len(parts) >= 8 else b""
    except zstandard.ZstdError:  # the library refuses samples that have nothing in common
        return b""


def write_archives(records: DataFrame, path: str, dictionary: bytes | None = None) -> None:
    """Write planned records to archives in the new folder ``path``. An empty table gives no archive."""
    spark = records.sparkSession
    ship_package(spark)
    dictionary = train_dictionary(records) if dictionary is None else dictionary
    archives = records.select("page_id", "url", "payload", "refers_to").mapInArrow(functools.partial(_archives, dictionary), "archive binary")
    # A binary value keeps its bytes when it is cast to string.
    as_text = archives.select(F.col("archive").cast("string").alias("value"))
    as_text.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def _archives(dictionary: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    held = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **held).compress
    head = DICTIONARY_MAGIC + struct.pack("<I", len(dictionary)) + dictionary
    head += compress(_frame_of(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n", "info"))
    parts, size, count = [], 0, 0
    for batch in batches:
        for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
            parts.append(compress(_record(page, url, payload, refers, count)))
            size += len(parts[-1])
            count += 1
            if size > ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join([head, *parts])], pa.binary())], names=["archive"])
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join([head, *parts])], pa.binary())], names=["archive"])


def _frame_of(fields: list[str], block: bytes, seed: str) -> bytes:
    h = hashlib.sha256(seed.encode("utf-8", "surrogatepass")).hexdigest()
    identity = f"WARC-Record-ID: <urn:uuid:{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:32]}>"
    lines = ["WARC/1.1", *fields, identity, f"WARC-Date: {DATE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record(page: int | None, url: str | None, payload: bytes, refers: int | None, number: int) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if url is not None:
        fields.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~')}")
    if page is not None:
        fields.append(f"X-Page-ID: {page}")
    if refers is not None:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers}"]
    return _frame_of(fields, http if refers is not None else http + payload, f"{page} {url} {digest} {refers} {number}")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """``page_id``, ``url``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to`` and
    ``payload`` (null for a revisit, and if not asked for) of every record of the archives.

    A response's size and digest are taken from its payload, and one that differs from its header
    raises an error.
    """
    ship_package(spark)
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    if not _any_file(spark, path):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(functools.partial(_read, with_payload), schema)


def _any_file(spark: SparkSession, path: str) -> bool:
    return bool(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").head(1))


def _read(with_payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    for batch in batches:
        for archive in batch.column(0):
            rows = []
            for row in records_of(archive.as_buffer()):
                rows.append(row if with_payload else (*row[:-1], None))
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def records_of(archive) -> Iterator[tuple]:
    """The response and revisit records of one archive."""
    import zstandard

    archive = memoryview(archive)
    if bytes(archive[:4]) != DICTIONARY_MAGIC:
        raise ValueError("an archive opens with its dictionary")
    size = struct.unpack("<I", archive[4:8])[0]
    held = {"dict_data": zstandard.ZstdCompressionDict(bytes(archive[8 : 8 + size]))} if size else {}
    source = zstandard.ZstdDecompressor(**held).stream_reader(archive[8 + size :], read_across_frames=True)
    held_back = b""

    def upto(mark: bytes) -> bytes | None:
        nonlocal held_back
        at = held_back.find(mark)
        while at < 0:
            more = source.read(1 << 16)
            if not more:
                if held_back:
                    raise ValueError("an archive ends inside a record")
                return None
            seen = max(0, len(held_back) - len(mark))
            held_back += more
            at = held_back.find(mark, seen)
        found, held_back = held_back[:at], held_back[at + len(mark) :]
        return found

    def exactly(n: int) -> bytes:
        nonlocal held_back
        parts, have = [held_back], len(held_back)
        while have < n:
            more = source.read(max(1 << 16, n - have))
            if not more:
                raise ValueError("an archive ends inside a record")
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        held_back = whole[n:]
        return whole[:n]

    while (head := upto(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        block = exactly(int(fields["Content-Length"]) + 4)[:-4]
        kind = fields["WARC-Type"]
        if kind not in ("response", "revisit"):
            continue
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Bytes"])
        payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
        if payload is not None and (len(payload) != size or base32_sha1(payload) != digest):
            raise ValueError("a payload differs from its digest")
        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
        yield (
            None if page is None else int(page), fields.get("WARC-Target-URI"), kind, size, digest,
            None if refers is None else int(refers), payload,
        )
