"""WARC archives compressed record by record with zstandard under a dictionary of their own.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, as it
is or itself compressed; then every record is one frame with its content size and checksum.
The reader finds the frames by their block headers, decodes one at a time, and checks the
record: version, header lines, Content-Length, the closing blank lines, block digest, and
for a response the payload's length and digest. Anything else raises :class:`WarcError`.

Pages with equal payloads become one response, that of the largest page_id, and revisits
which refer to it. Groups are found by the payload's SHA-256 through partial maxima and a
join that adaptive execution splits, so a payload that a third of all pages share is no one
task's load. A task streams its pages into one archive; a second attempt writes another
file, and the manifest names the file whose task succeeded.

Defined results: null html is an empty payload; a null page_id is written as empty and read
as null; rows that share the largest page_id of a payload are all responses; a null
URL has no WARC-Target-URI; control characters in a URL are percent-encoded; very long payloads are one record; an empty table
gives an empty manifest; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.sampling import bounded
from textloom.session import lean, ship
from textloom.sources.files import filesystem, make_dir, read_bytes, write_bytes

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1\r\n"
ID = "urn:textloom:page:"
#: The dictionary is fitted on at most so many pages (the least by hash) of at most so many bytes.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 500, 20_000, 1 << 16
LEVEL, READ_BYTES = 3, 1 << 20
#: A value of Spark has less than 2 GiB, so no record that was written is longer than this, only damaged headers say so.
MAX_RECORD = 1 << 32
#: Equal payloads of at least so many bytes are written once.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """The archive isn't sound."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary inside is compressed."""
    data = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return VERSION + "".join(x + "\r\n" for x in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def page_record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None) -> bytes:
    """A response, or a revisit where another page's record has the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Record-ID": f"<{ID}{'' if page_id is None else page_id}>", "WARC-Date": DATE, "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        headers["WARC-Target-URI"] = _uri(url)
    headers["WARC-Payload-Digest"] = f"sha1:{sha1_base32(payload)}"
    if response_id is None or response_id == page_id:
        return record("response", headers, http + payload)
    return record("revisit", headers | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{ID}{response_id}>"}, http)


class _Input:
    """A window over a stream that grows on demand."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.data, self.at = file, b"", 0

    def need(self, n: int) -> bool:
        """Whether n bytes stand at the current place."""
        while len(self.data) - self.at < n:
            more = self.file.read(max(READ_BYTES, n))
            if not more:
                return False
            self.data, self.at = self.data[self.at :] + more, 0
        return True

    def take(self, n: int, what: str) -> bytes:
        if not self.need(n):
            raise WarcError(f"cut off in {what}")
        self.at += n
        return self.data[self.at - n : self.at]

    def peek(self, start: int, n: int, what: str) -> bytes:
        if not self.need(start + n):
            raise WarcError(f"cut off in {what}")
        return self.data[self.at + start : self.at + start + n]


def _frame(source: _Input) -> bytes:
    """The bytes of the frame at the current place."""
    if source.peek(0, 4, "a frame's magic") != FRAME_MAGIC:
        raise WarcError("no zstandard frame where a record should begin")
    descriptor = source.peek(4, 1, "a frame header")[0]
    single = descriptor >> 5 & 1
    size = 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + (single, 2, 4, 8)[descriptor >> 6]
    while True:
        head = int.from_bytes(source.peek(size, 3, "a block header"), "little")
        kind = head >> 1 & 3
        if kind == 3:
            raise WarcError("reserved block type")
        size += 3 + (1 if kind == 1 else head >> 3)
        if head & 1:
            break
    return source.take(size + 4 * (descriptor >> 2 & 1), "a frame")


def parse(data: bytes) -> Record:
    """One decoded record, checked."""
    if not data.startswith(VERSION):
        raise WarcError("no WARC/1.1 record")
    head, sep, rest = data[len(VERSION) :].partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("headers without an end")
    headers: dict[str, str] = {}
    for line in head.decode("utf-8", "strict").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in headers:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise WarcError("Content-Length isn't a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n}, but the block has {len(rest) - 4} bytes")
    block = rest[:n]
    digest = headers.get("warc-block-digest")
    if digest is not None and digest != f"sha1:{sha1_base32(block)}":
        raise WarcError("the block's digest differs")
    return Record(headers, block)


def read_archive(file: BinaryIO) -> Iterator[Record]:
    """The records of one archive, one frame at a time."""
    source = _Input(file)
    magic, n = struct.unpack("<II", source.take(8, "the dictionary's frame"))
    if magic != DICTIONARY_MAGIC:
        raise WarcError("no dictionary frame at the start")
    dictionary = source.take(n, "the dictionary")
    try:
        if dictionary.startswith(FRAME_MAGIC):
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        while source.need(1):
            frame = _frame(source)
            size = zstandard.get_frame_parameters(frame).content_size
            if size > MAX_RECORD:
                raise WarcError("a record without a size, or over the limit")
            yield parse(unzip.decompress(frame))
    except zstandard.ZstdError as e:
        raise WarcError(f"zstandard: {e}") from e


def payload_of(found: Record) -> tuple[int, str, bytes | None]:
    """Length, digest and bytes of a record's payload (no bytes for a revisit), checked against each other."""
    head, sep, body = found.block.partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    digest = found.headers.get("warc-payload-digest", "")
    if not sep or not head.startswith(b"HTTP/") or len(lengths) != 1 or not lengths[0].isdigit() or not digest.startswith("sha1:"):
        raise WarcError("no HTTP response in the block")
    if found.headers["warc-type"] == "revisit":
        if body or "warc-refers-to" not in found.headers:
            raise WarcError("a revisit with a payload, or without what it refers to")
        return int(lengths[0]), digest[5:], None
    if int(lengths[0]) != len(body) or sha1_base32(body) != digest[5:]:
        raise WarcError("the payload's length or digest differs")
    return len(body), digest[5:], body


def _page_id(uri: str) -> int | None:
    if not uri.startswith(f"<{ID}") or not uri.endswith(">"):
        raise WarcError(f"unknown record id {uri[:80]!r}")
    return int(uri[len(ID) + 1 : -1]) if uri[len(ID) + 1 : -1] else None


MANIFEST = "file string, records long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` into archives in ``folder`` and return the manifest, which is a table in it."""
    spark = pages.sparkSession
    ship(spark)
    make_dir(folder)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    few = bounded(pages, "page_id", SAMPLE_PAGES).where(F.length("payload") <= SAMPLE_CHARS).limit(SAMPLE_PAGES).collect()
    samples = sorted(page_record(r["page_id"], r["url"], bytes(r["payload"]), None) for r in few)
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        dictionary = b""
    write_bytes(f"{folder}/dictionary", dictionary)

    pages = pages.withColumn("same", F.when(F.length("payload") >= min_revisit_bytes, F.sha2("payload", 256)))
    groups = pages.groupBy("same").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and same is not null")
    named = pages.join(groups.select("same", "response_id"), "same", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, name, zip_ = None, 0, "", None
        for batch in batches:
            if out is None:
                name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                fs, path = filesystem(name)
                data = read_bytes(f"{folder}/dictionary")
                out, zip_ = fs.open_output_stream(path), zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None, write_checksum=True)
                out.write(dictionary_frame(data))
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "response_id")), strict=True):
                out.write(zip_.compress(page_record(*row)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    named.select("page_id", "url", "payload", "response_id").mapInArrow(lean(run), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives that the manifest names; the payload, if asked for, is null for revisits."""
    ship(spark)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * with_payload]
    result = RESULT + ", payload binary" * with_payload
    names = [x.split()[0] for x in result.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name, records in zip(*(batch.column(c).to_pylist() for c in ("file", "records")), strict=True):
                fs, path = filesystem(name)
                rows, n = [], 0
                with fs.open_input_stream(path) as file:
                    for found in read_archive(file):
                        h, (size, digest, payload) = found.headers, payload_of(found)
                        other = _page_id(h["warc-refers-to"]) if h["warc-type"] == "revisit" else None
                        rows.append((_page_id(h["warc-record-id"]), size, digest, h["warc-type"], other, h.get("warc-target-uri"), *[payload] * with_payload))
                        n += 1
                        if len(rows) == 500:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)
                if n != records:
                    raise WarcError(f"{name}: {n} records, the manifest has {records}")

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return files.repartition(max(1, files.count())).mapInArrow(lean(run), result)


def oracle(min_revisit_bytes: int = MIN_REVISIT_BYTES) -> str:
    """DuckDB SQL for what the archives of ``pages`` say; each 20 bits of the SHA-1 give four base32 characters."""
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h, sha256(b) AS s FROM p),
m AS (SELECT *, CASE WHEN n >= {min_revisit_bytes} THEN max(page_id) OVER (PARTITION BY s) ELSE page_id END AS response FROM d)
SELECT page_id, n AS payload_bytes,
  list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> ((3 - i % 4) * 5)::BIGINT) & 31) + 1, 1) for i in range(0, 32)], lambda x, y: x || y) AS payload_digest,
  CASE WHEN response IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM m"""
