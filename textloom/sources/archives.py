"""WARC and WET archives as a Spark data source, read and written: ``spark.read.format("warc_records")``.

Reading: a file is cut at every ``split_bytes``; a task reads the gzip members that begin in its part, to their ends, so a file of many
members is many tasks' and a file of one member is one task's, which streams it. Members are inflated in small pieces; only one record's body is
held, and none where its type isn't asked for or no column needs it. A schema with fewer columns reads only these; filters on ``type`` are
pushed down. Files that aren't compressed are walked from record to record by one task.

A part's first member is found by its magic bytes and by inflating to ``WARC/``; members must follow each other without a gap up to the
part's end, so bytes inside a body that only look like a member end in an error and never in wrong rows (``split_bytes`` 0 reads whole files).

Writing: each task writes files of a warcinfo record and one member a row under names of its own; they count when the
commit names them in the folder's manifest, which is written last. What failed attempts leave isn't named and so isn't read.

Defined results: an archive that is cut off is an error; trailing zeros are padding; broken UTF-8 becomes replacement characters; an empty file, and a folder
without files, has no records; a null text is an empty body, a null address has no header; line breaks in addresses are written percent-encoded.
"""

from __future__ import annotations

import fnmatch
import io
import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.session import ship
from textloom.sources.files import filesystem, write_bytes

NAME = "warc_records"
#: Columns: where a record is (its member's first byte, its number in the member), headers, bytes of the body, and the body.
SCHEMA = "file string, offset long, record long, type string, id string, uri string, date string, content_type string, length long, text string, body binary"
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))
HEADERS = {"type": "warc-type", "id": "warc-record-id", "uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type"}
SPLIT_BYTES = 64 << 20
PIECE, BATCH_BYTES, BATCH_ROWS = 1 << 18, 4 << 20, 1000
MAGIC = b"\x1f\x8b\x08"
MANIFEST = "_manifest.json"


class _Source:
    """Bytes of a file from ``at`` on, a piece at a time."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        file.seek(at)
        self.file, self.at, self.data = file, at, b""

    def more(self) -> bool:
        piece = self.file.read(PIECE)
        self.data += piece
        return bool(piece)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n

    def has(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n


class _Member(io.RawIOBase):
    """What a gzip member inflates to."""

    def __init__(self, source: _Source) -> None:
        self.source, self.inflater = source, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.inflater.eof:
            got = self.inflater.decompress(self.source.data, len(buffer))
            left = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            self.source.drop(len(self.source.data) - len(left))
            if got:
                buffer[: len(got)] = got
                return len(got)
            if not self.inflater.eof and not self.source.data and not self.source.more():
                raise EOFError(f"the archive ends inside a member, at byte {self.source.at}")
        return 0


class _Plain(io.RawIOBase):
    """A file that isn't compressed."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.file.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


def _begins_record(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 5) == b"WARC/"
    except zlib.error:
        return False


def _first_member(source: _Source, stop: int) -> bool:
    """Move to the first member that begins before ``stop``."""
    while source.at < stop and source.has(len(MAGIC)):
        k = source.data.find(MAGIC)
        if k < 0:
            source.drop(len(source.data) - len(MAGIC) + 1)
            source.more()
            continue
        source.drop(k)
        source.has(PIECE)
        if source.at < stop and _begins_record(source.data):
            return True
        source.drop(1)
    return False


def _records(stream: io.BufferedReader, at: int) -> Iterator[tuple[dict[str, str], int, Callable[[], bytes]]]:
    """Headers, length and a reader of the body of each record; bodies that aren't read are passed over."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin, at byte {at}: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        left = length = int(headers.get("content-length", 0))

        def body() -> bytes:
            nonlocal left
            data, left = stream.read(left), 0
            if len(data) < length:
                raise EOFError(f"the archive ends inside a record, at byte {at}")
            return data

        yield headers, length, body
        while left:
            skipped = len(stream.read(min(left, PIECE)))
            if not skipped:
                raise EOFError(f"the archive ends inside a record, at byte {at}")
            left -= skipped


def records(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, int, dict[str, str], int, Callable[[], bytes]]]:
    """Offset of the member, number in it, headers, length and body reader of the records that begin in a part of a file."""
    file.seek(0)
    if file.read(len(MAGIC)) != MAGIC:
        if start == 0:
            file.seek(0)
            for k, (headers, length, body) in enumerate(_records(io.BufferedReader(_Plain(file), PIECE), 0)):
                yield 0, k, headers, length, body
        return
    source = _Source(file, start)
    if start and not _first_member(source, stop):
        return
    while source.at < stop:
        if not source.has(1) or not source.data.strip(b"\0") and not source.more():
            return
        if not source.data.strip(b"\0"):
            source.drop(len(source.data))
            continue
        source.has(len(MAGIC))
        if not source.data.startswith(MAGIC):
            raise ValueError(f"no member follows at byte {source.at}: read this archive with split_bytes 0")
        at, member = source.at, io.BufferedReader(_Member(source), PIECE)
        for k, (headers, length, body) in enumerate(_records(member, at)):
            yield at, k, headers, length, body


@dataclass
class _Part(InputPartition):
    path: str
    start: int
    stop: int


def files(path: str) -> Iterator[tuple[str, int]]:
    """Paths and sizes of a file's, a pattern's or a folder's archives; a folder with a manifest has those that it names."""
    scheme, _, rest = path.rpartition("://")
    prefix = f"{scheme}://" if scheme else ""
    if any(c in path.rsplit("/", 1)[-1] for c in "*?["):
        base, _, pattern = path.rpartition("/")
    else:
        base, pattern = path, None
    fs, inner = filesystem(base if "://" in base or base.startswith("file:") else f"file://{base}")
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.File:
        yield inner, info.size
        return
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(f"{prefix}{rest}")
    found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.type == pyarrow.fs.FileType.File]
    names = {f.base_name for f in found}
    if pattern is None and MANIFEST in names:
        with fs.open_input_file(f"{inner}/{MANIFEST}") as f:
            named = {x["file"] for x in json.loads(f.read())["files"]}
        if named - names:
            raise FileNotFoundError(f"the manifest of {path} names {sorted(named - names)[0]}")
        found = [f for f in found if f.base_name in named]
    for f in sorted(found, key=lambda f: f.path):
        if f.base_name[0] not in "._" and (pattern is None or fnmatch.fnmatch(f.base_name, pattern)):
            yield f.path, f.size


def _uri(path: str, inner: str) -> str:
    fs, _ = filesystem(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return f"file://{inner}" if isinstance(fs, pyarrow.fs.LocalFileSystem) else path[: path.index("://") + 3] + inner


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.names
        self.arrow = to_arrow_schema(schema)
        self.paths = [p for p in str(options.get("path", "")).split("\n") if p]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.types: set[str] | None = None
        unknown = set(self.columns) - set(COLUMNS)
        if unknown or not self.paths:
            raise ValueError(f"no such column of an archive: {sorted(unknown)}" if unknown else "an archive needs a path")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("type",):
                found = set(f.value) if isinstance(f, In) else {f.value}
                self.types = found if self.types is None else self.types & found
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            for inner, size in files(path):
                step = self.split if self.split > 0 else max(size, 1)
                out += [_Part(_uri(path, inner), k, min(k + step, size)) for k in range(0, size, step)]
        return out

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # as Spark calls it where there are no parts
            return
        fs, inner = filesystem(partition.path)
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(inner) as file:
            for offset, k, headers, length, body in records(file, partition.start, partition.stop):
                if self.types is not None and headers.get("warc-type", "") not in self.types:
                    continue
                row = {"file": partition.path, "offset": offset, "record": k, "length": length} | {c: headers.get(h) for c, h in HEADERS.items()}
                row["type"] = row["type"] or ""
                if {"text", "body"} & set(self.columns):
                    row["body"] = body()
                    row["text"] = row["body"].decode("utf-8", "replace") if "text" in self.columns else None
                    held += length
                rows.append({c: row[c] for c in self.columns})
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


def member(kind: str, body: bytes, **headers: str | None) -> bytes:
    """A record as a gzip member; ``headers`` by the names of columns."""
    lines = [f"WARC-Type: {kind}"]
    for name, value in headers.items():
        if value is not None:
            lines.append(f"{HEADERS[name].title().replace('Warc', 'WARC').replace('Uri', 'URI').replace('-Id', '-ID')}: " + value.replace("\r", "%0D").replace("\n", "%0A"))
    head = "WARC/1.0\r\n" + "\r\n".join([*lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n"
    deflater = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflater.compress(head.encode() + body + b"\r\n\r\n") + deflater.flush()


class ArchiveWriter(DataSourceArrowWriter):
    """Columns ``text`` or ``body``, and any of ``type`` (else conversion), ``id``, ``uri``, ``date``, ``content_type``."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"], overwrite
        self.folder = self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}"
        self.columns = set(schema.names)
        self.software = options.get("software", "textloom")
        if not self.columns & {"text", "body"} or self.columns - {"text", "body", *HEADERS}:
            raise ValueError("an archive is written from text or body and columns of headers")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, inner = filesystem(self.folder)
        fs.create_dir(inner, recursive=True)
        name, n, out = f"part-{uuid.uuid4().hex}.warc.wet.gz", 0, None
        headers = sorted((self.columns - {"type"}) & set(HEADERS))
        try:
            for batch in iterator:
                if out is None and batch.num_rows:
                    out = fs.open_output_stream(f"{inner}/{name}", compression=None)
                    out.write(member("warcinfo", f"software: {self.software}\r\n".encode(), content_type="application/warc-fields"))
                for row in batch.to_pylist():
                    body = row.get("body") if row.get("body") is not None else (row.get("text") or "").encode()
                    out.write(member(row.get("type") or "conversion", bytes(body), **{h: row[h] for h in headers}))
                    n += 1
        finally:
            if out is not None:
                out.close()
        return _Written([{"file": name, "records": n}] if out is not None else [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = filesystem(self.folder)
        fs.create_dir(inner, recursive=True)
        old, path = [], f"{inner}/{MANIFEST}"
        if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
            with fs.open_input_file(path) as f:
                old = json.loads(f.read())["files"]
        new = [f for m in messages if m for f in m.files]
        write_bytes(f"{self.folder}/{MANIFEST}.new", json.dumps({"files": new if self.overwrite else old + new}).encode())
        fs.move(f"{path}.new", path)
        for f in old if self.overwrite else []:
            fs.delete_file(f"{inner}/{f['file']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = filesystem(self.folder)
        for f in [f for m in messages if m for f in m.files]:
            fs.delete_file(f"{inner}/{f['file']}")


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)


def read_archives(spark: SparkSession, paths: str | Iterable[str], columns: Iterable[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of files, patterns or folders; ``columns`` are the only ones that are read."""
    register(spark)
    whole = StructType.fromDDL(SCHEMA)
    schema = whole if columns is None else StructType([whole[c] for c in columns])
    return spark.read.format(NAME).schema(schema).option("split_bytes", str(split_bytes)).load("\n".join([paths] if isinstance(paths, str) else paths))


def write_archives(rows: DataFrame, folder: str, mode: str = "append") -> None:
    register(rows.sparkSession)
    rows.write.format(NAME).mode(mode).save(folder)
