"""Token ids of a corpus in binary files, one zstandard frame per document under a shared dictionary.

A store is a folder: ``dictionary`` (trained on the serialized ids of a bounded sample of
documents), data files, and a manifest table that names the files that count. A data file is

    magic, id size, SHA-256 of the dictionary    48 bytes
    one zstandard frame per document             in ascending doc_id order
    index: doc_id, frame offset, frame size,
    number of ids, flags                         five little-endian 64-bit columns
    index offset, documents, ids, CRC-32, magic  40 bytes

so one short document is read with the footer, its index entry and its frame. Documents are
dealt by ranges of doc_id, and of the text's beginning where a doc_id (or null) has many rows; a task streams through its range and keeps one Arrow batch and the
index in memory. A task that is tried again writes another file, and the manifest names the
one whose task succeeded.

Defined results: null text is empty (the end id alone); a null doc_id comes first; rows with
one doc_id follow each other by text (where they are over ROWS_PER_ID, by its first 32 characters, then its hash); very long texts are one frame; extra columns are ignored, whatever their names; empty tables give an empty manifest; a damaged
file, or one with another dictionary, raises :class:`TokenStoreError`.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.encoding import default_path, encoder
from textloom.llm.sampling import bounded
from textloom.session import lean, ship
from textloom.sources.files import filesystem, make_dir, read_bytes, write_bytes

MAGIC, END = b"TLTOKEN1", b"TLTOKEND"
HEAD, FOOT = struct.Struct("<8sQ32s"), struct.Struct("<QQQQ8s")
#: The dictionary is fitted on at most so many documents (the least by hash) of at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 20_000, 1 << 16
LEVEL = 3
READ_BYTES = 4 << 20
#: With more rows of one doc_id (or without one) than this, ranges go by the text's beginning, its hash and the row's number too.
ROWS_PER_ID = 10_000
#: Appended to every document.
END_ID = 0

MANIFEST = "file string, part int, docs long, ids long"
_DICTIONARIES: dict[str, bytes] = {}


class TokenStoreError(ValueError):
    """A file isn't a sound part of the store."""


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary for serialized ids, from a bounded sample; empty where the sample is too small for one."""
    few = bounded(docs, "doc_id", SAMPLE_DOCS).where(F.length("text") <= SAMPLE_CHARS).select("text").limit(SAMPLE_DOCS).collect()
    samples = [x.tobytes() for x in encoder(tokenizer).encode(sorted(r[0] for r in few))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [x for x in samples if x]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class Writer:
    """One data file."""

    def __init__(self, uri: str, dictionary: bytes, itemsize: int) -> None:
        fs, path = filesystem(uri)
        self.out = fs.open_output_stream(path)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=True)
        self.at, self.index, self.ids = HEAD.size, array("q"), 0
        self.out.write(HEAD.pack(MAGIC, itemsize, hashlib.sha256(dictionary).digest()))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.zip.compress(ids.tobytes())
        self.out.write(frame)
        self.index.extend((doc_id or 0, self.at, len(frame), len(ids), doc_id is None))
        self.at += len(frame)
        self.ids += len(ids)

    @property
    def docs(self) -> int:
        return len(self.index) // 5

    def close(self) -> None:
        index = np.array(self.index, "<i8").reshape(-1, 5).T.tobytes()
        self.out.write(index)
        self.out.write(FOOT.pack(self.at, self.docs, self.ids, zlib.crc32(index), END))
        self.out.close()


class Reader:
    """Documents of one data file, all in order or one by its place."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if size < HEAD.size + FOOT.size:
            raise TokenStoreError(f"{uri}: too short")
        magic, itemsize, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        at, docs, self.ids, crc, end = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or end != END or at + 40 * docs + FOOT.size != size:
            raise TokenStoreError(f"{uri}: no token file, or cut off")
        if digest != hashlib.sha256(dictionary).digest():
            raise TokenStoreError(f"{uri}: written with another dictionary")
        index = self.file.read_at(40 * docs, at)
        if zlib.crc32(index) != crc:
            raise TokenStoreError(f"{uri}: damaged index")
        self.doc_id, self.at, self.size, self.count, self.null = np.frombuffer(index, "<i8").reshape(5, -1)
        self.dtype = np.dtype(f"<u{itemsize}")
        self.zip = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _ids(self, frame: bytes, k: int) -> np.ndarray:
        try:
            ids = np.frombuffer(self.zip.decompress(frame), self.dtype)
        except zstandard.ZstdError as e:
            raise TokenStoreError(f"document {k}: {e}") from e
        if len(ids) != self.count[k]:
            raise TokenStoreError(f"document {k}: {len(ids)} ids, the index has {self.count[k]}")
        return ids

    def one(self, k: int) -> np.ndarray:
        """The ids of the k-th document; nothing else is read."""
        return self._ids(self.file.read_at(int(self.size[k]), int(self.at[k])), k)

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        k, n = 0, len(self.at)
        while k < n:
            stop = max(int(np.searchsorted(self.at, self.at[k] + READ_BYTES)), k + 1)
            start = int(self.at[k])
            data = self.file.read_at(int(self.at[stop - 1] + self.size[stop - 1]) - start, start)
            for i in range(k, stop):
                at = int(self.at[i]) - start
                yield None if self.null[i] else int(self.doc_id[i]), self._ids(data[at : at + int(self.size[i])], i)
            k = stop


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``doc_id, text`` into ``folder`` and return the manifest, which is a table in it."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_path()
    ship(spark)
    make_dir(folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    write_bytes(f"{folder}/dictionary", train_dictionary(docs, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, name = None, TaskContext.get().partitionId(), ""
        enc = encoder(tokenizer)
        for batch in batches:
            if out is None:
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                out = Writer(name, read_bytes(f"{folder}/dictionary"), enc.dtype.itemsize)
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for k in range(0, len(ids), 100):
                for doc_id, found in zip(ids[k : k + 100], enc.encode(texts.slice(k, 100).to_pylist()), strict=True):
                    out.add(doc_id, np.append(found, np.array([end_id], found.dtype)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "docs": out.docs, "ids": out.ids}], schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

    many = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if many <= ROWS_PER_ID:
        dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    else:  # equal rows are told apart by their number, so that they too are more than one range
        keys = ["doc_id", F.left("text", F.lit(32)), F.xxhash64("text"), F.col("nth")]
        dealt = docs.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("nth")
    files = dealt.mapInArrow(lean(run), MANIFEST)
    files.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a store with ``start``, the number of ids in all files before."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")  # a row per file
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)))


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of a store: its place among all ids, number of ids, their CRC-32 as 32-bit ids, and the ids if asked for."""
    ship(spark)
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.list_(pa.int32()))] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = read_bytes(f"{folder}/dictionary")
        for batch in batches:
            for name, start, docs, total in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "docs", "ids")), strict=True):
                reader, rows, first = Reader(name, dictionary), [], start
                if (len(reader.at), reader.ids) != (docs, total):
                    raise TokenStoreError(f"{name}: not as in the manifest")
                for doc_id, ids in reader.all():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] * with_ids)))
                    start += len(ids)
                    if len(rows) == 1000:
                        yield _rows(rows, kinds)
                        rows = []
                if rows:
                    yield _rows(rows, kinds)
                if start - first != total:
                    raise TokenStoreError(f"{name}: its ids aren't as many as its footer says")

    files = manifest(spark, folder)
    return files.repartition(max(1, files.count())).mapInArrow(lean(run), DIGEST + ", ids array<int>" * with_ids)


def _rows(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
