"""Token ids of a stream as files, each batch's exactly once: ``stream.writeStream.format("token_parts")``.

A task writes its rows' ids to a file of its own name and reports it; the batch's commit writes one manifest that
names the batch's files with their documents and ids. The manifest appears whole, by a rename, under the batch's number. A batch that runs
again after a failure (its files may be there, or even its manifest, where only Spark's own note of the commit was lost) finds its manifest and
leaves it as it is, so documents and ids never count twice; files that no manifest names don't count at all.

Defined results: null arrays have no ids but count as documents; an id that the type can't hold stops the query; an empty batch has a manifest
without files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from textloom.session import ship
from textloom.sources.files import filesystem, write_bytes

NAME = "token_parts"


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _manifest(folder: str, batch: int) -> str:
    return f"{folder}/batch-{batch:012d}.json"


@dataclass
class Part(WriterCommitMessage):
    file: str
    docs: int
    tokens: int


class TokenSink(DataSourceStreamArrowWriter):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.folder, self.ids, self.dtype = _uri(options["path"]), options.get("ids", "ids"), options.get("dtype", "<u4")
        if self.ids not in schema.names:
            raise ValueError(f"the stream has no column {self.ids}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage | None:
        fs, inner = filesystem(self.folder)
        fs.create_dir(inner, recursive=True)
        name, docs, tokens, out = f"part-{uuid.uuid4().hex}.bin", 0, 0, None
        kind = np.dtype(self.dtype)
        try:
            for batch in iterator:
                flat = batch.column(self.ids).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(kind).max):
                    raise ValueError(f"an id doesn't fit {self.dtype}")
                out = fs.open_output_stream(f"{inner}/{name}", compression=None) if out is None else out
                out.write(flat.astype(kind).tobytes())
                docs, tokens = docs + batch.num_rows, tokens + len(flat)
        finally:
            if out is not None:
                out.close()
        return Part(name, docs, tokens) if docs else None

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, inner = filesystem(self.folder)
        fs.create_dir(inner, recursive=True)
        path = filesystem(_manifest(self.folder, batchId))[1]
        if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
            self.abort(messages, batchId)
            return
        parts = sorted(({"file": m.file, "docs": m.docs, "tokens": m.tokens} for m in messages if m), key=lambda p: p["file"])
        write_bytes(f"{_manifest(self.folder, batchId)}.new", json.dumps({"batch": batchId, "dtype": self.dtype, "parts": parts}).encode())
        fs.move(f"{path}.new", path)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, inner = filesystem(self.folder)
        for m in messages:
            if m and fs.get_file_info(f"{inner}/{m.file}").type == pyarrow.fs.FileType.File:
                fs.delete_file(f"{inner}/{m.file}")


class TokenParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: StructType, overwrite: bool) -> TokenSink:
        return TokenSink(schema, self.options)


def write_stream(stream: DataFrame, folder: str, checkpoint: str, ids: str = "ids", dtype: str = "<u4", **trigger) -> StreamingQuery:
    """Start writing the arrays of ids of a stream; ``trigger`` as of ``writeStream.trigger``."""
    ship(stream.sparkSession)
    stream.sparkSession.dataSource.register(TokenParts)
    writer = stream.select(ids).writeStream.format(NAME).option("ids", ids).option("dtype", dtype).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(folder)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, dtype, file, docs, tokens``: the files that count, a row each."""
    schema = "batch long, dtype string, parts array<struct<file: string, docs: long, tokens: long>>"
    return spark.read.schema(schema).json(f"{_uri(folder)}/batch-*.json").selectExpr("batch", "dtype", "inline(parts)")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, file, ids``: the ids of each file that counts, in pieces of bounded length with ``piece``, their number."""
    ship(spark)
    base, size = _uri(folder), 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("file", pa.string()), ("piece", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for r in batch.to_pylist():
                fs, inner = filesystem(f"{base}/{r['file']}")
                kind, n = np.dtype(r["dtype"]), 0
                with fs.open_input_file(inner) as f:
                    while data := f.read(size * kind.itemsize):
                        yield pa.RecordBatch.from_pylist([{"batch": r["batch"], "file": r["file"], "piece": n, "ids": np.frombuffer(data, kind).astype(np.int64)}], schema=schema)
                        n += 1

    return parts(spark, folder).mapInArrow(run, "batch long, file string, piece long, ids array<long>")
