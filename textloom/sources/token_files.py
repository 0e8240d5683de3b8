"""Flat token files: raw little-endian ids, or NumPy files, in parts that follow each other."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.session import ship
from textloom.sources.files import filesystem, make_dir, read_bytes

MANIFEST = "file string, part int, n long, dtype string, npy boolean"
BLOCK = 1 << 18


def write_tokens(rows: DataFrame, folder: str, order: str, ids: str = "ids", dtype: str = "<u2", npy: bool = False) -> DataFrame:
    """Write the arrays of ids end to end in the order of a column; returns the manifest, a table in the folder.

    Each range of the column is one part. Ids that the type can't hold, and a corpus without
    any id, are errors; only files that the manifest names count.
    """
    spark = rows.sparkSession
    ship(spark)
    make_dir(folder)
    most = int(np.iinfo(dtype).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, name, out = TaskContext.get().partitionId(), 0, "", None
        for batch in batches:
            if out is None:
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.{'npy' if npy else 'bin'}"
                fs, path = filesystem(name)
                out = fs.open_output_stream(path + ".raw" * npy)
            flat = batch.column(ids).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() > most):
                raise ValueError(f"an id doesn't fit {dtype}")
            n += len(flat)
            out.write(flat.astype(dtype).tobytes())
        if out is not None:
            out.close()
            if npy:  # its head says how many ids follow
                head = io.BytesIO()
                np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": (n,)})
                with fs.open_input_stream(path + ".raw") as raw, fs.open_output_stream(path) as whole:
                    whole.write(head.getvalue())
                    while data := raw.read(BLOCK):
                        whole.write(data)
                fs.delete_file(path + ".raw")
            yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "n": n, "dtype": dtype, "npy": npy}], schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("dtype", pa.string()), ("npy", pa.bool_())]))

    rows.select(order, ids).repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    found = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if not (found.agg(F.sum("n")).first()[0] or 0):
        raise ValueError("no tokens")
    return found


def load(uri: str, dtype: str, npy: bool) -> np.ndarray:
    """The ids of one part; a raw file must be whole ids long."""
    data = read_bytes(uri)
    if npy:
        return np.load(io.BytesIO(data))
    if len(data) % np.dtype(dtype).itemsize:
        raise ValueError(f"{uri}: not a whole number of ids")
    return np.frombuffer(data, dtype)


def stream(uri: str, dtype: str, npy: bool, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The ids of one part, ``block`` at a time; a raw file must be whole ids long."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as file:
        kind = np.dtype(dtype)
        if npy:
            version = np.lib.format.read_magic(file)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            kind = read(file)[2]
        elif file.size() % kind.itemsize:
            raise ValueError(f"{uri}: not a whole number of ids")
        while data := file.read(block * kind.itemsize):
            yield np.frombuffer(data, kind)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``pos, token`` of all parts in order."""
    ship(spark)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")  # a row per part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("start", F.coalesce(before, F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = 0
                for ids in stream(r["file"], r["dtype"], r["npy"]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids)) + r["start"] + n), pa.array(ids.astype(np.int64))], names=["pos", "token"])
                    n += len(ids)
                if n != r["n"]:
                    raise ValueError(f"{r['file']}: {n} ids, the manifest has {r['n']}")

    return files.repartition(max(1, files.count())).mapInArrow(run, "pos long, token long")


def chunk_boundaries(data: bytes, chunks: int, delimiter: bytes) -> list[int]:
    """Equal cuts moved forward to the next delimiter; fewer where they meet."""
    if not data or chunks < 1:
        return [0]
    cuts = {0, len(data)}
    for k in range(1, chunks):
        at = data.find(delimiter, len(data) // chunks * k)
        cuts.add(len(data) if at < 0 else at)
    return sorted(cuts)


def file_boundaries(uri: str, chunks: int, delimiter: bytes, step: int = 1 << 16) -> list[int]:
    """:func:`chunk_boundaries` of a file, of which only the bytes from each cut to the next delimiter are read."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as file:
        size = file.size()
        if not size or chunks < 1:
            return [0]
        cuts = {0, size}
        for k in range(1, chunks):
            at = size // chunks * k
            while at < size:
                found = file.read_at(min(step + len(delimiter) - 1, size - at), at).find(delimiter)
                if found >= 0:
                    break
                at += step
            cuts.add(at + found if at < size else size)
    return sorted(cuts)
