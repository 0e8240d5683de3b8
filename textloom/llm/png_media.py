"""Payloads as PNG images in binary columns, and low-frequency cosine-transform hashes of them.

A payload is padded with zero bytes to whole rows of 64 grey pixels and becomes one PNG:
signature, IHDR, one zlib stream in IDAT chunks, IEND, each chunk with its CRC; each row has the filter (none, left
or above) that leaves the least sum of differences. The reader
trusts nothing: it checks signature, order, lengths, CRCs, header values, the zlib
checksum and the inflated size before it undoes the row filters with numpy.

Everything is integer arithmetic, so equal payloads have equal files and features on
every machine. Each row stands alone: no shuffle, memory is one Arrow batch.

Defined results: null is the empty payload, stored as one row of zeros; a damaged file
raises :class:`PngError`; very long payloads are one image with many rows; ties and repeated rows have equal files; an empty table
gives an empty table; columns named like a result (``n_bytes``, ``media``, the features) are replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textloom.session import lean, ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
IDAT_BYTES = 1 << 16
GRID, LOW = 32, 8
_U, _X = np.meshgrid(np.arange(LOW), np.arange(GRID), indexing="ij")
COSINES = np.round(np.cos((2 * _X + 1) * _U * np.pi / (2 * GRID)) * 4096).astype(np.int64)


class PngError(ValueError):
    """The bytes aren't a PNG of the kind that this module writes."""


def pad(payload: bytes) -> bytes:
    """Append zero bytes up to a positive multiple of the row width."""
    return payload + bytes(WIDTH if not payload else -len(payload) % WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, how: str) -> np.ndarray:
    """Rows with a leading filter byte: ``none``, ``sub``, ``up``, or for each row the ``adaptive`` best of these."""
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    every = np.stack([rows, left, up])
    if how == "adaptive":
        best = np.abs(every.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    else:
        best = np.full(len(rows), ("none", "sub", "up").index(how))
    return np.concatenate([best[:, None].astype(np.uint8), every[best, np.arange(len(rows))]], axis=1)


def encode(payload: bytes, how: str = "none", level: int = 6) -> bytes:
    """A PNG whose pixels are ``payload``, which must be whole rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    if how == "none":
        raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    else:
        raw = _filtered(rows, how)
    z = zlib.compress(raw.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", z[i : i + IDAT_BYTES]) for i in range(0, len(z), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(raw: np.ndarray) -> np.ndarray:
    """Undo the row filters of 8-bit grey pixels; runs of rows with one filter are done at once."""
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    if (kinds > 4).any():
        raise PngError("unknown row filter")
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    for i, j in zip(starts, [*starts[1:], len(out)], strict=True):
        kind = kinds[i]
        if kind == 1:
            out[i:j] = np.cumsum(out[i:j], axis=1, dtype=np.uint8)
        elif kind == 2:
            if i:
                out[i] += out[i - 1]
            out[i:j] = np.cumsum(out[i:j], axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(i, j):
                above = out[y - 1].tolist() if y else [0] * out.shape[1]
                row, left, corner = out[y].tolist(), 0, 0
                for x, b in enumerate(above):
                    guess = (left + b) // 2 if kind == 3 else _paeth(left, b, corner)
                    left = row[x] = (row[x] + guess) & 255
                    corner = b
                out[y] = row
    return out


def decode(png: bytes) -> np.ndarray:
    """The pixels of a PNG as rows, after all checks."""
    if png[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at, size, z, kinds = 8, None, [], []
    while at < len(png):
        if at + 12 > len(png):
            raise PngError("cut off in a chunk header")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if at + 12 + n > len(png):
            raise PngError("cut off in a chunk")
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise PngError(f"wrong CRC in {kind!r}")
        if (kind == b"IHDR") != (not kinds):
            raise PngError("IHDR must come first, once")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data) if n == 13 else ()
            if size[:1] != (WIDTH,) or not size[1] or size[2:] != (8, 0, 0, 0, 0):
                raise PngError("not 8-bit grey of the width in use")
        elif kind == b"IDAT":
            if kinds[-1] != b"IDAT" and z:
                raise PngError("IDAT chunks apart")
            z.append(data)
        elif kind == b"IEND":
            if n or at + 12 != len(png):
                raise PngError("bytes after the end")
        elif not kind[0] & 32:
            raise PngError(f"unknown critical chunk {kind!r}")
        kinds.append(kind)
        at += 12 + n
    if not z or kinds[-1] != b"IEND":
        raise PngError("IDAT or IEND is missing")
    want = size[1] * (WIDTH + 1)
    d = zlib.decompressobj()
    try:
        raw = d.decompress(b"".join(z), want + 1)
    except zlib.error as e:
        raise PngError(f"zlib: {e}") from e
    if len(raw) != want or not d.eof or d.unused_data:
        raise PngError("the pixels' size isn't the header's")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH + 1))


def cosine_hash(rows: np.ndarray) -> str:
    """64 bits, as hex: which of the 8 x 8 lowest frequencies of a 32 x 32 reduction exceed their median."""
    n = len(rows)
    wide = rows.reshape(n, GRID, WIDTH // GRID).sum(axis=2, dtype=np.int64)
    if n >= GRID:
        edges = np.arange(GRID + 1) * n // GRID
        small = np.add.reduceat(wide, edges[:-1], axis=0) * 256 // np.diff(edges)[:, None]
    else:
        small = wide[np.arange(GRID) * n // GRID] * 256
    low = (COSINES @ small @ COSINES.T).ravel()
    low[0] = 0
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


STORED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
FEATURES = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def _with(batch: pa.RecordBatch, drop: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    gone = {drop.lower(), *map(str.lower, columns)}  # as Spark compares names
    keep = [n for n in batch.schema.names if n.lower() not in gone]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *columns.values()], names=[*keep, *columns])


def store(rows: DataFrame, payload: str, how: str = "adaptive") -> DataFrame:
    """Replace the binary column ``payload`` by ``n_bytes`` (before padding) and the PNG ``media``."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.as_py() or b"" for x in batch.column(payload)]
            media = [encode(pad(x), how) for x in data]
            yield _with(batch, payload, {"n_bytes": pa.array([len(x) for x in data], pa.int64()), "media": pa.array(media, pa.binary())})

    gone = {payload.lower(), *STORED.names}
    keep = [f for f in rows.schema if f.name.lower() not in gone]
    return rows.mapInArrow(lean(run), T.StructType(keep + list(STORED)))


def read(stored: DataFrame, media: str = "media") -> DataFrame:
    """Decode and check every PNG and replace it by digests and the cosine hash."""
    ship(stored.sparkSession)

    def features(png: bytes) -> tuple:
        rows = decode(png)
        data = rows.tobytes()
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(features(x.as_py()) for x in batch.column(media)), strict=True)) or [()] * len(FEATURES)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield _with(batch, media, {n: pa.array(v, k) for n, v, k in zip(FEATURES.names, found, kinds, strict=True)})

    gone = {media.lower(), *FEATURES.names}
    keep = [f for f in stored.schema if f.name.lower() not in gone]
    return stored.mapInArrow(lean(run), T.StructType(keep + list(FEATURES)))

