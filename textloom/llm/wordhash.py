"""Words of whole Arrow batches as numpy arrays: boundaries and 64-bit hashes without a Python loop over words.

Words are runs of bytes other than 0x20 and 0x09-0x0D, which never occur inside a UTF-8
sequence. Texts are worked on in groups of about half a megabyte, so memory doesn't depend on
the batch; one very long text is a group of its own, hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 19
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators that leave runs of ASCII letters and digits and of all other characters' bytes.
letters = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096) - 1, _ODD)]), dtype=np.uint64)
    return _powers[:n]


@dataclass
class Words:
    """The words of texts ``first`` to ``last`` of a batch: hashes, the text of each (from 0), and words by text."""

    first: int
    last: int
    hashes: np.ndarray
    doc: np.ndarray
    count: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the words data[starts:ends]."""
    table = _BYTE_LOWER if lower else _BYTE
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    upto = np.cumsum(lengths)
    k = 0
    while k < len(starts):
        stop = max(int(np.searchsorted(upto, (upto[k - 1] if k else 0) + GROUP_BYTES, "right")), k + 1)
        n = lengths[k:stop]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        values = table[data[np.repeat(starts[k:stop], n) + place]] * _powers_to(int(n.max()))[place]
        out[k:stop] = np.add.reduceat(values, begin)
        k = stop
    return mix(out + lengths.astype(np.uint64))


def words(column: pa.Array, lower: bool = True, separators: np.ndarray = _IS_SPACE) -> Iterator[Words]:
    """The words of a column in groups of consecutive texts."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(int(np.searchsorted(at, at[i] + GROUP_BYTES, "right")) - 1, i + 1)
        piece, edge = data[at[i] : at[j]], at[i : j + 1] - at[i]
        inside = ~separators[piece]
        begins, stops = inside.copy(), inside.copy()
        inner = edge[(edge > 0) & (edge < len(piece))]
        begins[1:] &= ~inside[:-1]
        begins[inner] = inside[inner]
        stops[:-1] &= ~inside[1:]
        stops[inner - 1] = inside[inner - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        doc = np.searchsorted(edge, starts, "right") - 1
        yield Words(i, j, hash_words(piece, starts, ends, lower), doc, np.bincount(doc, minlength=j - i))
        i = j


def combine(parts: list[np.ndarray], tag: int) -> np.ndarray:
    """One hash of several hashes in order; ``tag`` keeps kinds of combinations apart."""
    out = np.full(len(parts[0]), np.uint64(tag * int(_ODD) & (1 << 64) - 1), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + part)
    return out
