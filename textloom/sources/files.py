"""Files in the shared folder, by URI: a local path, ``file://``, or a store that pyarrow opens (hdfs, s3, gs)."""

from __future__ import annotations

import pyarrow.fs


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> str:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
    return uri


def write_bytes(uri: str, data: bytes) -> None:
    fs, path = filesystem(uri)
    with fs.open_output_stream(path) as f:
        f.write(data)


def read_bytes(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()
