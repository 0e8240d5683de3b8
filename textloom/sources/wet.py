"""Conversion records of WET files (gzip members), as rows."""

from __future__ import annotations

import gzip
import io
import os
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import ship
from textloom.sources import encodings


def records(data: bytes) -> Iterator[tuple[str, str | None, bytes]]:
    """Type, target address and body of each record of a plain or gzip file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        body = stream.read(int(headers.get("content-length", 0)))
        yield headers.get("warc-type", ""), headers.get("warc-target-uri"), body


def read_wet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, pos, uri, text``: conversion records in order; broken UTF-8 becomes replacement characters.

    A gzip file can't be split, so a file is one task's, as in any reader of such archives.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("uri", pa.string()), ("text", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, pos = [], 0
                for kind, uri, body in records(content):
                    if kind == "conversion":
                        rows.append({"file": path, "pos": pos, "uri": uri, "text": body.decode("utf-8", "replace")})
                        pos += 1
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, "file string, pos long, uri string, text string")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, text`` of the lines that aren't blank."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return lines.where(F.trim("text") != "")


def output_name(path: str, suffix: str) -> str:
    """Name of what is made from a file: one trailing ``.gz`` goes, the suffix is added."""
    return os.path.basename(path).removesuffix(".gz") + suffix


def write_filtered(rows: DataFrame, folder: str, file: str = "file", text: str = "text", suffix: str = ".filtered.txt") -> None:
    """A gzip text file's folder ``name=<input's name><suffix>`` for each input file, a document per line; Spark commits them as a whole.

    White space inside a document becomes single spaces, as a line is one document.
    """
    base = F.regexp_replace(F.substring_index(file, "/", -1), r"\.gz$", "")
    lines = rows.select(F.concat(base, F.lit(suffix)).alias("name"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("value"))
    lines.write.mode("overwrite").partitionBy("name").option("compression", "gzip").text(folder)


def decode_html(data: bytes | None) -> str:
    """UTF-8, else the encoding that a byte order mark or a meta tag names, else the likeliest by its characters; what can't be decoded becomes replacements."""
    import re

    if not data:
        return ""
    try:
        if b"\0" not in data:
            return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    named = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", data[:4096])
    guess = "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else named[1].decode() if named else encodings.detect(data)
    try:
        return data.decode(guess, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def decoded_html(data: Column) -> Column:
    """:func:`decode_html` of a binary column: sound UTF-8 stays in the JVM, only the rest goes to Python."""

    @F.pandas_udf("string")
    def guessed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else decode_html(bytes(x)))

    sound = F.try_validate_utf8(data.cast("string"))
    return F.when(data.isNull(), F.lit("")).when(sound.isNotNull(), sound).otherwise(guessed(F.when(sound.isNull(), data)))
