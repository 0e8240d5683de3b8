"""The data source of WARC and WET archives against the plain reader."""

import gzip
import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.sources import archives, wet


def build(n, seed=0, info=True):
    rng = random.Random(seed)
    out = [archives.member("warcinfo", b"x: y")] if info else []
    for k in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randint(0, 400))) if k % 3 else f"é text {k}\r\n\r\nWARC/1.0\r\n".encode()
        out.append(archives.member(rng.choice(["conversion", "response", "conversion"]), body, uri=f"http://h{k}/é" if k % 4 else None, id=f"<{k}>"))
    return out


def plain(data):
    return sorted((kind, uri, body) for kind, uri, body in wet.records(data))


def found(df):
    return sorted((r["type"], r["uri"], bytes(r["body"])) for r in df.select("type", "uri", "body").collect())


def key(row):
    return (row[0], row[1] or "", row[2])


@pytest.mark.parametrize("split", [0, 90, 1000, 1 << 20])
def test_parts_of_files(spark, tmp_path, split):
    """Every record once, wherever the cuts fall: between members, inside them, or with no member in a part."""
    members = build(60)
    for name, data in {"a.gz": b"".join(members), "b.gz": b"".join(members[:1]), "c.gz": gzip.compress(gzip.decompress(b"".join(members))), "plain": gzip.decompress(b"".join(members)), "padded.gz": b"".join(members) + b"\0" * 700, "empty": b""}.items():
        (tmp_path / name).write_bytes(data)
        df = archives.read_archives(spark, str(tmp_path / name), split_bytes=split)
        want = sorted(wet.records(b"".join(members) if name == "padded.gz" else data), key=key)
        assert sorted(((r["type"], r["uri"], bytes(r["body"])) for r in df.collect()), key=key) == want, name
        if split and name == "a.gz":
            assert df.rdd.getNumPartitions() == -(-len(data) // split)


def test_columns_and_types(spark, tmp_path):
    data = b"".join(build(40))
    for name in ("a.wet.gz", "b.wet.gz"):
        (tmp_path / name).write_bytes(data)
    df = archives.read_archives(spark, str(tmp_path / "*.wet.gz"), columns=["file", "offset", "record", "type", "text"], split_bytes=500)
    texts = df.where("type = 'conversion'")
    want = [body.decode("utf-8", "replace") for kind, _, body in wet.records(data) if kind == "conversion"]
    for name in ("a", "b"):
        rows = texts.where(F.col("file").endswith(f"{name}.wet.gz")).orderBy("offset", "record").collect()
        assert [r["text"] for r in rows] == want
    assert "PushedFilters: [EqualTo(type,conversion)]" in texts._jdf.queryExecution().toString() or "type" in texts._jdf.queryExecution().toString()
    reader = archives.ArchiveReader(df.schema, {"path": str(tmp_path)})
    f = archives.EqualTo(("type",), "conversion")
    other = archives.EqualTo(("file",), "x")
    assert list(reader.pushFilters([f, archives.In(("type",), ("conversion", "response")), other])) == [other] and reader.types == {"conversion"}
    old = wet.read_wet(spark, str(tmp_path / "*.wet.gz")).groupBy("uri", "text").count().collect()
    new = archives.read_archives(spark, str(tmp_path)).where("type = 'conversion'").groupBy("uri", "text").count().collect()
    assert sorted(old, key=repr) == sorted(new, key=repr)


def test_archives_that_are_wrong(spark, tmp_path):
    data = b"".join(build(5))
    for name, bad, message in [("cut.gz", data[:-30], "ends inside"), ("gap.gz", data + b"nonsense", "no member"), ("text", b"nonsense\n", "no record"), ("short", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc", "ends inside")]:
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception, match=message):
            archives.read_archives(spark, str(tmp_path / name)).select("body").collect()
    with pytest.raises(Exception, match="no such column"):
        spark.read.format(archives.NAME).schema("nothing string").load(str(tmp_path / "cut.gz")).collect()


def test_archive_inside_a_body(tmp_path):
    """A stored archive in a body looks like members to a part that begins in it: an error and no rows twice."""
    import zlib

    inner = b"".join(build(3))
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(inner)
    data = stored.compress(head + inner + b"\r\n\r\n") + stored.flush() + b"".join(build(2))
    (tmp_path / "a.gz").write_bytes(data)
    with pa.OSFile(str(tmp_path / "a.gz")) as f:
        assert len(list(archives.records(f, 0, len(data)))) == 1 + 3
        with pytest.raises(ValueError, match="split_bytes 0"):
            list(archives.records(f, 60, len(data)))


def test_memory_of_a_large_archive(tmp_path):
    """Members stream: what is held doesn't grow with the file, nor with a body that nobody reads."""
    path = str(tmp_path / "large.gz")
    body = random.Random(1).randbytes(1 << 16)
    with open(path, "wb") as f:
        for k in range(600):
            f.write(archives.member("conversion", body, id=f"<{k}>"))
        f.write(archives.member("response", b"\0" * (200 << 20)))
    schema = archives.StructType.fromDDL("type string, length long")
    reader = archives.ArchiveReader(schema, {"path": path})
    texts = archives.ArchiveReader(archives.StructType.fromDDL("type string, body binary"), {"path": path})
    texts.types = {"conversion"}
    for r, n in ((reader, 601), (texts, 600)):
        tracemalloc.start()
        assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == n
        assert tracemalloc.get_traced_memory()[1] < 25 << 20
        tracemalloc.stop()


def test_written_archives(spark, tmp_path):
    """Rows come back; what no commit names isn't read; overwriting replaces."""
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"<{k}>", None if k == 3 else f"http://h/{k}\n", None if k == 4 else "é" * k) for k in range(50)], "id string, uri string, text string")
    archives.write_archives(rows.repartition(3), folder)
    archives.write_archives(rows.limit(0), folder)
    (tmp_path / "out" / "part-stray.warc.wet.gz").write_bytes(archives.member("conversion", b"stray"))
    back = archives.read_archives(spark, folder).where("type = 'conversion'")
    want = [(f"<{k}>", None if k == 3 else f"http://h/{k}%0A", "" if k == 4 else "é" * k) for k in range(50)]
    assert sorted(tuple(r) for r in back.select("id", "uri", "text").collect()) == sorted(want, key=lambda r: r[0])
    assert archives.read_archives(spark, folder).where("type = 'warcinfo'").count() == 3
    archives.write_archives(rows.limit(7), folder, "append")
    assert archives.read_archives(spark, folder).where("type = 'conversion'").count() == 57
    archives.write_archives(rows.limit(7), folder, "overwrite")
    assert archives.read_archives(spark, folder).where("type = 'conversion'").count() == 7
    named = {f["file"] for f in json.loads((tmp_path / "out" / "_manifest.json").read_text())["files"]}
    assert {p.name for p in (tmp_path / "out").glob("part-*")} == named | {"part-stray.warc.wet.gz"}
