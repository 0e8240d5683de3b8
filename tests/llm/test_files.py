"""Token stores, WARC archives and PNG columns: exact round trips and damaged files."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import png_media, queries, token_store, warc
from textloom.llm.encoding import Encoder, default_path, encoder
from textloom.session import new_dir
from textloom.sources.files import filesystem

WHITE = st.text(alphabet="aB \n\té 　\x1c\x85.,'1s\0日", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(WHITE, st.text(max_size=20)), max_size=5))
def test_encoder_equals_the_library(texts):
    enc = encoder(default_path())
    assert [x.tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_nothing_wrong():
    small = Encoder(default_path(), memory=3)
    for text in ("a b c d e", "e d c b a", "a  b", "f\ng h"):
        assert small.encode([text])[0].tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(small.known) <= 8


def check_store(spark, df, rows):
    enc = encoder(default_path())
    rows.sort(key=lambda r: (r["start"]))
    want = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r["doc_id"] for r in rows] == [d for d, _ in want]
    at = 0
    for r, (_, text) in zip(rows, want, strict=True):
        ids = [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)


def test_token_store_query(spark, sf):
    check_store(spark, spark.read.parquet(f"{sf}/documents.parquet"), queries.op2_token_store(spark, sf).collect())


def test_token_store_odd_rows(spark):
    rows = [(5, "five"), (5, "also five"), (None, "no id"), (1, None), (2, ""), (9, "x" * 100_000), (3, "a  b\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_dir(spark, "tokens")
    token_store.write(df.repartition(3), folder)
    found = token_store.read(spark, folder, with_ids=True).collect()
    check_store(spark, df, found)
    empty = new_dir(spark, "tokens")
    token_store.write(df.limit(0), empty)
    assert token_store.read(spark, empty).count() == 0


def test_token_file_access_and_damage(tmp_path):
    dictionary = b""
    path = str(tmp_path / "one.tok")
    out = token_store.Writer(path, dictionary, 2)
    docs = [np.arange(n, dtype="<u2") for n in (5, 0, 1000)]
    for k, ids in enumerate(docs):
        out.add(None if k == 1 else k, ids)
    out.close()
    reader = token_store.Reader(path, dictionary)
    assert [reader.one(k).tolist() for k in (2, 0)] == [docs[2].tolist(), docs[0].tolist()]
    assert [d for d, _ in reader.all()] == [0, None, 2]
    with pytest.raises(token_store.TokenStoreError, match="dictionary"):
        token_store.Reader(path, b"other")
    data = (tmp_path / "one.tok").read_bytes()
    for cut in (0, 20, 60, len(data) - 1):
        (tmp_path / "cut.tok").write_bytes(data[:cut])
        with pytest.raises(token_store.TokenStoreError):
            token_store.Reader(str(tmp_path / "cut.tok"), dictionary)
    for at in (49, len(data) - 100):
        bad = bytearray(data)
        bad[at] ^= 255
        (tmp_path / "bad.tok").write_bytes(bad)
        with pytest.raises(token_store.TokenStoreError):
            list(token_store.Reader(str(tmp_path / "bad.tok"), dictionary).all())


def archive(records, dictionary=b""):
    zip_ = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    return warc.dictionary_frame(dictionary) + b"".join(zip_.compress(r) for r in records)


def test_warc_round_trip_with_dictionary():
    payloads = [f"<p>page {i} of many pages</p>".encode() * (i % 5 + 1) for i in range(200)]
    records = [warc.page_record(i, f"http://h/{i}\r\nX: y", p, None) for i, p in enumerate(payloads)]
    dictionary = zstandard.train_dictionary(2048, records).as_bytes()
    found = list(warc.read_archive(io.BytesIO(archive(records, dictionary))))
    assert [warc.payload_of(r)[2] for r in found] == payloads
    assert found[3].headers["warc-target-uri"] == "http://h/3%0D%0AX:%20y"
    # a dictionary that isn't compressed is read as well
    plain = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary + archive(records, dictionary)[len(warc.dictionary_frame(dictionary)) :]
    assert len(list(warc.read_archive(io.BytesIO(plain)))) == 200


def test_warc_large_incompressible_record():
    payload = np.random.default_rng(0).bytes(3_000_000)
    found = list(warc.read_archive(io.BytesIO(archive([warc.page_record(1, None, payload, None)] * 2))))
    assert [warc.payload_of(r)[2] == payload for r in found] == [True, True]


@pytest.mark.parametrize("cut", [0, 4, 9, 20, 100, -1])
def test_warc_cut_off(cut):
    data = archive([warc.page_record(1, "http://h/", b"payload" * 50, None)])
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(data[:cut])))


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 1", b"Content-Length: 2"), (b"WARC-Type", b"WARC Type:"), (b"sha1:", b"sha1:A"), (b"\r\nWARC-Date: 2024-01-01T00:00:00Z", b""), (b"payload", b"Payload")],
)
def test_warc_bad_headers(old, new):
    raw = warc.page_record(1, "http://h/", b"payload" * 10, None)
    with pytest.raises(warc.WarcError):
        [warc.payload_of(r) for r in warc.read_archive(io.BytesIO(archive([raw.replace(old, new, 1)])))]


def test_warc_odd_rows(spark):
    rows = [(1, "u", "same"), (7, "u", "same"), (7, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "alone"), (9, "http://h/\x01", "é" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as same")
    folder = new_dir(spark, "warc")
    warc.write(df.repartition(3), folder)
    found = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(spark, folder).collect()}
    assert found == {(1, "revisit", 7, 4), (7, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "response", None, 5), (9, "response", None, 100_000)}
    assert warc.read(spark, folder, with_payload=True).where("record_type = 'revisit'").where("payload is not null").count() == 0
    short = new_dir(spark, "warc")
    warc.write(df, short, min_revisit_bytes=5)
    assert warc.read(spark, short).where("record_type = 'revisit'").count() == 0
    empty = new_dir(spark, "warc")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1000), st.sampled_from(["none", "sub", "up", "adaptive"]))
def test_png_round_trip(data, how):
    padded = png_media.pad(data)
    assert len(padded) % 64 == 0 and padded.startswith(data) and len(padded) >= 64
    assert png_media.decode(png_media.encode(padded, how)).tobytes() == padded


def plain_filter(rows, kind):
    out = []
    for y, row in enumerate(rows):
        line = [kind]
        for x, v in enumerate(row):
            a, b = row[x - 1] if x else 0, rows[y - 1][x] if y else 0
            c = rows[y - 1][x - 1] if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(line)
    return out


@pytest.mark.parametrize("kinds", [[0] * 9, [1] * 9, [2] * 9, [3] * 9, [4] * 9, [2, 2, 1, 4, 3, 0, 2, 4, 1], [3, 2, 2, 4, 4, 1, 1, 0, 3]])
def test_png_filters(kinds):
    rows = np.random.default_rng(1).integers(0, 256, (9, 64)).tolist()
    raw = np.array([plain_filter(rows, k)[y] for y, k in enumerate(kinds)], np.uint8)
    assert png_media.unfilter(raw).tolist() == rows


def test_png_damage():
    png = png_media.encode(png_media.pad(b"text" * 100))
    for at in range(len(png)):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(png_media.PngError):
            png_media.decode(bytes(bad))
    for cut in range(0, len(png), 7):
        with pytest.raises(png_media.PngError):
            png_media.decode(png[:cut])
    with pytest.raises(png_media.PngError):
        png_media.decode(png + b"x")


def test_cosine_hash_follows_the_picture():
    rng = np.random.default_rng(2)
    smooth = (128 + 100 * np.outer(np.sin(np.arange(200) / 30), np.cos(np.arange(64) / 9))).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + rng.integers(-3, 4, smooth.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, smooth.shape).astype(np.uint8)
    bits = lambda x: int(png_media.cosine_hash(x), 16)
    assert (bits(smooth) ^ bits(noisy)).bit_count() <= 6 < 16 <= (bits(smooth) ^ bits(other)).bit_count()


def test_png_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_png_media(spark, sf).collect()
    assert len(rows) == len(texts)
    same = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        padded = png_media.pad(data)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert same.setdefault(texts[r["doc_id"]], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_png_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3), (1, b"", 4), (None, b"x" * 300_000, 5)], "doc_id long, payload binary, media int")
    rows = png_media.read(png_media.store(df, "payload")).collect()
    assert [r["payload_bytes"] for r in rows] == [64, 64, 300_032]
    assert png_media.read(png_media.store(df.limit(0), "payload")).count() == 0


def test_filesystem_of_local_uris(tmp_path):
    for uri in (f"file://{tmp_path}/a", f"file:{tmp_path}/a", f"{tmp_path}/a"):
        assert filesystem(uri)[1] == f"{tmp_path}/a"


SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n", "a", "é b", "  ", "\t"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(SPECIAL, max_size=4))
def test_encoder_equals_a_fresh_library_call(texts):
    """Texts with the tokenizer's own tokens give what a tokenizer just loaded gives."""
    from tokenizers import Tokenizer

    fresh = _fresh.setdefault("it", Tokenizer.from_file(default_path()))
    assert [x.tolist() for x in encoder(default_path()).encode(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


_fresh = {}


def test_special_tokens_in_long_texts(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_path())
    rows = [(1, "a <|endoftext|> b"), (2, "word " * 40_000 + "<|endoftext|>" + "x" * 50_000), (3, "<|endoftext|>")]
    folder = new_dir(spark, "tokens")
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as ids"), folder)
    found = {r["doc_id"]: r["ids"] for r in token_store.read(spark, folder, with_ids=True).collect()}
    assert found == {d: [*fresh.encode(t, add_special_tokens=False).ids, 0] for d, t in rows}
    assert found[1][1:3] == [220, 50256]


def test_png_query_unfilters(spark, sf):
    """What the query stores has filtered rows, so reading it back undoes them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "cast(text as binary) as payload", "'mine' as kind", "1 as n_bytes", "2 as feature")
    stored = png_media.store(docs, "payload")
    kinds = set()
    for r in stored.limit(40).collect():
        png, at, z = bytes(r["media"]), 8, b""
        while at < len(png):
            (n,) = struct.unpack_from(">I", png, at)
            z += png[at + 8 : at + 8 + n] if png[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        kinds |= set(zlib.decompress(z)[:: png_media.WIDTH + 1])
        assert r["kind"] == "mine" and r["n_bytes"] > 1 and r["feature"] == 2
    assert kinds >= {1, 2}
    assert "mine" in {r["kind"] for r in png_media.read(stored).limit(5).collect()}


def test_token_store_repeated_ids_and_clashes(spark, monkeypatch):
    """Many rows of one doc_id, or without one, are more than one range; extra columns don't matter."""
    monkeypatch.setattr(token_store, "ROWS_PER_ID", 100)
    rows = [(7, f"{i:03d} text") for i in range(300)] + [(None, f"{i:03d} other") for i in range(300)] + [(i, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as file", "3 as ids")
    folder, merge = new_dir(spark, "tokens"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    assert token_store.write(df, folder).count() > 2  # two ids hold nearly all rows
    spark.conf.unset(merge)
    check_store(spark, df, token_store.read(spark, folder).collect())
