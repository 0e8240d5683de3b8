import gzip

import pytest
from pyspark.sql import functions as F

from textloom.operators.bpe import Tokenizer
from textloom.operators.curation import FilterConfig, first_records
from textloom.sources import token_files, vocab, wet
from textloom.streaming import curation as streaming


def member(kind, uri, body):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\n" + (f"WARC-Target-URI: {uri}\r\n" if uri else "") + f"Content-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n")


def test_wet(spark, tmp_path):
    data = member("warcinfo", None, b"x: y") + member("conversion", "http://a/", "é text\n".encode()) + member("conversion", None, b"bad \xff") + member("conversion", "http://b/", b"")
    for name in ("b.wet.gz", "a.wet.gz"):
        (tmp_path / name).write_bytes(data)
    rows = wet.read_wet(spark, str(tmp_path / "*.gz"))
    found = [(r["pos"], r["uri"], r["text"]) for r in rows.orderBy("file", "pos").collect()]
    assert found == [(0, "http://a/", "é text\n"), (1, None, "bad �"), (2, "http://b/", "")] * 2
    assert first_records(rows, "file", "pos", 2).count() == 4
    assert wet.output_name("/x/a.wet.gz", ".filtered.txt.gz") == "a.wet.filtered.txt.gz"
    with pytest.raises(ValueError, match="record"):
        list(wet.records(b"nonsense\n"))


def test_lines(spark, tmp_path):
    (tmp_path / "t.txt.gz").write_bytes(gzip.compress(b"one\n\n  \ntwo"))
    assert [r["text"] for r in wet.read_lines(spark, str(tmp_path)).collect()] == ["one", "two"]


@pytest.mark.parametrize(
    ("data", "want"),
    [("é".encode(), "é"), (None, ""), ('<meta charset="iso-8859-1">é'.encode("latin-1"), '<meta charset="iso-8859-1">é'), (b"<meta charset=nosuch>\xff", "<meta charset=nosuch>�"), ("aé".encode("utf-16"), "aé")],
)
def test_decode(data, want):
    assert wet.decode_html(data) == want


@pytest.mark.parametrize("npy", [False, True])
def test_token_files(spark, tmp_path, npy):
    rows = spark.createDataFrame([(i, list(range(i))) for i in range(30)], "doc_id long, ids array<int>")
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(rows.repartition(5), folder, "doc_id", npy=npy)
    found = token_files.read_tokens(spark, folder).orderBy("pos").collect()
    assert [r["token"] for r in found] == [k for i in range(30) for k in range(i)]
    assert [r["pos"] for r in found] == list(range(len(found)))


def test_token_files_refuse(spark, tmp_path):
    big = spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="fit"):
        token_files.write_tokens(big, str(tmp_path / "a"), "doc_id")
    with pytest.raises(ValueError, match="no tokens"):
        token_files.write_tokens(big.limit(0), str(tmp_path / "b"), "doc_id")
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(ValueError, match="whole number"):
        token_files.load(str(tmp_path / "odd.bin"), "<u2", False)


def test_chunk_boundaries():
    data = b"aa|bb|cccccccc|d"
    found = token_files.chunk_boundaries(data, 4, b"|")
    assert found[0] == 0 and found[-1] == len(data) and all(data[k : k + 1] == b"|" for k in found[1:-1])
    assert token_files.chunk_boundaries(b"abc", 3, b"|") == [0, 3]


def test_vocabulary_files(tmp_path):
    t = Tokenizer({i: bytes([i]) for i in range(256)} | {256: b"th", 257: b"<|e|>"}, [(b"t", b"h")], ["<|e|>"])
    a, b = str(tmp_path / "v.json"), str(tmp_path / "m.json")
    vocab.save(t, a, b)
    assert vocab.load(a, b, ["<|e|>"]).encode("the<|e|>") == t.encode("the<|e|>")
    letters = vocab.byte_letters()
    assert len(letters) == 256 and letters["Ġ"] == 32 and letters["Ċ"] == 10 and sorted(letters.values()) == list(range(256))


def run_stream(spark, tmp_path, transform, mode="append"):
    query = transform.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("out").collect()
    spark.catalog.dropTempView("out")
    return rows


def test_stream_filter_duplicates_and_cap(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [("http://a.example.com/1", good), ("http://a.example.com/2", good), ("http://b.example.com/", "short"), *[(f"http://c.example.org/{k}", f"{good} more{k}") for k in range(4)]]
    spark.createDataFrame(rows, "uri string, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("uri string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = streaming.without_duplicates(streaming.passing(stream, FilterConfig()).select("uri", "masked", "digest"))
    found = run_stream(spark, tmp_path, streaming.capped(once, F.regexp_extract("uri", "//([^/]*)", 1), 2))
    by = {}
    for r in found:
        by[r["domain"]] = by.get(r["domain"], 0) + 1
    assert by == {"a.example.com": 1, "c.example.org": 2}


def test_stream_windows(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(2, "ts").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    found = run_stream(spark, tmp_path, streaming.counts_by_window(stream, "ts", "event_type", "1 day", delay="365 days"), "complete")
    assert sum(r["n"] for r in found) == events.count()




def test_paths_stats_and_runs(spark, tmp_path):
    from textloom.sources import runs

    for name in ("b.json", "a.json"):
        (tmp_path / name).write_text('[{"parameters": 5, "compute_budget": 1e18, "final_loss": 2.5}]')
    found = runs.expand_paths(spark, [f"{tmp_path}/*.json", f"{tmp_path}/a.json", "/no/such*"])
    assert [p.rsplit("/", 1)[1] for p in found] == ["such*", "a.json", "b.json"]
    assert runs.read_runs(spark, found[1]).first() == (5, 1e18, 2.5)
    assert runs.read_log(spark, f"{tmp_path}/a.json").count() == 1
    stats = spark.createDataFrame([("x", 1), ("y", 2)], "file string, n int")
    runs.write_stats(stats, str(tmp_path / "stats"), "file")
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "stats")).select("file", "n").collect())) == [("x", 1), ("y", 2)]
    runs.write_stats(stats, str(tmp_path / "whole"))
    assert spark.read.json(str(tmp_path / "whole")).count() == 2


def test_line_ids(spark):
    from textloom.operators import bpe, tokens

    t = Tokenizer({i: bytes([i]) for i in range(256)}, [])
    lines = spark.createDataFrame([("ab\n",), ("",), ("\n",), (None,)], "text string")
    encode = lambda df: bpe.encode(df, t)
    assert [r["ids"] for r in tokens.line_ids(lines, encode, 0).collect()] == [[97, 98, 0]]
    assert tokens.count_ids(tokens.line_ids(lines, encode, 0, keep_empty=True)).first() == (4, 6)


def test_harm_takes_nsfw_first(spark):
    from textloom.operators.curation import harm

    rows = [("nsfw", 0.95, "toxic", 1.0, "nsfw"), ("nsfw", 0.94, "toxic", 0.98, "toxic"), ("non-nsfw", 1.0, "toxic", 0.97, None), ("non-nsfw", 1.0, "non-toxic", 1.0, None)]
    df = spark.createDataFrame(rows, "a string, b double, c string, d double, want string")
    out = df.select("want", harm(F.col("a"), F.col("b"), F.col("c"), F.col("d"), FilterConfig()).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in out)
