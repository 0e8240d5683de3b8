"""File forms, suffix lists, bucket links, hashes, attention and training against plain versions."""

import gzip
import json
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import url, vectors
from textloom.operators import bpe, curation, dedup, model_math, runs
from textloom.sources import runs as run_files
from textloom.sources import tables, token_files, wet


def test_curate_equals_a_loop(spark):
    """First of equal texts, then a cap per domain that duplicates don't count towards, as a loop over records has it; ties too."""
    rng = random.Random(4)
    rows = [(i // 2, f"d{rng.randrange(3)}", f"text {rng.randrange(25)}", f"f{i % 2}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, normalized string, file string").selectExpr("*", "cast(null as string) as reason", "'x' as _row", "'y' as place", "'z' as nth")
    found = curation.curate(df.repartition(1).sortWithinPartitions("doc_id", "file", "normalized"), F.col("source"), ["file"], config=curation.FilterConfig(max_per_domain=5))
    assert {(r["_row"], r["place"], r["nth"]) for r in found.collect()} == {("x", "y", "z")}
    want, seen, per = Counter(), set(), Counter()
    for doc_id, source, text, file in sorted(rows, key=lambda r: (r[0], r[3], r[2])):
        if (file, text) in seen:
            want["exact_duplicate"] += 1
        else:
            seen.add((file, text))
            per[file, source] += 1
            want["domain_cap" if per[file, source] > 5 else None] += 1
    assert Counter(r["reason"] for r in found.collect()) == want


def test_bucket_links_join_what_all_pairs_join(spark):
    rng = random.Random(2)
    points = {i: rng.randrange(60) for i in range(70)}
    keys = [(i, b, f"k{(p + 3 * b) // 12}") for i, p in points.items() for b in range(2)]
    linked = lambda a, b: abs(points[a] - points[b]) <= 1
    df = spark.createDataFrame(keys, "doc_id long, band int, key string")
    near = spark.createDataFrame(list(points.items()), "id long, p long")

    def verify(pairs):
        both = pairs.join(near.select(F.col("id").alias("l"), F.col("p").alias("pl")), "l").join(near.select(F.col("id").alias("r"), F.col("p").alias("pr")), "r")
        return both.where("abs(pl - pr) <= 1")

    def labels(pairs):
        label = {i: i for i in points}
        for _ in points:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    buckets = {}
    for i, band, key in keys:
        buckets.setdefault((band, key), []).append(i)
    every = {(a, b) for some in buckets.values() for a in some for b in some if a < b and linked(a, b)}
    found = {(r["l"], r["r"]) for r in dedup.bucket_links(df, verify, growth=2).collect()}
    assert found <= every and labels(found) == labels(every)
    assert dedup.bucket_links(df.limit(0), verify).count() == 0


def test_murmur_hash():
    """Published value of the hash of ``foo`` for seed 0, and a plain version for every length."""
    assert dedup.murmur_low(b"foo", np.zeros(1, np.uint64)).view(np.int64)[0] == -2129773440516405919

    def plain(data, seed):
        m = (1 << 64) - 1
        rot = lambda x, r: (x << r | x >> 64 - r) & m
        c1, c2, a, b = 0x87C37B91114253D5, 0x4CF5AD432745937F, seed, seed

        def f(x):
            x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & m
            x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & m
            return x ^ x >> 33

        padded = data + b"\0" * (-len(data) % 16)
        for i in range(0, len(padded), 16):
            k1, k2 = int.from_bytes(padded[i : i + 8], "little"), int.from_bytes(padded[i + 8 : i + 16], "little")
            a ^= rot(k1 * c1 & m, 31) * c2 & m
            if i + 16 <= len(data):
                a = (rot(a, 27) + b) * 5 + 0x52DCE729 & m
            b ^= rot(k2 * c2 & m, 33) * c1 & m
            if i + 16 <= len(data):
                b = (rot(b, 31) + a) * 5 + 0x38495AB5 & m
        a, b = a ^ len(data), b ^ len(data)
        a = a + b & m
        b = b + a & m
        a, b = f(a), f(b)
        return a + b & m

    rng = random.Random(1)
    for n in range(40):
        data = rng.randbytes(n)
        assert dedup.murmur_low(data, np.array([0, 1, 77], np.uint64)).tolist() == [plain(data, s) for s in (0, 1, 77)]


def test_murmur_signature_of_no_gram(spark):
    df = spark.createDataFrame([(1, ["a b", "c"]), (2, []), (3, None)], "doc_id long, grams array<string>")
    found = {r["doc_id"]: [int(x) for x in r["signature"]] for r in dedup.murmur_signatures(df, 3).collect()}
    assert found[2] == found[3] == [(1 << 64) - 1] * 3 and max(found[1]) < (1 << 64) - 1


def test_line_removal_of_files(spark, tmp_path):
    given = {"one.txt": "- home\nfirst\n- menu\n", "two.txt": "- home\r\nsecond\n- menu\nlast", "three.txt": "last\n", "four.txt": "- home\n"}
    (tmp_path / "in").mkdir()
    for name, text in given.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    rows = dedup.dedup_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert {r["file"]: r["lines"] for r in rows.collect()} == {"one.txt": 1, "two.txt": 2, "three.txt": 1, "four.txt": 0}
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"one.txt": "first\n", "two.txt": "second\nlast", "three.txt": "last\n", "four.txt": ""}


def test_filtered_text_and_stats_per_file(spark, tmp_path):
    rows = spark.createDataFrame([("file:/x/a.warc.wet.gz", "one\n two"), ("file:/x/a.warc.wet.gz", "three"), ("file:/x/b.gz.gz", "four")], "file string, text string")
    wet.write_filtered(rows, f"{tmp_path}/text")
    found = {d.name: sorted(line for p in d.glob("*.gz") for line in gzip.open(p, "rt").read().splitlines()) for d in (tmp_path / "text").iterdir() if d.is_dir()}
    assert found == {"name=a.warc.wet.filtered.txt": ["one two", "three"], "name=b.gz.filtered.txt": ["four"]}
    run_files.write_file_stats(rows.groupBy("file").agg(F.count(F.lit(1)).alias("kept")), f"{tmp_path}/stats")
    assert {d.name for d in (tmp_path / "stats" / "files").iterdir() if d.is_dir()} == {"name=a.warc.wet.stats", "name=b.gz.stats"}
    summary = [json.loads(x) for p in (tmp_path / "stats" / "summary").glob("*.json") for x in p.read_text().splitlines()]
    assert summary == [{"files": 2, "kept": 3}]


def test_times_and_unique_paths(spark, tmp_path):
    run_files.write_times(spark.createDataFrame([(2, 1.5), (0, 3.0), (1, 0.25)], "step int, ms double").repartition(3), f"{tmp_path}/times")
    lines = [x for p in (tmp_path / "times").glob("part*") for x in p.read_text().splitlines()]
    assert [float(x) for x in lines] == [3.0, 0.25, 1.5]
    folder = f"file://{tmp_path}"
    assert run_files.unique_path(spark, folder, "run.json", "t1") == f"{folder}/run.json"
    for name in ("run.json", "run-t1.json"):
        (tmp_path / name).write_text("{}")
    assert run_files.unique_path(spark, folder, "run.json", "t2") == f"{folder}/run-t2.json"
    assert run_files.unique_path(spark, folder, "run.json", "t1") == f"{folder}/run-t1-1.json"


def test_reading_texts(spark, tmp_path):
    df = spark.createDataFrame([("a",), (" \t\n",), (None,), ("b",), ("c",), ("",)], "text string")
    df.write.parquet(f"{tmp_path}/p")
    df.write.json(f"{tmp_path}/j")
    assert tables.read_texts(spark, f"{tmp_path}/p").count() == 3
    assert tables.read_texts(spark, f"{tmp_path}/j", "json", max_documents=2).count() == 2
    assert tables.read_texts(spark, f"{tmp_path}/p", max_documents=9).count() == 3


def test_html_bytes_column(spark):
    given = ["é plain".encode(), "<meta charset=latin-1>é".encode("latin-1"), b"\xff\xfea\0", b"bad \xff", None, b""]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(given)], "i int, b binary")
    found = {r["i"]: r["t"] for r in df.select("i", wet.decoded_html(F.col("b")).alias("t")).collect()}
    assert found == {i: wet.decode_html(b) for i, b in enumerate(given)}
    assert found[0] == "é plain" and found[1].endswith("é") and found[4] == ""


def test_file_boundaries(tmp_path):
    rng = random.Random(3)
    data = b"".join(rng.choice([b"word ", b"<end>", b"x" * 50]) for _ in range(400))
    (tmp_path / "f").write_bytes(data)
    for chunks in (1, 2, 7, 50):
        want = token_files.chunk_boundaries(data, chunks, b"<end>")
        assert token_files.file_boundaries(f"{tmp_path}/f", chunks, b"<end>", step=16) == want
        assert token_files.file_boundaries(f"{tmp_path}/f", chunks, b"<end>") == want
    (tmp_path / "none").write_bytes(b"")
    assert token_files.file_boundaries(f"{tmp_path}/none", 4, b"<end>") == [0]


def test_pretokens_of_files_by_end_mark(spark, tmp_path):
    parts = [["a b", "c\nd", ""], ["e", "f  g"], ["tail"]]
    for k, docs in enumerate(parts):
        (tmp_path / f"{k}.txt").write_text("<|end|>".join(docs), newline="")
    counts, marks = bpe.file_pretoken_counts(spark, f"file://{tmp_path}", "<|end|>")
    docs = spark.createDataFrame([(x,) for some in parts for x in some], "text string")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, bpe.pretoken_counts(docs).collect()))
    assert marks == sum(len(some) - 1 for some in parts)


SUFFIXES = ["// a list", "com", "uk", "co.uk", "*.ck", "!www.ck", "", "jp", "city.kobe.jp // last", "*.kawasaki.jp", "!city.kawasaki.jp"]


@pytest.mark.parametrize(
    ("address", "domain"),
    [
        ("http://www.example.com/x", "example.com"),
        ("http://a.b.example.co.uk/", "example.co.uk"),
        ("http://x.y.z.ck", "y.z.ck"),
        ("http://a.www.ck", "www.ck"),
        ("http://x.a.kawasaki.jp", "x.a.kawasaki.jp"),
        ("http://x.city.kawasaki.jp", "city.kawasaki.jp"),
        ("http://unknown.zone.test", "zone.test"),
        ("http://com", "com"),
        ("http://192.0.2.7/", "192.0.2.7"),
        ("no address", "no address"),
        (None, ""),
    ],
)
def test_registered_domain_by_a_list(spark, address, domain):
    rules = url.parse_suffixes(SUFFIXES)
    assert spark.createDataFrame([(address,)], "u string").select(url.registered_domain(F.col("u"), rules).alias("d")).first()["d"] == domain


def vector_rows(spark, name, data):
    return spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(data)], "seq int, id long, v array<double>")


def test_attention_mask_heads_and_gradients(spark):
    """Against numpy; a query without any key is not a number; gradients by finite differences."""
    rng = np.random.default_rng(0)
    q, k, v, g = (rng.normal(size=(6, 8)) for _ in range(4))
    frames = {name: vector_rows(spark, name, x) for name, x in (("q", q), ("k", k), ("v", v), ("g", g))}
    keep = rng.random((6, 6)) < 0.6
    keep[2] = False
    mask = spark.createDataFrame([(0, i, j, bool(keep[i, j])) for i in range(6) for j in range(6)], "seq int, qid long, kid long, keep boolean")

    def plain(q, k, v, allowed):
        s = np.where(allowed, q @ k.T / math.sqrt(q.shape[1]), -np.inf)
        with np.errstate(invalid="ignore"):
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p = p / p.sum(axis=1, keepdims=True)
        return p @ v

    out = model_math.attention(model_math.scores(frames["q"], frames["k"], 8, ["seq"], causal=False, mask=mask), frames["v"], ["seq"])
    found = np.array([r["out"] for r in out.orderBy("qid").collect()])
    np.testing.assert_allclose(found, plain(q, k, v, keep), rtol=1e-9)
    assert np.isnan(found[2]).all()

    causal = np.tril(np.ones((6, 6), bool))
    parts = {name: model_math.heads(f, 2, 4) for name, f in frames.items()}
    by = ["seq", "head"]
    rows = model_math.attention(model_math.scores(parts["q"], parts["k"], 4, by), parts["v"], by).collect()
    for h in range(2):
        mine = np.array([r["out"] for r in sorted(rows, key=lambda r: r["qid"]) if r["head"] == h])
        cut = slice(4 * h, 4 * h + 4)
        np.testing.assert_allclose(mine, plain(q[:, cut], k[:, cut], v[:, cut], causal), rtol=1e-9)

    s = model_math.scores(frames["q"], frames["k"], 8, ["seq"])
    ds = model_math.softmax_gradient(s, model_math.attention(s, frames["v"], ["seq"]), frames["v"], frames["g"], ["seq"])
    grads = {(r["of"], r["id"], r["dim"]): r["x"] for r in model_math.attention_gradients(ds, frames["q"], frames["k"], frames["g"], 8, ["seq"]).collect()}
    for name, x in (("dq", q), ("dk", k), ("dv", v)):
        for i, d in ((0, 0), (3, 5), (5, 7)):
            step = []
            for e in (1e-6, -1e-6):
                moved = {"dq": q.copy(), "dk": k.copy(), "dv": v.copy()}
                moved[name][i, d] += e
                step.append((plain(moved["dq"], moved["dk"], moved["dv"], causal) * g).sum())
            assert grads[name, i, d] == pytest.approx((step[0] - step[1]) / 2e-6, abs=1e-5)


def test_training_with_a_heap_equals_definition():
    rng = random.Random(5)
    table = {("".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))).encode(): rng.randint(1, 9) for _ in range(200)}
    state, want = [([bytes([b]) for b in w], n) for w, n in table.items()], []
    for _ in range(60):
        totals = Counter()
        for t, n in state:
            for pair in zip(t, t[1:]):
                totals[pair] += n
        if not totals:
            break
        best = max(totals, key=lambda p: (totals[p], p))
        want.append(best)
        state = [(bpe.merge_once(t, best), n) for t, n in state]
    assert bpe.train_local(table, 60) == want


def test_encoding_equals_a_plain_encoder(spark):
    """Ids of words by merges in the order of their rank, one at a time, over whole texts."""
    import regex

    texts = ["the cat sat on the mat", "the hat<|endoftext|>that hat", "", None, "héé  the\n\nthe"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = bpe.train(bpe.pretoken_counts(df, specials=["<|endoftext|>"]), 290, ["<|endoftext|>"])
    ids = {b: i for i, b in tokenizer.vocab.items()}

    def plain(text):
        out = []
        for piece in regex.split(r"(<\|endoftext\|>)", text):
            if piece == "<|endoftext|>":
                out.append(ids[piece.encode()])
                continue
            for word in regex.findall(bpe.PATTERN, piece):
                t = [bytes([b]) for b in word.encode()]
                for pair in tokenizer.merges:
                    t = bpe.merge_once(t, pair)
                out += [ids[x] for x in t]
        return out

    for _ in range(2):
        assert {r["doc_id"]: r["ids"] for r in bpe.encode(df.repartition(3), tokenizer).collect()} == {i: plain(t or "") for i, t in enumerate(texts)}


def test_memory_and_peaks(spark):
    events = spark.createDataFrame([(0, 0, "a", 10), (0, 1, "b", 25), (1, 0, "a", 12), (1, 1, "b", 13)], "rank int, at int, event string, bytes long").withColumn("run", F.lit(1))
    assert {(r["event"], r["bytes"], r["delta"]) for r in runs.memory_deltas(events, ["run"]).collect()} == {("a", 12, 12), ("b", 25, 15)}


def test_positions_are_added(spark):
    assert spark.createDataFrame([([1.0, 2.0], [0.5, -2.0])], "a array<double>, b array<double>").select(vectors.add(F.col("a"), F.col("b")).alias("c")).first()["c"] == [1.5, 0.0]


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from textloom import session

    class Context:
        master = "spark://head:7077"

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())
    assert session.shared_dir(spark)


def test_discarded_tables_are_gone(spark):
    from textloom.session import discard, materialize

    df = materialize(spark.range(5), "gone")
    folder = df._textloom_path.removeprefix("file://")
    assert os.path.isdir(folder)
    discard(df, None, spark.range(1))
    assert not os.path.isdir(folder)


def test_merges_in_batches_equal_single_ones(spark):
    """Several merges a job give what one a job gives, ties and self-pairs included."""
    rng = random.Random(9)
    table = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))): rng.randint(1, 4) for _ in range(60)}
    counts = spark.createDataFrame(list(table.items()), "pretoken string, n long")
    assert bpe.train_distributed(counts, 25, every=4) == bpe.train_local({w.encode(): n for w, n in table.items()}, 25)
    assert bpe.safe_merges([("a", "b", 9), ("c", "d", 8), ("e", "f", 7), ("b", "c", 7), ("g", "h", 6)]) == [("a", "b"), ("c", "d")]
    assert bpe.safe_merges([("a", "a", 5)]) == [("a", "a")] and bpe.safe_merges([]) == []


def test_token_parts_stream(tmp_path):
    ids = np.arange(1000, dtype="<u2")
    np.save(tmp_path / "a.npy", ids)
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    for name, npy in (("a.npy", True), ("a.bin", False)):
        parts = list(token_files.stream(str(tmp_path / name), "<u2", npy, block=300))
        assert [len(p) for p in parts] == [300, 300, 300, 100] and np.array_equal(np.concatenate(parts), ids)
    (tmp_path / "b.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="whole number"):
        list(token_files.stream(str(tmp_path / "b.bin"), "<u2", False))
