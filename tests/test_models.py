"""Linear models over character n-grams, and registered domains by long suffix lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import url
from textloom.operators import linear
from textloom.plans import classify as plans


def plain_features(text, bits):
    """Counts of all n-grams by bucket, one text and one n-gram at a time."""
    from collections import Counter

    counts, mask = Counter(), 2**64 - 1
    odd = int(linear._ODD)
    text = (text or "").lower()
    for i in range(len(text)):
        h = 0
        for n in range(1, max(linear.ORDERS) + 1):
            if i + n > len(text):
                break
            x = (h * odd + ord(text[i + n - 1]) + n) & mask
            x = (x ^ (x >> 32)) * odd & mask
            h = x ^ (x >> 29)
            counts[h >> (64 - bits)] += 1
    return counts


def test_features(monkeypatch):
    """Texts of all kinds, in groups of few characters and of many, against the plain way."""
    texts = ["Ab ab", None, "", "x", "éÉ字\U0001f600", "word " * 300, "zz"]
    for group in (1, 50, 1 << 18):
        monkeypatch.setattr(linear, "GROUP_CHARS", group)
        found = list(linear.features(texts, bits=10))
        assert len(found) == len(texts)
        for t, (bucket, value) in zip(texts, found):
            want = plain_features(t, 10)
            assert bucket.tolist() == sorted(want)
            norm = sum(want.values()) ** 0.5
            assert value.tolist() == pytest.approx([want[b] ** 0.5 / norm for b in sorted(want)])


def test_gradient_is_that_of_all_rows(spark):
    """The same model in any layout, up to rounding; labels by name; texts without features get the labels' shares."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["der", "und", "nicht"] if k % 3 else ["the", "and", "not"]) for _ in range(12)) if k % 10 else None, "de" if k % 3 else "en") for k in range(90)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, label string, Score string")
    models = [linear.train(df.repartition(k), df.select("doc_id", "label"), steps=8, bits=10) for k in (1, 6)]
    assert models[0].labels == ["de", "en"] and np.allclose(models[0].weights, models[1].weights, atol=1e-6)
    found = linear.classify(df, models[0]).collect()
    assert linear.classify(df, models[0]).columns == ["doc_id", "label", "score"]
    for r in found:
        text, label = rows[r["doc_id"]][1:]
        assert 0.5 <= r["score"] <= 1 and (r["label"] == label if text else r["label"] == "de" and r["score"] < 0.9)
    with pytest.raises(ValueError, match="labels"):
        linear.train(df, df.select("doc_id", F.lit(None).cast("string").alias("label")))


def test_held_out_languages(spark):
    out = plans.QUERIES["lang_ngram_model_eval"][0](spark, "/root/testdata/sf0.01").collect()
    right, every = sum(r["n"] for r in out if r["label"] == r["predicted"]), sum(r["n"] for r in out)
    assert every == 200 and right >= 0.95 * every


def test_held_out_quality_and_harm(spark):
    """Better than the majority label of what is held out."""
    for name in ("quality_ngram_model_eval", "toxic_ngram_model_eval"):
        out = plans.QUERIES[name][0](spark, "/root/testdata/sf0.01").collect()
        by = {}
        for r in out:
            by[r["label"]] = by.get(r["label"], 0) + r["n"]
        right = sum(r["n"] for r in out if r["label"] == r["predicted"])
        assert len(by) == 2 and right >= max(by.values()), (name, out)


def plain_domain(host, rules):
    labels = host.split(".")
    best, exception = 1, None
    for k in range(1, len(labels) + 1):
        tail = ".".join(labels[-k:])
        kind = rules.get(tail)
        if kind == "plain":
            best = max(best, k)
        if kind == "wildcard" and k < len(labels):
            best = max(best, k + 1)
        if kind == "exception":
            exception = k - 1
    best = exception if exception is not None else best
    return ".".join(labels[-(best + 1) :])


def test_a_list_of_ten_thousand_suffixes(spark):
    """Plain, wildcard and exception rules of several depths, against a plain matcher."""
    rng = random.Random(9)
    parts = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    lines = [f"{x}.{y}" for x in parts for y in parts[:90]] + parts + [f"*.{x}.zz" for x in parts] + [f"!{x}.{y}.zz" for x in parts[:30] for y in parts[:20]] + [f"{x}.{y}.{z}" for x in parts[:9] for y in parts[:9] for z in parts[:5]]
    rules = url.parse_suffixes(lines)
    assert len(rules) > 10_000
    hosts = [".".join(rng.choice([*parts, "www", "shop"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", ".zz", f".{rng.choice(parts)}"]) for _ in range(3000)]
    df = spark.createDataFrame([(h, f"http://{h}/x") for h in hosts], "host string, url string")
    found = df.select("host", url.registered_domain(F.col("url"), rules).alias("domain")).collect()
    assert [r["domain"] for r in found] == [plain_domain(h, rules) for h in hosts]


def test_links_join_what_all_pairs_join(spark):
    """Mosaics of shared passages, groups of near copies and chains: clusters by links are those by all pairs."""
    from textloom.operators import dedup
    from textloom.operators.components import components

    rng = random.Random(11)
    passages = [[f"p{k}w{j}" for j in range(25)] for k in range(6)]
    rows = []
    for g in range(8):
        base = sum(rng.sample(passages, 3), []) + [f"g{g}w{j}" for j in range(20)]
        for _ in range(rng.randint(1, 25)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grams = dedup.gram_rows(df, 5)
    pairs = dedup.jaccard_pairs(grams)
    links = dedup.jaccard_links(grams)
    assert {tuple(r) for r in links.select("l", "r").collect()} <= {tuple(r) for r in pairs.select("l", "r").collect()}
    found = [{r["node"]: r["label"] for r in components(x.select(F.col("l").alias("a"), F.col("r").alias("b"))).collect()} for x in (pairs, links)]
    assert found[0] == found[1] and len(set(found[0].values())) > 3
    assert links.count() < pairs.count()


def test_line_removal_over_files_in_blocks(spark, tmp_path):
    """Files of several blocks, of all three terminators, compressed, empty, and with and without a last one: the lines in their order."""
    import gzip
    from collections import Counter

    from textloom.operators import dedup

    rng = random.Random(5)
    texts = {}
    for k in range(4):
        lines = [rng.choice([f"line {rng.randrange(40)}", f"own {k} {j}", "", f"é {rng.randrange(300)}"]) for j in range(400)]
        texts[f"f{k}.txt"] = "\n".join(lines) + ("\n" if k % 2 else "")
    texts |= {"crlf.txt": "a\r\nb\rown c\r\n", "z.txt.gz": "b\nlast", "empty.txt": "", "y.txt": "a\nlast\n", "x.txt": "own c"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        data = text.encode()
        (tmp_path / "in" / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    cut = {name: [x + "\n" for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")] for name, text in texts.items()}
    for name, lines in cut.items():
        lines[-1] = lines[-1][:-1]
        if not lines[-1]:
            lines.pop()
    counts = Counter(x for lines in cut.values() for x in lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = dedup.dedup_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, lines in cut.items():
        assert (tmp_path / "out" / name).read_bytes().decode() == "".join(x for x in lines if counts[x] == 1), name
    assert {r["file"]: r["lines"] for r in rows.collect()} == {name: sum(counts[x] == 1 for x in lines) for name, lines in cut.items()}


def test_masks_know_digits_of_all_scripts(spark):
    """Digits count as such in any script, inside a number and beside it."""
    from textloom.functions import pii

    texts = ["call ٣٢١-٦٥٤-٩٨٧٠ now", "at １９２.１６８.1.２", "٣321-654-9870", "id 321-654-98701"]
    df = pii.mask_all(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    found = [(r["phones"], r["ips"], r["masked"]) for r in df.orderBy("doc_id").collect()]
    assert found[0] == (1, 0, "call |||PHONE_NUMBER||| now")
    assert found[2] == (0, 0, texts[2]) and found[3] == (0, 0, texts[3])
    assert pii.MASKS[2].pattern.count(r"\d") >= 4


@pytest.mark.parametrize(
    ("text", "seed", "low"),
    [("", 0, 0), ("hello", 0, 0xCBD8A7B341BD9B02), ("hello, world", 0, 0x342FAC623A5EBC8E), ("19 Jan 2038 at 3:14:07 AM", 0, 0xB89E5988B737AFFC), ("The quick brown fox jumps over the lazy dog.", 0, 0xCD99481F9EE902C9), ("hello", 1, 0xA78DDFF5ADAE8D10)],
)
def test_published_values_of_murmur(text, seed, low):
    from textloom.operators import dedup

    assert int(dedup.murmur_low(text.encode(), np.array([seed], np.uint64))[0]) == low
