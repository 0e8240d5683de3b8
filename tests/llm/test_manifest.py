"""Merkle manifest, sharding and whitening against plain versions."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parity import oracle_rows, rows_of
from textloom.llm import merkle, queries, ranges, sharding, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and the siblings' digests of each leaf with their sides."""
    steps, owners, level = [[] for _ in leaves], [[k] for k in range(len(leaves))], list(leaves)
    while len(level) > 1:
        above, over = [], []
        for k in range(0, len(level), 2):
            pair = level[k : k + 2]
            for x in owners[k]:
                steps[x].append((1, pair[1]) if len(pair) == 2 else (0, ""))
            if len(pair) == 2:
                for x in owners[k + 1]:
                    steps[x].append((-1, pair[0]))
            above.append(h(*pair))
            over.append([x for o in owners[k : k + 2] for x in o])
        level, owners = above, over
    return level[0], steps


def plain_field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_manifest(rows):
    """Rows of the query from ``doc_id, text, lang, source, n_chars``."""

    def leaf(r, more=0):
        doc_id, text, lang, source, n = r
        return h(*map(plain_field, (doc_id, source, lang, None if n is None else n + more, text)))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in groups[g]])
    root, over = plain_tree([trees[g][0] for g in langs])
    out = []
    for g, up in zip(langs, over, strict=True):
        for r, steps in zip(groups[g], trees[g][1], strict=True):
            path = steps + up
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, 1 if touched else 0)
            for side, other in path:
                folded = h(other, folded) if side < 0 else h(folded, other)
            out.append((r[0], folded, leaf(r), h(*(x for _, x in path)), root, trees[g][0], folded == root))
    return sorted(out, key=repr)


def manifest(spark, rows, monkeypatch, tmp_path, extra=""):
    df = spark.createDataFrame([(*r, *(["clash"] if extra else [])) for r in rows], DOCS + extra)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return rows_of(queries.op11_merkle_manifest(spark, "here"))[1]


def some_rows(n, seed=0):
    rng = random.Random(seed)
    return [(k * 3, "text " * rng.randint(0, 5), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", None]), rng.choice([k, None])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 257])
def test_manifest(spark, monkeypatch, tmp_path, n):
    rows = some_rows(n)
    assert manifest(spark, rows, monkeypatch, tmp_path) == plain_manifest(rows)


def test_manifest_in_many_rounds(spark, monkeypatch, tmp_path):
    """Ranges of a few rows and blocks of two ranges: subtrees end everywhere, and blocks meet in several rounds."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 5)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 1)
    monkeypatch.setattr(merkle, "PROOF_ROWS", 4)
    rows = some_rows(203, 1)
    assert manifest(spark, rows, monkeypatch, tmp_path) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark, monkeypatch, tmp_path):
    """Nulls, an empty and a long text, repeated ids and rows, many groups of one, clashing names, the largest number."""
    rows = [(None, None, None, None, None), (5, "", "", "", 0), (7, "ü" * 70_000, "é", "s", 1), (7, "other", "é", "s", 2), (9, "x", "en", "s", 2**63 - 1), (14, "x", "en", "s", 2**63 - 1)]
    rows += [(11, "same", "en", "s", 4)] * 9 + [(100 + k, "x", f"lang{k}", None, k) for k in range(40)]
    assert manifest(spark, rows, monkeypatch, tmp_path, ", `group` string") == plain_manifest(rows)


def test_manifest_of_nothing(spark, monkeypatch, tmp_path):
    assert manifest(spark, [], monkeypatch, tmp_path) == []


def test_proofs_are_the_rows_own(spark):
    """A proof fits its leaf and no other; names like the operator's own pass through."""
    df = spark.createDataFrame([(k, "x" * k, "en", None, k, k, "p") for k in range(20)], DOCS + ", `index` long, `part` string")
    leaves = df.withColumn("leaf", merkle.leaf_digest(*map(F.col, merkle.FIELDS)))
    proved = merkle.prove(leaves, "lang", ["doc_id"])
    assert proved.columns == [*leaves.columns, "proof", "subroot", "root"]
    assert merkle.verify(proved, F.col("leaf")).where("verified and index = doc_id and part = 'p'").count() == 20
    assert merkle.verify(proved, F.unhex(F.lit("00" * 32))).where("verified").count() == 0


def test_manifest_query(spark, sf):
    assert rows_of(queries.op11_merkle_manifest(spark, sf)) == oracle_rows(merkle.oracle(), sf)


def plain_jump(key, shards):
    """The published loop."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 2**60 - 1), min_size=1, max_size=30), st.integers(1, 5000))
def test_jump(keys, shards):
    found = sharding.jump(np.array(keys, np.int64), shards)
    assert found.tolist() == [plain_jump(k % 2**64, shards) for k in keys]
    grown = sharding.jump(np.array(keys, np.int64), shards + 1)
    assert all(g in (f, shards) for f, g in zip(found.tolist(), grown.tolist()))


def test_jump_moves_its_share():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 40_000)
    before, after = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert (before != after).mean() == pytest.approx(1 / 41, rel=0.15)
    assert max(np.bincount(before)) < 1.15 * 1000


def test_sharding_query(spark, sf):
    assert rows_of(queries.op13_jump_sharding(spark, sf)) == oracle_rows(sharding.oracle(), sf)


def shard_rows(spark, rows, tmp_path, shards=5, schema="doc_id long, text string, shard string, `at.part` long"):
    df = spark.createDataFrame(rows, schema)
    sharding.write(df, f"file://{tmp_path}/s", shards=shards)
    return df, sharding.read(spark, f"file://{tmp_path}/s", df.schema).collect()


def test_shards_of_odd_rows(spark, tmp_path, monkeypatch):
    """Rows of a repeated key share a shard and are split over files; clashing names, nulls and long texts come back as they were."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 8)
    rows = [(None, None, "a", 1), (None, "", None, None), (1, "ü" * 100_000, "b", 2)] + [(7, "same", "x", 3)] * 60 + [(k, f"t{k}", "y", k) for k in range(10, 60)]
    df, found = shard_rows(spark, rows, tmp_path)
    assert Counter(tuple(r["row"]) for r in found) == Counter(rows)
    for r in found:
        key = -1 if r["row"]["doc_id"] is None else int(__import__("hashlib").md5(str(r["row"]["doc_id"]).encode()).hexdigest()[:15], 16)
        assert r["shard"] == plain_jump(key % 2**64, 5)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append((r["slot"], r["row"]["doc_id"]))
    for own in slots.values():
        own.sort(key=lambda x: x[0])
        assert [s for s, _ in own] == list(range(len(own)))
        ids = [-1 if d is None else d for _, d in own]
        assert ids == sorted(ids)
    moved = sharding.moves(df, "doc_id", 5, 6).select("to_shard").distinct().collect()
    assert {r[0] for r in moved} <= {5}


def test_shards_of_nothing(spark, tmp_path):
    assert shard_rows(spark, [], tmp_path)[1] == []


def test_a_shard_is_needed(spark):
    with pytest.raises(ValueError, match="shard"):
        sharding.shard_of(F.lit(1), 0)


VECTORS = "vec_id long, embedding array<double>, whitened string"


def plain_whitening(rows, components=4):
    """Rows' deviations and whitened values (up to sign), shares and identity error, with numpy over everything at once."""
    dim = max((len(v) for _, v in rows), default=0)
    xs = {i: tuple(math.floor(256 * c) for c in v) + (0,) * (dim - len(v)) for i, v in rows}
    fit = np.array(sorted(set(xs.values())), float).reshape(-1, dim)
    n, total = len(fit), [sum(v[d] for v in set(xs.values())) for d in range(dim)]
    centred = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in xs.items():
        out[i] = (sum((n * a - s) ** 2 for a, s in zip(x, total)), np.abs((np.array(x) - fit.mean(0)) @ vectors) / np.sqrt(values))
    return n, out, values / np.trace(centred.T @ centred / n)


def whitened_rows(spark, rows, monkeypatch, schema=VECTORS, parts=5):
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema).repartition(parts)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    out = {}
    for r in queries.op12_embedding_whitening(spark, "here").collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening(spark, monkeypatch, parts):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2] + 40).tolist()) for k in range(200)]
    rows += [(1000 + k, rows[7][1]) for k in range(150)]  # copies count once
    found = whitened_rows(spark, rows, monkeypatch, parts=parts)
    n, want, shares = plain_whitening(rows)
    assert set(found) == set(want) and n == 200
    signs = {c: {np.sign(found[i][c]["whitened"] - found[7][c]["whitened"]) for i in (1000, 1100)} for c in (1, 2, 3, 4)}
    assert all(s == {0} for s in signs.values())
    for i, by in found.items():
        assert sorted(by) == [1, 2, 3, 4]
        for c, r in by.items():
            assert r["n"] == n and r["deviation"] == want[i][0]
            assert abs(r["whitened"]) == pytest.approx(want[i][1][c - 1], rel=1e-8, abs=1e-9)
            assert r["explained"] == pytest.approx(shares[c - 1], rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_query(spark, sf):
    """Every vector of the table against numpy over all of them."""
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, want, shares = plain_whitening(rows)
    found = queries.op12_embedding_whitening(spark, sf).collect()
    assert len(found) == 4 * len(rows)
    for r in found:
        deviation, values = want[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(values[r["component"] - 1], rel=1e-6, abs=1e-7)
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-8) and r["identity_error"] < 1e-8


def test_whitening_of_odd_rows(spark, monkeypatch):
    """Unsound vectors go; short ones are filled up; huge entries saturate; sums stay exact."""
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [0.0, -inf])]
    good = [(10, []), (11, [0.5]), (12, [-0.001, 3.0]), (13, [-0.0, 3.0]), (14, [2.0, -7.0])]
    found = whitened_rows(spark, bad + good, monkeypatch)
    n, want, _ = plain_whitening(good, 2)
    assert set(found) == {i for i, _ in good} and n == 5
    assert all(by[c]["deviation"] == want[i][0] and len(by) == 2 for i, by in found.items() for c in by)
    huge = whitened_rows(spark, [(1, [1e300]), (2, [-1e300]), (3, [0.0])], monkeypatch)
    assert set(huge) == {1, 2, 3} and huge[3][1]["deviation"] is not None and huge[1][1]["deviation"] is None


def test_whitening_without_variance(spark, monkeypatch):
    assert whitened_rows(spark, [], monkeypatch) == {}
    assert whitened_rows(spark, [(1, None)], monkeypatch) == {}
    for rows in ([(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)]):
        found = whitened_rows(spark, rows, monkeypatch)
        assert len(found) == len(rows) and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for by in found.values() for r in by.values()} == {(0.0, 0.0, 0.0, 0)}
    line = whitened_rows(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(6)], monkeypatch)
    assert {c: line[0][c]["explained"] > 0.5 for c in line[0]} == {1: True, 2: False, 3: False}
    assert line[0][2]["whitened"] == 0 and line[0][1]["identity_error"] < 1e-9


def test_merged_moments():
    """Merging in any grouping gives the moments of all rows; sums are exact beyond 64 bits."""
    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, (300, 4)) + 10**9
    whole = whitening.Moments.of(x)
    for cuts in ([50], [1, 2, 299], [0, 100, 100, 200]):
        state = whitening.Moments.none(4)
        for part in np.split(x, cuts):
            state = whitening.merge(state, whitening.Moments.of(part) if len(part) else whitening.Moments.none(4))
        assert state.total == whole.total and np.allclose(state.scatter, whole.scatter, rtol=1e-9) and np.allclose(state.mean, whole.mean, rtol=1e-14)
    large = np.full((3, 1), 2**62, np.int64)
    assert whitening.Moments.of(large).total == [3 * 2**62]
    assert [int(v.as_py()) for v in whitening.deviations(np.array([[5, -3]]), 10**12, [7, 11])] == [(5 * 10**12 - 7) ** 2 + (-3 * 10**12 - 11) ** 2]


def test_media_with_names_in_other_cases(spark):
    """Names count as Spark compares them: a clashing one is replaced, whatever its case."""
    from textloom.llm import png_media

    df = spark.createDataFrame([(1, b"abc", "x", "y", "z")], "doc_id long, payload binary, N_Bytes string, MEDIA string, Feature string")
    stored = png_media.store(df, "payload")
    assert stored.columns == ["doc_id", "Feature", "n_bytes", "media"]
    found = png_media.read(stored)
    assert found.columns == ["doc_id", "n_bytes", *png_media.FEATURES.names] and found.first()["n_bytes"] == 3


def test_mixing_of_long_texts_and_clashing_names(spark, monkeypatch):
    """A text far longer than a block is cut by blocks; columns named like the operator's own change nothing; sums in two levels are those in one."""
    from textloom.llm import mixing

    rows = [(k, "w " * (30_000 if k == 5 else k % 7), "ab"[k % 2]) for k in range(120)]
    plain = sorted(map(tuple, mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "size", "source_size", "target", "taken").collect()))
    clash = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], "doc_id long, text string, source string, size long, src long, at long, share long, slot long, over long")
    monkeypatch.setattr(mixing, "OVER_BITS", 1)
    assert plain == sorted(map(tuple, mixing.taken(clash).select("doc_id", "size", "source_size", "target", "taken").collect()))
    by = {}
    for _, size, whole, target, taken in plain:
        assert taken <= 2 * size
        by.setdefault((whole, target), []).append(taken)
    for (_, target), taken in by.items():
        assert sum(taken) == pytest.approx(target, rel=0.02)


def test_token_store_of_equal_rows(spark, monkeypatch):
    """One doc_id whose rows are all equal is more than one file, and nothing is lost."""
    from textloom.llm import token_store
    from textloom.session import new_dir

    monkeypatch.setattr(token_store, "ROWS_PER_ID", 10)
    df = spark.createDataFrame([(7, "the same text")] * 200 + [(None, None)] * 50 + [(9, "other")], "doc_id long, text string")
    folder, merge = new_dir(spark, "tokens"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    assert token_store.write(df, folder).where("docs > 1").count() > 2
    spark.conf.unset(merge)
    found = token_store.read(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None] * 50 + [7] * 200 + [9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
