"""n-gram join, packing and mixing against plain versions."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parity import oracle_rows, rows_of
from textloom.llm import mixing, ngram_join, packing, queries
from textloom.llm.encoding import default_path, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "clash") for i, t, s in rows], SCHEMA)


def brute_components(rows, n=3, num=90, den=100):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and den * both >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def components_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}


def test_join_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.randint(40, 90))
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(1, None), (2, " \n\t"), (4, "one"), (5, "ONE"), (7, "one two"), (8, "one  two\n"), (10, "ÄB c d"), (11, "äb c d"), (13, "x y z q"), (14, "word " * 30000)]
    df = frame(spark, [(i, t, "s") for i, t in rows])
    assert components_of(df) == brute_components(rows)


def test_join_of_a_chain(spark):
    """Neighbours link and the ends don't: one component all the same, in any layout."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(f"new{k}x{j}" if j < 3 * k else base[j] for j in range(200))) for k in range(8)]
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) < 8
    for parts in (1, 5):
        assert components_of(frame(spark, [(i, t, "s") for i, t in rows]).repartition(parts)) == want


def test_join_large_group_of_near_copies(spark, monkeypatch):
    """Every member differs in its own word; stars link them all, also with hot n-grams dealt in shares."""
    monkeypatch.setattr(ngram_join, "HOT_LEVEL", 3)
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*base[:60], f"own{k}", *base[61:]])) for k in range(150)]
    found = components_of(frame(spark, [(i, t, "s") for i, t in rows]))
    assert set(found.values()) == {(118, 0)}


def mosaics(rng, n):
    """Documents made of passages that many share: large groups whose members mostly don't link."""
    passages = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(9)]
    rows = []
    for i in range(n):
        some = rng.sample(passages, 5)
        rows.append((i, " ".join([*some, *(f"own{i}x{j}" for j in range(rng.choice((0, 1, 2))))])))
    return rows


def test_join_in_small_pieces(spark, monkeypatch):
    """Chunks, parts, rare n-grams and shares of any size give one result, that of brute force."""
    rng = random.Random(11)
    rows = mosaics(rng, 90)
    base = [f"w{i}" for i in range(60)]
    rows += [(200 + k, " ".join([*base[:30], f"own{k}", *base[31:]])) for k in range(40)]
    rows += [(300 + k, " ".join(f"only{k}x{j}" for j in range(50)) + " " + " ".join(base[:20])) for k in range(20)]
    rows += [(400 + k, rows[k][1].upper()) for k in range(0, 90, 9)]
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 30
    df = frame(spark, [(i, t, "s") for i, t in rows])
    assert components_of(df.repartition(3)) == want
    for name, value in (("CHUNK", 64), ("PART", 500), ("RARE", 2), ("HOT_LEVEL", 2), ("GROWTH", 2), ("TOLD", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    assert components_of(df.repartition(5)) == want


def test_join_of_mosaics_at_the_stage_threshold(spark):
    rng = random.Random(12)
    rows = mosaics(rng, 70)
    spec = ngram_join.JoinSpec(n=5, num=80, den=100)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, [(i, t, "s") for i, t in rows]), spec).collect()}
    assert found == brute_components(rows, 5, 80, 100)


def test_unlinked_groups_end(spark, monkeypatch):
    """A group whose members never link loses its centres and ends; no pair is tried twice."""
    tried = []
    call = ngram_join._Verifier.__call__

    def watched(self, pairs):
        tried.extend((r["a"], r["b"]) for r in pairs.collect())
        return call(self, pairs)

    monkeypatch.setattr(ngram_join._Verifier, "__call__", watched)
    shared = [" ".join(f"s{k}w{j}" for j in range(6)) for k in range(6)]
    rng = random.Random(1)
    rows = []
    for i in range(60):
        rng.shuffle(shared)
        rows.append((i, " ".join(shared[:4])))
    df = frame(spark, [(i, t, "s") for i, t in rows])
    assert components_of(df) == brute_components(rows)
    assert len(tried) == len(set(tried))


def test_join_rows_that_share_an_id(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = frame(spark, [(5, one, "s"), (5, two, "s"), (3, one, "s"), (9, two, "s")])
    found = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect())
    assert found == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_join_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = frame(spark, [(3, text, "s"), (3, text, "s"), (2, text, "s"), (None, text, "s")])
    found = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()), key=str)
    assert found == [(2, 2), (3, 2), (3, 2), (None, None)]


def test_join_empty_table(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    assert rows_of(queries.queries()[name](spark, sf)) == oracle_rows(queries.oracle_sql()[name], sf)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit(lengths):
    plan = packing.plan(Counter(lengths), 20)
    assert plan.sequences == best_fit_decreasing(lengths, 20)
    assert plan.sequences >= -(-sum(lengths) // 20)


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (2048, [(0, 2048)]), (2049, [(0, 1), (1, 2048)]), (5000, [(0, 904), (904, 2048), (2952, 2048)])])
def test_cut(n, want):
    assert packing.cut(n) == want


def check_packing(rows, texts, capacity):
    enc = encoder(default_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, parts in by_doc.items():
        ids = [*enc.tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in parts] == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
        for r in parts:
            data = b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(data)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_best_fit_packing(spark, sf).collect()
    used = check_packing(rows, texts, 2048)
    assert used == best_fit_decreasing([r["length"] for r in rows], 2048)


def test_packing_odd_rows(spark):
    texts = {0: None, 1: "", 2: "a b  c", 3: "word " * 50, 4: "<|endoftext|>"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert check_packing(packing.pack(packing.pieces(df, capacity=16), 16).collect(), texts, 16) >= 3
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0
    twice = packing.pack(packing.pieces(df.union(df), capacity=16), 16)
    assert twice.count() == 2 * packing.pieces(df, capacity=16).count()
    named = packing.pack(packing.pieces(df).selectExpr("*", "'x' as sequence_id", "1 as _rank"))
    assert named.select("sequence_id").distinct().count() == 1


def plain_targets(sizes, weights, budget=1.5, most=2):
    left, out, open_ = budget * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = {i for i in open_ if share[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    found = mixing.targets(sizes, weights)
    assert found == pytest.approx(plain_targets(sizes, weights))
    assert all(t <= 2 * s + 1e-6 for t, s in zip(found, sizes))
    assert sum(found) == pytest.approx(1.5 * sum(sizes))


def test_mixing_query(spark, sf):
    rows = queries.op9_source_mixing(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    sources = sorted({r["source"] for r in docs.values()})
    sizes = [sum(len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs.values() if d["source"] == s) for s in sources]
    goals = dict(zip(sources, plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])))
    taken = Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"]))
        assert r["target"] == pytest.approx(goals[d["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[d["source"]] += r["taken"]
    for s, t in goals.items():
        assert taken[s] == pytest.approx(t, rel=0.01, abs=20)


def test_mixing_layout_nulls_and_repeats(spark):
    rows = [(i % 40, " ".join(["w"] * (i % 9)) if i % 11 else None, (None, "b", "a", "c")[i % 4]) for i in range(200)]
    df = frame(spark, rows)
    found = [sorted(map(tuple, mixing.taken(df.repartition(k)).select("doc_id", "size", "source_size", "target", "taken").collect())) for k in (1, 6)]
    assert found[0] == found[1] and len(found[0]) == 200
    assert mixing.taken(df.limit(0)).count() == 0
    assert mixing.taken(frame(spark, [(1, None, "a"), (2, " ", None)])).agg({"taken": "sum"}).first()[0] == 0


def test_schedule_is_even(spark):
    """Any run of slots is close to the targets."""
    df = frame(spark, [(i, "w " * 50, "abc"[i % 3]) for i in range(300)])
    line, pieces = mixing.mix(df)
    rows = pieces.select("slot", "src").distinct().orderBy("slot").collect()
    half = [r["src"] for r in rows if r["slot"] < len(rows) // 2]
    goals = {r["src"]: r["target"] for r in line.select("src", "target").distinct().collect()}
    for src, goal in goals.items():
        assert half.count(src) / len(half) == pytest.approx(goal / sum(goals.values()), abs=0.01)


def test_steps_are_best_fit(spark, monkeypatch):
    """The steps' jobs place every piece, gaplessly, in as many sequences as best fit with decreasing lengths; nothing is planned elsewhere."""
    monkeypatch.setattr(packing, "plan", None)
    rng = random.Random(6)
    for capacity, most, n in ((64, 64, 900), (100, 40, 700), (7, 7, 300), (33, 3, 200)):
        lengths = [rng.randint(1, rng.randint(1, most)) for _ in range(n)]
        df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lengths)], "id long, length long, _rank string").repartition(5)
        rows = packing.pack(df, capacity).collect()
        assert sorted(r["id"] for r in rows) == list(range(n)) and {r["_rank"] for r in rows} == {"clash"}
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) == best_fit_decreasing(lengths, capacity)


def test_packing_long_text_and_clashes(spark):
    texts = {1: "word " * 60_000, 2: "<|endoftext|> end", 3: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(packing.pieces(df).selectExpr("*", "1 as _task", "2 as Offset", "3 as `_n`"))
    assert set(rows.columns) >= {"_task", "_n", "sequence_id", "offset"} and "Offset" not in rows.columns
    check_packing(rows.collect(), texts, 2048)


def plain_taken(rows, budget=1.5):
    """The schedule written out: slots by golden-ratio points, blocks of each source's line in order. Rows: (rid, doc_id, source, size, chance)."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[3] for r in rows if r[2] == s) for s in sources]
    goals = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], budget)
    units = [int(g * mixing.UNITS + 0.5) for g in goals]
    total, block = sum(units), mixing.block_words(sum(units) / mixing.UNITS)
    edges = [sum(units[:i]) for i in range(len(units) + 1)]
    lines = {}
    for i, s in enumerate(sources):
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (r[4] % (1 << 64), r[1] is not None, r[1] or 0, r[0]))
        lines[i] = [r[0] for r in mine for _ in range(r[3])]
    taken, used = Counter(), Counter()
    for slot in range(-(-total // (mixing.UNITS * block))):
        point = slot * mixing.GOLDEN % mixing.RING
        src = next(i for i in range(len(units)) if edges[i] / total * mixing.RING <= point < edges[i + 1] / total * mixing.RING)
        k = used[src]
        used[src] += 1
        for at in range(k * block, (k + 1) * block):
            if at < 2 * len(lines[src]):
                taken[lines[src][at % len(lines[src])]] += 1
    return taken


@pytest.mark.parametrize("sources", [1, 4, 45])
def test_mixing_equals_the_plain_schedule(spark, monkeypatch, sources):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 100)
    monkeypatch.setattr(mixing, "SLOT_BITS", 4)
    rng = random.Random(sources)
    rows = [(i // 2, " ".join(["w"] * rng.choice((0, 1, 5, 40, 300))), rng.choice([None, *(f"s{k}" for k in range(sources - 1))])) for i in range(160)]
    F = mixing.F
    df = frame(spark, rows).repartition(3)
    df = spark.createDataFrame(df.withColumn("row", F.monotonically_increasing_id()).selectExpr("doc_id", "text", "source", "row as size", "'x' as rid", "'y' as src", "'z' as taken").collect(), "doc_id long, text string, source string, size long, rid string, src string, taken string").coalesce(1)
    plain = df.select(F.monotonically_increasing_id(), "doc_id", "source", mixing.word_count(), F.xxhash64(F.lit(0), "doc_id", F.xxhash64("text"))).collect()
    want = plain_taken([tuple(r) for r in plain])
    found = mixing.taken(df)
    assert Counter({r["rid"]: r["taken"] for r in found.collect() if r["taken"]}) == want
    assert found.count() == len(rows) and sum(want.values()) > 0
