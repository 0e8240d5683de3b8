"""Results on odd rows, and work that has to stay in bounds."""

import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from textloom.functions import pii
from textloom.operators import bpe, dedup, model_math


def test_signatures_hash_all_seeds_of_many_grams_at_once():
    """half a million n-grams in seconds, and the values of single ones."""
    lists = pa.array([[f"word {k} and {j} of a gram" for k in range(500)] for j in range(1000)] + [[], None, ["", "a", "é" * 40]])
    seeds = np.arange(20, dtype=np.uint64)
    begin = time.perf_counter()
    found = dedup._least_hashes(lists, seeds)
    assert time.perf_counter() - begin < 15
    for k in (0, 999, 1000, 1001, 1002):
        single = [dedup.murmur_low(g.encode(), seeds) for g in lists[k].as_py() or []]
        assert (found[k] == np.min([np.full(20, 2**64 - 1, np.uint64), *single], axis=0)).all()


def test_block_attention_keeps_later_keys_out(spark):
    """a later key that isn't finite changes nothing for the queries before it in its block."""
    v = np.linspace(-1, 1, 24).reshape(6, 4)
    v[3, 1], v[4, 2] = np.nan, np.inf
    rows = spark.createDataFrame([(0, p, *[x.tolist()] * 3) for p, x in enumerate(v)], "seq int, pos long, q array<double>, k array<double>, v array<double>")
    found = {r["pos"]: (r["lse"], r["out"]) for r in model_math.block_attention(rows, ["seq"]).collect()}
    for p in range(3):
        s = v[: p + 1] @ v[p] / 2
        w = np.exp(s - s.max())
        assert found[p][0] == pytest.approx(s.max() + np.log(w.sum())) and found[p][1] == pytest.approx(w @ v[: p + 1] / w.sum())
    assert np.isnan(found[3][1]).all() and np.isnan(found[5][1]).all()


def test_emails_beside_letters_of_other_scripts(spark, tmp_path):
    """F4 to F6: a letter outside ASCII is no part of an address, as in the SQL."""
    texts = ["éabc@x.com", "ab@x.comé", "联系ab@x.com", "a@b.cóm a@b.org", "x_a@b.com_", "a@b.com1 .a@b.com", "ªb@x.com"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/documents")
    found = sorted(tuple(r) for r in pii.mask_all(df).select("doc_id", "masked", "emails", "phones", "ips").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert found == con.sql(f"WITH {pii.mask_all_sql('documents')} SELECT doc_id, masked, emails, phones, ips FROM masked_ips ORDER BY doc_id").fetchall()
    assert found[0][1:3] == ("é|||EMAIL_ADDRESS|||", 1)


def test_training_stores_blocks_and_pairs_only(spark, monkeypatch):
    """F2, F7 to F9, F19: no table of the training has a row per word and pair, whatever the merges change."""
    counts = spark.createDataFrame([(f"the{k}then", 1 + k % 7) for k in range(3000)], "pretoken string, n long").coalesce(2)
    sizes, write = [], bpe.materialize
    monkeypatch.setattr(bpe, "materialize", lambda df, name: (out := write(df, name), sizes.append(out.count()))[0])
    found = bpe.train_distributed(counts, 6)
    assert found == bpe.train_local({r["pretoken"].encode(): r["n"] for r in counts.collect()}, 6)
    assert max(sizes) < 1000


def test_attention_of_short_sequences_shuffles_rows_once(spark, sf):
    """no pair of rows is shuffled, and a hidden key that isn't finite is no term."""
    from textloom.plans import registry

    for name in ("causal_attention", "masked_attention", "attention_gradients"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, name
    v = np.linspace(-1, 1, 24).reshape(6, 4)
    v[4, 1] = np.nan
    rows = spark.createDataFrame([(0, p, x.tolist()) for p, x in enumerate(v)] + [(0, 9, None)], "seq int, id long, v array<double>")
    found = {(r["qid"], r["head"]): r["out"] for r in model_math.sequence_attention(rows, ["seq"], lambda q, k: k <= q, 2).collect()}
    assert len(found) == 12 and np.isnan(found[5, 0]).all() and not np.isnan(found[5, 1]).any()
    assert not any(np.isnan(found[p, h]).any() for p in range(4) for h in (0, 1))
