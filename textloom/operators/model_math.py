"""Model arithmetic that spans rows: attention, its gradient, mergeable log-sum-exp, nucleus filter, clipping, optimizer steps."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions import vectors as V
from textloom.session import lean, ship


def swiglu_rows(rows: DataFrame, v: str, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> DataFrame:
    """``rows`` with W2 (SiLU(W1 x) * W3 x) for ``v``, an ``array<double>``: products of each batch's vectors, the weights go out with the function.

    Sums are over the entries that are there: of null entries and those that a short vector lacks nothing is added, what a long one has beyond the
    weights counts for nothing, and null and empty vectors become null.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(v)
            sizes = np.nan_to_num(own.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x, some = np.zeros((len(sizes), w1.shape[1])), at < w1.shape[1]
            x[row[some], at[some]] = own.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)[some]
            with np.errstate(all="ignore"):
                gate = x @ w1.T
                made = (gate / (1 + np.exp(-gate)) * (x @ w3.T)) @ w2.T
            there = sizes > 0
            ends = np.concatenate([[0], np.cumsum(there * len(w2))]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~there, False)), pa.array(made[there].ravel()))
            yield pa.RecordBatch.from_arrays([out if n == v else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(lean(run), rows.schema)


def heads(rows: DataFrame, n: int, dim: int) -> DataFrame:
    """``head`` beside all other columns, with ``v`` cut into ``n`` parts of ``dim``."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda h: F.slice("v", h * dim + 1, F.lit(dim)))
    return rows.select(*(c for c in rows.columns if c != "v"), F.posexplode(parts).alias("head", "v"))


def scores(q: DataFrame, k: DataFrame, dim: int, by: Sequence[str], causal: bool = True, mask: DataFrame | None = None) -> DataFrame:
    """``qid, kid, s`` beside the columns ``by``: scaled dot products of ``id, v`` rows within a sequence (and head).

    ``by`` names what a sequence is, an equi-join, so the pairs are as many as the sequences' attention matrices hold. Causal: only
    keys up to the query. ``mask`` has ``qid, kid, keep`` (and ``by``); what isn't kept, or not in it, scores minus infinity.
    """
    left, right = q.select(*by, F.col("id").alias("qid"), F.col("v").alias("qv")), k.select(*by, F.col("id").alias("kid"), F.col("v").alias("kv"))
    pairs = left.join(right, list(by))
    pairs = pairs.where("kid <= qid") if causal else pairs
    s = V.dot(F.col("qv"), F.col("kv")) / math.sqrt(dim)
    if mask is not None:
        pairs = pairs.join(mask, [*(c for c in by if c in mask.columns), "qid", "kid"], "left")
        s = F.when(F.col("keep"), s).otherwise(float("-inf"))
    return pairs.select(*by, "qid", "kid", s.alias("s"))


def attention(s: DataFrame, values: DataFrame, by: Sequence[str]) -> DataFrame:
    """``qid, lse, out``: softmax over the keys of each query times the values, in two aggregates; not a number where all keys are masked."""
    own = [*by, "qid"]
    top = s.groupBy(*own).agg(F.max("s").alias("m"))
    z = s.join(top, own).groupBy(*own, "m").agg(F.sum(F.exp(F.col("s") - F.col("m"))).alias("l")).select(*own, (F.col("m") + F.log("l")).alias("lse"))
    p = s.join(z, own).withColumn("p", F.exp(F.col("s") - F.col("lse")))
    parts = p.join(values.select(*by, F.col("id").alias("kid"), F.posexplode("v").alias("dim", "x")), [*by, "kid"])
    summed = parts.groupBy(*own, "lse", "dim").agg(F.sum(F.col("p") * F.col("x")).alias("o"))
    return summed.groupBy(*own, "lse").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "o"))), lambda r: r["o"]).alias("out"))


STATE = "m array<double>, l array<double>, o array<double>"


def vector_blocks(rows: DataFrame, by: Sequence[str], pos: str, size: int, vectors: Sequence[str]) -> DataFrame:
    """``block`` beside ``by``, with positions and the named vectors of ``size`` consecutive rows of a sequence as flat arrays."""
    own = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), *vectors)))
    cut = rows.groupBy(*by, F.expr(f"{pos} div {size}").alias("block")).agg(own.alias("r"))
    return cut.select(*by, "block", F.col("r.pos").alias("pos"), *(F.flatten(f"r.{v}").alias(v) for v in vectors))


def block_state(q: np.ndarray, k: np.ndarray, v: np.ndarray, qpos: np.ndarray, kpos: np.ndarray, causal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block of keys says of a block of queries: highest score, sum of exponentials and output relative to it."""
    s = q @ k.T / math.sqrt(q.shape[1])
    if causal:
        s = np.where(kpos[None, :] <= qpos[:, None], s, -np.inf)
    m = s.max(1)
    p = np.exp(s - np.where(np.isneginf(m), 0.0, m)[:, None])
    bad = np.flatnonzero(~np.isfinite(v).all(1))
    out = p @ np.where(np.isfinite(v), v, 0.0)
    for j in bad:  # zero times such a value is not a number, also where a later key may not be seen
        seen = kpos[j] <= qpos if causal else np.ones(len(q), bool)
        out[seen] += p[seen, j, None] * np.where(np.isfinite(v[j]), 0.0, v[j])
    return m, p.sum(1), out


def merge_states(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state of both blocks' keys: sums and outputs are brought to the higher of the two scores."""
    m = np.maximum(a[0], b[0])
    top = np.where(np.isneginf(m), 0.0, m)
    x, y = np.exp(a[0] - top), np.exp(b[0] - top)
    return m, a[1] * x + b[1] * y, a[2] * x[:, None] + b[2] * y[:, None]


def block_attention(rows: DataFrame, by: Sequence[str], pos: str = "pos", size: int = 64, causal: bool = True) -> DataFrame:
    """``pos, lse, out`` beside ``by``: attention over sequences of any length, from ``pos, q, k, v`` at consecutive positions.

    Sequences are cut in blocks. A block of queries meets the blocks of keys one at a time and keeps a state (highest score, sum,
    output) per query, which merges with other blocks' in any order: within a task as rows come, then between tasks. Nothing holds a sequence or a row of
    its attention matrix. Without causality every query sees all keys; a sequence's first query sees itself, so no state is empty at the end.
    """
    ship(rows.sparkSession)
    queries = vector_blocks(rows, by, pos, size, ["q"])
    keys = vector_blocks(rows, by, pos, size, ["k", "v"]).withColumnsRenamed({"block": "kblock", "pos": "kpos"})
    pairs = queries.join(keys, list(by))
    pairs = pairs.where("kblock <= block") if causal else pairs
    key = [*by, "block"]

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, npos = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                at = tuple(row[c].as_py() for c in key)
                flat = {c: row[c].values.to_numpy() for c in ("pos", "q", "kpos", "k", "v")}
                n, nk = len(flat["pos"]), len(flat["kpos"])
                new = block_state(flat["q"].reshape(n, -1), flat["k"].reshape(nk, -1), flat["v"].reshape(nk, -1), flat["pos"], flat["kpos"], causal)
                if held is not None and held != at:
                    yield emitted(held, npos, state)
                    state = None
                held, npos, state = at, flat["pos"], new if state is None else merge_states(state, new)
        if held is not None:
            yield emitted(held, npos, state)

    fields = T.StructType([*(queries.schema[c] for c in key), *T.StructType.fromDDL("pos array<long>, " + STATE)])
    arrow = to_arrow_schema(fields)

    def emitted(at: tuple, positions: np.ndarray, state: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(key, at)) | {"pos": positions, "m": state[0], "l": state[1], "o": state[2].ravel()}], schema=arrow)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = state = positions = None
        for batch in batches:
            for r in range(batch.num_rows):
                at = tuple(batch.column(c)[r].as_py() for c in key)
                positions, m, sums, out = (batch.column(c)[r].values.to_numpy() for c in ("pos", "m", "l", "o"))
                new = (m, sums, out.reshape(len(m), -1))
                state = new if state is None else merge_states(state, new)
        m, sums, out = state
        yield emitted(at, positions, (m + np.log(sums), sums, out / sums[:, None]))

    found = pairs.mapInArrow(lean(states), fields).groupBy(*key).applyInArrow(merged, fields)
    each = F.expr("transform(pos, (p, i) -> struct(p as pos, m[i] as lse, slice(o, int(i * (size(o) / size(pos))) + 1, int(size(o) / size(pos))) as out))")
    return found.select(*by, F.inline(each))


def _whole_sequences(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, id, v``: the rows of each short sequence, in order, with their vectors as one flat array."""
    own = F.array_sort(F.collect_list(F.struct("id", "v")))
    return rows.where("v is not null").groupBy(*by).agg(own.alias("r")).select(*by, F.col("r.id").alias("id"), F.flatten("r.v").alias("v"))


def _weights(x: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-sum-exp and softmax of the scaled dot products of rows with each other (``seen``: queries by keys)."""
    s = np.where(seen, x @ x.T / math.sqrt(x.shape[1]), -np.inf)
    m = s.max(1)
    lse = m + np.log(np.exp(s - m[:, None]).sum(1))
    return lse, np.exp(s - lse[:, None])


def _times(p: np.ndarray, x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """``p @ x``, in which what isn't seen is no term, also where a value isn't finite."""
    return p @ x if np.isfinite(x).all() else np.where(seen[:, :, None], p[:, :, None] * x[None], 0.0).sum(1)


def _seen(ids: np.ndarray, sees) -> np.ndarray:
    return np.asarray(sees(ids[:, None], ids[None, :]), bool)


def sequence_attention(rows: DataFrame, by: Sequence[str], sees, heads: int = 1) -> DataFrame:
    """``qid, head, lse, out`` of self-attention within short sequences, by ``id, v`` rows; ``sees(query ids, key ids)`` is the mask.

    For sequences whose attention matrix a task can hold, a few thousand rows; longer ones take :func:`block_attention`. Each row is shuffled
    once and no pair ever is. Every query has to see itself.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in zip(batch.column("id"), batch.column("v")):
                ids = i.values.to_numpy()
                x = v.values.to_numpy(zero_copy_only=False).reshape(len(ids), heads, -1)
                seen = _seen(ids, sees)
                for h in range(heads):
                    lse, p = _weights(x[:, h], seen)
                    out = _times(p, x[:, h], seen)
                    ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * out.shape[1])
                    columns = [pa.array(ids), pa.array(np.full(len(ids), h, np.int32)), pa.array(lse), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["qid", "head", "lse", "out"])

    return _whole_sequences(rows, by).select("id", "v").mapInArrow(lean(run), "qid long, head int, lse double, out array<double>")


def sequence_gradients(rows: DataFrame, by: Sequence[str], sees) -> DataFrame:
    """``of, id, out``: dq, dk and dv of :func:`sequence_attention` with one head, where the output's gradient is each row itself."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in zip(batch.column("id"), batch.column("v")):
                ids = i.values.to_numpy()
                x = v.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                seen = _seen(ids, sees)
                _, p = _weights(x, seen)
                own = (x * _times(p, x, seen)).sum(1)
                ds = np.where(seen, p * (x @ x.T - own[:, None]), 0.0) / math.sqrt(x.shape[1])
                for of, found in (("dq", _times(ds, x, seen)), ("dk", _times(ds.T, x, seen.T)), ("dv", _times(p.T, x, seen.T))):
                    ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1])
                    columns = [pa.array([of] * len(ids)), pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["of", "id", "out"])

    return _whole_sequences(rows, by).select("id", "v").mapInArrow(lean(run), "of string, id long, out array<double>")


def softmax_gradient(s: DataFrame, out: DataFrame, values: DataFrame, grads: DataFrame, by: Sequence[str]) -> DataFrame:
    """``qid, kid, p, ds``: P from scores and log-sum-exp, dS = P (dO.V - dO.O)."""
    rows = s.join(out, [*by, "qid"]).join(grads.select(*by, F.col("id").alias("qid"), F.col("v").alias("g")), [*by, "qid"])
    rows = rows.join(values.select(*by, F.col("id").alias("kid"), F.col("v").alias("kv")), [*by, "kid"])
    p = F.exp(F.col("s") - F.col("lse"))
    return rows.select(*by, "qid", "kid", p.alias("p"), (p * (V.dot(F.col("g"), F.col("kv")) - V.dot(F.col("g"), F.col("out")))).alias("ds"))


def attention_gradients(ds: DataFrame, q: DataFrame, k: DataFrame, grads: DataFrame, dim: int, by: Sequence[str]) -> DataFrame:
    """``of, id, dim, x``: the gradients dq = dS K / sqrt(dim), dk = dS' Q / sqrt(dim) and dv = P' dO of :func:`softmax_gradient`."""

    def summed(of: str, own: str, other: str, weight: Column, vectors: DataFrame) -> DataFrame:
        parts = ds.join(vectors.select(*by, F.col("id").alias(other), F.posexplode("v").alias("dim", "x")), [*by, other])
        return parts.groupBy(*by, F.col(own).alias("id"), "dim").agg(F.sum(weight * F.col("x")).alias("x")).select(F.lit(of).alias("of"), *by, "id", "dim", "x")

    scaled = F.col("ds") / math.sqrt(dim)
    return summed("dq", "qid", "kid", scaled, k).unionByName(summed("dk", "kid", "qid", scaled, q)).unionByName(summed("dv", "kid", "qid", F.col("p"), grads))


def replicated(states: DataFrame, ranks: int, first: int = 0) -> DataFrame:
    """``rank, name, pos, value``: each of so many ranks starts from the state of rank ``first``."""
    sent = states.where(F.col("rank") == first).drop("rank")
    return sent.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranks - 1).cast("long"))).alias("rank"), "*")


def flat_mean(grads: DataFrame) -> DataFrame:
    """``rank, idx, pos, value``: each rank's gradients laid end to end, one mean over ranks, and cut up again.

    ``grads`` has ``rank, idx, pos, value`` with the same parameters (``idx``) on all ranks.
    """
    sizes = grads.where(F.col("rank") == 0).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))  # one row per parameter of a model
    places = sizes.select("idx", F.coalesce(before, F.lit(0)).alias("start"), "n")
    flat = grads.join(F.broadcast(places), "idx").select("rank", (F.col("start") + F.col("pos")).alias("at"), "value")
    mean = flat.groupBy("at").agg(F.avg("value").alias("value"))
    back = flat.select("rank", "at").join(mean, "at").join(F.broadcast(places), F.expr("at >= start and at < start + n"))
    return back.select("rank", "idx", (F.col("at") - F.col("start")).alias("pos"), "value")


def batch_losses(rows: DataFrame, batch: Column, loss: str = "loss") -> DataFrame:
    """One row: batches, and the mean of the batches' mean losses."""
    each = rows.groupBy(batch.alias("batch")).agg(F.avg(loss).alias("loss"))
    return each.agg(F.count(F.lit(1)).alias("batches"), F.avg("loss").alias("loss"))


def merged_logsumexp(rows: DataFrame, by: str, x: str, blocks: Column) -> DataFrame:
    """``by, lse`` by mergeable states (max, sum of exp): one state per block, then states merge."""
    state = rows.groupBy(by, blocks.alias("block")).agg(F.max(x).alias("m"), F.collect_list(x).alias("xs"))
    state = state.select(by, "m", F.aggregate("xs", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("m"))).alias("l"))
    whole = state.groupBy(by).agg(F.max("m").alias("top"))
    return state.join(whole, by).groupBy(by, "top").agg(F.sum(F.col("l") * F.exp(F.col("m") - F.col("top"))).alias("z")).select(by, (F.col("top") + F.log("z")).alias("lse"))


def nucleus(rows: DataFrame, by: str, item: str, p: str, top_p: float) -> DataFrame:
    """Keep the likeliest items while those before sum to less than top_p (the first always), and scale to one."""
    if top_p >= 1:
        return rows
    order = Window.partitionBy(by).orderBy(F.desc(p), item)
    before = F.coalesce(F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = rows.withColumn("_n", F.row_number().over(order)).withColumn("_before", before)
    kept = kept.withColumn("_p", F.when((F.col("_n") == 1) | (F.col("_before") < F.lit(max(top_p, 0.0))), F.col(p)).otherwise(0.0))
    whole = F.greatest(F.sum("_p").over(Window.partitionBy(by)), F.lit(1e-12))
    return kept.withColumn(p, F.col("_p") / whole).drop("_n", "_before", "_p")


def clip_scale(grads: DataFrame, value: str, most: float, eps: float = 1e-6) -> DataFrame:
    """One row: the norm over all gradients, and the factor that brings it to ``most`` at most."""
    return grads.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm")).withColumn("scale", F.least(F.lit(1.0), most / (F.col("norm") + eps)))


def adamw(params: DataFrame, steps: int, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.01) -> DataFrame:
    """``p`` after some steps from columns ``p, g`` (a constant gradient); decay applies to the updated value."""
    df = params.withColumn("m", F.lit(0.0)).withColumn("v", F.lit(0.0))
    for t in range(1, steps + 1):
        rate = lr * math.sqrt(1 - b2**t) / (1 - b1**t)
        df = df.withColumn("m", b1 * F.col("m") + (1 - b1) * F.col("g")).withColumn("v", b2 * F.col("v") + (1 - b2) * F.col("g") * F.col("g"))
        df = df.withColumn("p", F.col("p") - rate * F.col("m") / (F.sqrt("v") + eps)).withColumn("p", F.col("p") - lr * decay * F.col("p"))
    return df


def buckets(sizes: DataFrame, limit: int | None) -> DataFrame:
    """``idx, bytes, bucket``: parameters in order fill buckets up to a size; 0 or less: one each; None: one bucket."""
    if limit is None:
        return sizes.withColumn("bucket", F.lit(0))
    if limit <= 0:
        return sizes.withColumn("bucket", F.col("idx"))
    whole = sizes.agg(F.array_sort(F.collect_list(F.struct("idx", "bytes"))).alias("rows"))  # one row per parameter of a model

    def step(a: Column, r: Column) -> Column:
        over = (a["used"] > 0) & (a["used"] + r["bytes"] > limit)
        bucket = F.when(over, a["bucket"] + 1).otherwise(a["bucket"])
        used = F.when(over, r["bytes"]).otherwise(a["used"] + r["bytes"])
        row = F.struct(r["idx"].alias("idx"), r["bytes"].alias("bytes"), bucket.alias("bucket"))
        return F.struct(bucket.alias("bucket"), used.alias("used"), F.concat(a["out"], F.array(row)).alias("out"))

    empty = F.expr("named_struct('bucket', cast(0 as bigint), 'used', cast(0 as bigint), 'out', cast(array() as array<struct<idx:bigint,bytes:bigint,bucket:bigint>>))")
    return whole.select(F.explode(F.aggregate("rows", empty, step)["out"]).alias("r")).select("r.*")


def owners(params: DataFrame, world: int) -> DataFrame:
    """First occurrence of each (tied) parameter, owned round robin."""
    once = params.groupBy("name").agg(F.min("idx").alias("idx"))
    nth = F.row_number().over(Window.orderBy("idx")) - 1  # one row per parameter of a model
    return once.withColumn("owner", F.pmod(nth, F.lit(world)).cast("long"))
