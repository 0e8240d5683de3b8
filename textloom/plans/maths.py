"""Queries of model arithmetic over the embeddings, and of benchmark and scaling runs, with their DuckDB SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import model_math as M
from textloom.operators import runs as R
from textloom.sources.tables import table

DIGITS, EPS = 6, 1e-5
#: Rows of a sequence, attention heads, rows of a batch.
LENGTH, HEADS, BATCH = 32, 4, 50
#: Rows of the sequences that attention takes in blocks.
LONG = 512
E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, len(embedding) AS d FROM embeddings)"
X = f"{E}, x AS (SELECT vec_id, unnest(range(0, d))::INT AS dim, unnest(v) AS x FROM e)"


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def _rows(df: DataFrame, v: Column, key: str = "vec_id") -> DataFrame:
    return df.select(key, F.posexplode(v).alias("dim", "x")).select(key, "dim", F.round("x", DIGITS).alias("value"))


def _per_row(v):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _e(spark, sf_dir)
        return _rows(df, v(F.col("v")))

    return query


def _per_row_sql(value: str, window: str = "") -> str:
    return f"WITH {X}, y AS (SELECT vec_id, dim, x{', ' + window if window else ''} FROM x) SELECT vec_id, dim, round({value}, {DIGITS}) AS value FROM y"


OVER = "OVER (PARTITION BY vec_id)"
LSE = f"max(x) {OVER} AS m"


def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _e(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("v")), DIGITS).alias("norm"))


def _matrix(n: int, d: int, shift: int) -> Column:
    """A fixed matrix by rule: cos(shift + row * d + column) / sqrt(d)."""
    row = lambda r: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda c: F.cos(shift + r * d + c) / math.sqrt(d))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row)


def linear_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_e(spark, sf_dir), V.matmul(_matrix(8, 64, 1), F.col("v")))


def _linear_sql() -> str:
    return f"""
WITH {X}, w AS (SELECT r, c, cos(1 + r * 64 + c) / sqrt(64) AS w FROM range(0, 8) a(r), range(0, 64) b(c))
SELECT vec_id, r::INT AS dim, round(sum(w * x), {DIGITS}) AS value FROM x JOIN w ON c = dim GROUP BY vec_id, r"""


SWIGLU_ALL = f"""
WITH {X}, w1 AS (SELECT r, c, cos(1 + r * 64 + c) / sqrt(64) AS a, cos(3 + r * 64 + c) / sqrt(64) AS b FROM range(0, 16) p(r), range(0, 64) q(c)),
h AS (SELECT vec_id, r, sum(a * x) AS g, sum(b * x) AS u FROM x JOIN w1 ON c = dim GROUP BY vec_id, r),
k AS (SELECT vec_id, r, g / (1 + exp(-g)) * u AS z FROM h),
w2 AS (SELECT r AS o, c AS r, cos(2 + r * 16 + c) / sqrt(16) AS a FROM range(0, 64) p(r), range(0, 16) q(c))
SELECT vec_id, o::INT AS dim, round(sum(a * z), {DIGITS}) AS value FROM k JOIN w2 USING (r) GROUP BY vec_id, o"""


def swiglu_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed-forward step of every embedding."""
    made = M.swiglu_rows(_e(spark, sf_dir).select("vec_id", "v"), "v", _weights(16, 64, 1), _weights(64, 16, 2), _weights(16, 64, 3))
    return _rows(made, F.col("v"))


def _weights(n: int, d: int, shift: int) -> np.ndarray:
    """The same numbers as :func:`_matrix`."""
    return np.cos(shift + np.arange(n * d, dtype=np.float64)).reshape(n, d) / math.sqrt(d)


def rope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _e(spark, sf_dir)
    return _rows(df, V.rope(F.col("v"), F.col("vec_id")))


ROPE = f"""
WITH {X}, a AS (SELECT x.vec_id, x.dim, x.x, y.x AS o, x.vec_id * pow(10000.0, -(x.dim - x.dim % 2) / 64.0) AS t FROM x JOIN x y ON x.vec_id = y.vec_id AND y.dim = x.dim + 1 - 2 * (x.dim % 2))
SELECT vec_id, dim, round(CASE WHEN dim % 2 = 0 THEN x * cos(t) - o * sin(t) ELSE o * sin(t) + x * cos(t) END, {DIGITS}) AS value FROM a"""


def embedding_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row looked up by the id that follows from another row's by a rule."""
    rows = _e(spark, sf_dir)
    ids = rows.select(F.col("vec_id").alias("pos")).crossJoin(F.broadcast(rows.agg((F.max("vec_id") + 1).alias("n"))))
    ids = ids.select("pos", (F.col("n") - 1 - F.col("pos")).alias("vec_id"))
    return ids.join(rows, "vec_id").select("pos", "vec_id", F.round(F.get("v", F.lit(0)), DIGITS).alias("first"))


EMBEDDING_LOOKUP_ALL = f"""WITH {E}, i AS (SELECT vec_id AS pos, (SELECT max(vec_id) FROM e) - vec_id AS vec_id FROM e)
SELECT pos, vec_id, round(v[1], {DIGITS}) AS first FROM i JOIN e USING (vec_id)"""


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, as sequences of LENGTH rows."""
    return _e(spark, sf_dir).select(F.expr(f"vec_id div {LENGTH}").alias("seq"), F.col("vec_id").alias("id"), "v")


def causal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal attention of every row within its sequence, by HEADS heads."""
    out = M.sequence_attention(_sequences(spark, sf_dir), ["seq"], lambda q, k: k <= q, HEADS)
    out = out.select("qid", "head", F.round("lse", DIGITS).alias("lse"), F.posexplode("out").alias("i", "x"))
    return out.select("qid", "head", "lse", (F.col("head") * (64 // HEADS) + F.col("i")).alias("dim"), F.round("x", DIGITS).alias("value"))


def _attention_sql(heads: int, where: str) -> str:
    d = 64 // heads
    return f"""
{X}, hx AS (SELECT vec_id, vec_id // {LENGTH} AS seq, dim, dim // {d} AS head, x FROM x),
s AS (SELECT q.seq, q.head, q.vec_id AS qid, k.vec_id AS kid, sum(q.x * k.x) / sqrt({d}) AS s FROM hx q JOIN hx k ON q.seq = k.seq AND q.dim = k.dim AND {where} GROUP BY ALL),
z AS (SELECT head, qid, max(s) AS m FROM s GROUP BY ALL),
l AS (SELECT head, qid, m + ln(sum(exp(s - m))) AS lse FROM s JOIN z USING (head, qid) GROUP BY head, qid, m),
p AS (SELECT s.head, qid, kid, lse, exp(s - lse) AS p FROM s JOIN l USING (head, qid)),
o AS (SELECT qid, p.head, lse, dim, sum(p * x) AS o FROM p JOIN hx ON vec_id = kid AND hx.head = p.head GROUP BY ALL)"""


CAUSAL_ATTENTION = f"WITH {_attention_sql(HEADS, 'k.vec_id <= q.vec_id')} SELECT qid, head::INT AS head, round(lse, {DIGITS}) AS lse, dim, round(o, {DIGITS}) AS value FROM o"


def masked_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention with a Boolean mask by rule: a query sees itself and the keys whose sum with it isn't a multiple of three."""
    out = M.sequence_attention(_sequences(spark, sf_dir), ["seq"], lambda q, k: (q == k) | ((q + k) % 3 != 0))
    return out.select("qid", F.round("lse", DIGITS).alias("lse"), F.posexplode("out").alias("dim", "x")).select("qid", "lse", "dim", F.round("x", DIGITS).alias("value"))


MASKED_ATTENTION = f"WITH {_attention_sql(1, '(q.vec_id = k.vec_id OR (q.vec_id + k.vec_id) % 3 <> 0)')} SELECT qid, round(lse, {DIGITS}) AS lse, dim, round(o, {DIGITS}) AS value FROM o"


def attention_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradients of queries, keys and values of causal attention; the output's gradient is each row itself."""
    found = M.sequence_gradients(_sequences(spark, sf_dir), ["seq"], lambda q, k: k <= q)
    found = found.select("of", "id", F.posexplode("out").alias("dim", "x"))
    return found.select("of", F.col("id").alias("vec_id"), "dim", F.round("x", DIGITS).alias("value"))


ATTENTION_GRADIENTS = f"""
WITH {_attention_sql(1, 'k.vec_id <= q.vec_id')}, dd AS (SELECT qid, sum(x * o) AS d FROM o JOIN x ON vec_id = qid AND x.dim = o.dim GROUP BY qid),
dp AS (SELECT q.vec_id AS qid, k.vec_id AS kid, sum(q.x * k.x) AS dp FROM hx q JOIN hx k ON q.seq = k.seq AND q.dim = k.dim AND k.vec_id <= q.vec_id GROUP BY ALL),
ds AS (SELECT qid, kid, p, p * (dp - d) / sqrt(64) AS ds FROM p JOIN dp USING (qid, kid) JOIN dd USING (qid)),
g AS (SELECT 'dq' AS "of", qid AS vec_id, dim, sum(ds * x) AS x FROM ds JOIN x ON vec_id = kid GROUP BY ALL
      UNION ALL SELECT 'dk', kid, dim, sum(ds * x) FROM ds JOIN x ON vec_id = qid GROUP BY ALL
      UNION ALL SELECT 'dv', kid, dim, sum(p * x) FROM ds JOIN x ON vec_id = qid GROUP BY ALL)
SELECT "of", vec_id, dim, round(x, {DIGITS}) AS value FROM g"""


def learned_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding plus the row of a position table (a fixed matrix by rule) for its place in the sequence."""
    df = _e(spark, sf_dir)
    return _rows(df, V.add(F.col("v"), F.get(_matrix(LENGTH, 64, 5), (F.col("vec_id") % LENGTH).cast("int"))))


LEARNED_POSITIONS = f"WITH {X} SELECT vec_id, dim, round(x + cos(5 + (vec_id % {LENGTH}) * 64 + dim) / sqrt(64), {DIGITS}) AS value FROM x"


def eval_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean loss of batches of BATCH rows."""
    loss = _e(spark, sf_dir).select("vec_id", V.cross_entropy(F.col("v"), F.col("label")).alias("loss"))
    found = M.batch_losses(loss, F.expr(f"vec_id div {BATCH}"))
    return found.select("batches", F.round("loss", DIGITS).alias("loss"))


EVAL_BATCHES = f"""
WITH {X}, l AS (SELECT vec_id, m + ln(sum(exp(x - m))) AS lse FROM (SELECT *, max(x) {OVER} AS m FROM x) GROUP BY vec_id, m),
c AS (SELECT vec_id // {BATCH} AS b, avg(lse - v[label + 1]) AS c FROM l JOIN e USING (vec_id) GROUP BY ALL) SELECT count(*) AS batches, round(avg(c), {DIGITS}) AS loss FROM c"""

#: Ranks that share the rows by id, and values of a parameter.
RANKS, PARAMETER = 4, 16


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rank's mean of its embeddings, as the gradients of parameters of PARAMETER values."""
    rows = _e(spark, sf_dir).select(F.expr(f"vec_id % {RANKS}").alias("rank"), F.posexplode("v").alias("dim", "x"))
    mean = rows.groupBy("rank", "dim").agg(F.avg("x").alias("value"))
    return mean.select("rank", F.expr(f"dim div {PARAMETER}").alias("idx"), F.expr(f"cast(dim % {PARAMETER} as long)").alias("pos"), "value")


def replicated_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rank's state after that of rank 0 was sent to all."""
    found = M.replicated(_flat(spark, sf_dir), RANKS)
    return found.select("rank", "idx", "pos", F.round("value", DIGITS).alias("value"))


_FLAT_SQL = f"{X}, fl AS (SELECT vec_id % {RANKS} AS rank, (dim // {PARAMETER})::BIGINT AS idx, (dim % {PARAMETER})::BIGINT AS pos, avg(x) AS value FROM x GROUP BY ALL)"
REPLICATED_STATE = f"WITH {_FLAT_SQL} SELECT r AS rank, idx, pos, round(value, {DIGITS}) AS value FROM fl, range(0, {RANKS}) a(r) WHERE rank = 0"


def flat_gradient_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.flat_mean(_flat(spark, sf_dir)).select("rank", "idx", "pos", F.round("value", DIGITS).alias("value"))


FLAT_GRADIENT_MEAN = f"WITH {_FLAT_SQL}, m AS (SELECT idx, pos, avg(value) AS value FROM fl GROUP BY ALL) SELECT rank, idx, pos, round(m.value, {DIGITS}) AS value FROM fl JOIN m USING (idx, pos)"

#: The event log as a log of steps: what ran (the type), on which rank (of the user), in which step (of STEP_EVENTS events), for how long (the value).
STEP_EVENTS = 200


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", F.col("event_type").alias("impl"), F.expr(f"user_id % {RANKS}").alias("rank"), F.expr(f"event_id div {STEP_EVENTS}").alias("step"), F.col("value").alias("ms"))


_STEPS_SQL = f"st AS (SELECT event_id, user_id, event_type AS impl, user_id % {RANKS} AS rank, event_id // {STEP_EVENTS} AS step, value AS ms FROM events)"


def attention_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean time and peak bytes (a thousand by user, and the event's number) of each type, the warm-up left out."""
    rows = _steps(spark, sf_dir).withColumn("bytes", F.expr("1000 * user_id + event_id"))
    return R.peak(rows, ["impl"], 3).select("impl", F.round("mean_ms", DIGITS).alias("mean_ms"), "peak_bytes")


ATTENTION_PEAKS = f"WITH {_STEPS_SQL} SELECT impl, round(avg(ms), {DIGITS}) AS mean_ms, max(1000 * user_id + event_id) AS peak_bytes FROM st WHERE step >= 3 GROUP BY impl"


def memory_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes (the value in hundredths) after each event of a user's day and their growth on a rank, the most over ranks."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.dayofyear("ts").alias("day"), F.expr(f"event_id % {RANKS}").alias("rank"), F.col("event_id").alias("at"), F.col("event_type").alias("event"), F.round(F.col("value") * 100).cast("long").alias("bytes")
    )
    return R.memory_deltas(rows, ["user_id", "day"])


MEMORY_PROFILE = f"""
WITH e AS (SELECT user_id, dayofyear(ts)::INT AS day, event_id % {RANKS} AS rank, event_id AS "at", event_type AS event, round(value * 100)::BIGINT AS bytes FROM events),
d AS (SELECT *, bytes - coalesce(lag(bytes) OVER (PARTITION BY user_id, day, rank ORDER BY "at"), 0) AS delta FROM e)
SELECT user_id, day, "at", event, max(bytes) AS bytes, max(delta) AS delta FROM d GROUP BY ALL"""


def block_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal attention within sequences of LONG rows, block by block with mergeable states."""
    rows = _e(spark, sf_dir).select(F.expr(f"vec_id div {LONG}").alias("seq"), F.col("vec_id").alias("pos"), F.col("v").alias("q"), F.col("v").alias("k"), "v")
    out = M.block_attention(rows, ["seq"])
    return out.select(F.col("pos").alias("qid"), F.round("lse", DIGITS).alias("lse"), F.transform("out", lambda x: F.round(x, DIGITS)).alias("out"))


BLOCK_ATTENTION = f"""
WITH {E}, s AS (SELECT q.vec_id AS qid, k.v AS kv, list_dot_product(q.v, k.v) / sqrt(q.d) AS s FROM e q JOIN e k ON q.vec_id // {LONG} = k.vec_id // {LONG} AND k.vec_id <= q.vec_id),
m AS (SELECT *, max(s) OVER (PARTITION BY qid) AS m FROM s),
p AS (SELECT qid, m, exp(s - m) AS w, unnest(range(0, len(kv))) AS dim, unnest(kv) AS x FROM m),
o AS (SELECT qid, dim, m + ln(sum(w)) AS lse, sum(w * x) / sum(w) AS o FROM p GROUP BY qid, dim, m)
SELECT qid, round(any_value(lse), {DIGITS}) AS lse, list(round(o, {DIGITS}) ORDER BY dim) AS "out" FROM o GROUP BY qid"""


def online_logsumexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir).select("vec_id", F.posexplode("v").alias("dim", "x"))
    return M.merged_logsumexp(rows, "vec_id", "x", F.expr("dim div 16")).select("vec_id", F.round("lse", DIGITS).alias("lse"))


ONLINE = f"WITH {X} SELECT vec_id, round(m + ln(sum(exp(x - m))), {DIGITS}) AS lse FROM (SELECT *, max(x) {OVER} AS m FROM x) GROUP BY vec_id, m"


def cross_entropy_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = _e(spark, sf_dir).select(V.cross_entropy(F.col("v"), F.col("label")).alias("x"))
    return loss.agg(F.round(F.avg("x"), DIGITS).alias("loss"), F.round(F.exp(F.avg("x")), 4).alias("perplexity"))


CROSS_ENTROPY = f"""
WITH {X}, l AS (SELECT vec_id, m + ln(sum(exp(x - m))) AS lse FROM (SELECT *, max(x) {OVER} AS m FROM x) GROUP BY vec_id, m),
c AS (SELECT lse - v[label + 1] AS c FROM l JOIN e USING (vec_id)) SELECT round(avg(c), {DIGITS}) AS loss, round(exp(avg(c)), 4) AS perplexity FROM c"""


def top_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir).select("vec_id", F.posexplode(V.softmax(F.col("v"))).alias("dim", "p"))
    return M.nucleus(rows, "vec_id", "dim", "p", 0.4).where("p > 0").select("vec_id", "dim", F.round("p", DIGITS).alias("p"))


TOP_P = f"""
WITH {X}, s AS (SELECT vec_id, dim, exp(x - m) / sum(exp(x - m)) {OVER} AS p FROM (SELECT *, max(x) {OVER} AS m FROM x)),
b AS (SELECT *, coalesce(sum(p) OVER w, 0) AS before, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, dim) AS n FROM s
      WINDOW w AS (PARTITION BY vec_id ORDER BY p DESC, dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT vec_id, dim, round(p / sum(p) {OVER}, {DIGITS}) AS p FROM b WHERE n = 1 OR before < 0.4"""


def top_k_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _e(spark, sf_dir).select("vec_id", F.posexplode(V.top_k(F.col("v"), 5)).alias("dim", "x"))
    return kept.where(F.col("x") > float("-inf")).select("vec_id", "dim", F.round("x", DIGITS).alias("value"))


TOP_K = f"WITH {X}, t AS (SELECT vec_id, list_reverse_sort(v)[5] AS t FROM e) SELECT vec_id, dim, round(x, {DIGITS}) AS value FROM x JOIN t USING (vec_id) WHERE x >= t"


def lr_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning rate of every event's step, the events taken one by one."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("it"), F.round(V.lr_cosine(F.col("event_id"), 1.0, 0.1, 700, 2100), DIGITS).alias("lr"))


LR_COSINE = f"SELECT t AS it, round(CASE WHEN t < 700 THEN t / 700 WHEN t <= 2100 THEN 0.1 + 0.5 * (1 + cos((t - 700) / 1400 * pi())) * 0.9 ELSE 0.1 END, {DIGITS}) AS lr FROM (SELECT event_id AS t FROM events)"
STEPS = 3


def adamw_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of every embedding after some steps, its gradient being the entry as far from the other end."""
    rows = _e(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(F.col("v").alias("p"), F.reverse("v").alias("g"))).alias("dim", "x")).select("vec_id", "dim", "x.p", "x.g")
    return M.adamw(rows, STEPS).select("vec_id", "dim", F.round("p", 9).alias("p"))


def _adamw_sql() -> str:
    sql = "SELECT vec_id, unnest(range(0, d))::INT AS dim, unnest(v) AS p, unnest(list_reverse(v)) AS g, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM e"
    for t in range(1, STEPS + 1):
        rate = 1e-3 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        sql = f"SELECT vec_id, dim, p, g, 0.9::DOUBLE * m + {1 - 0.9!r}::DOUBLE * g AS m, 0.999::DOUBLE * v + {1 - 0.999!r}::DOUBLE * g * g AS v FROM ({sql})"
        sql = f"SELECT vec_id, dim, q - {1e-3 * 0.01!r}::DOUBLE * q AS p, g, m, v FROM (SELECT *, p - {rate!r}::DOUBLE * m / (sqrt(v) + 1e-8::DOUBLE) AS q FROM ({sql}))"
    return f"WITH {E} SELECT vec_id, dim, round(p, 9) AS p FROM ({sql})"


def grad_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir).select(F.explode("v").alias("g"))
    return M.clip_scale(rows, "g", 1.0).select(F.round("norm", DIGITS).alias("norm"), F.round("scale", DIGITS).alias("scale"))


GRAD_CLIP = f"WITH {X} SELECT round(sqrt(sum(x * x)), {DIGITS}) AS norm, round(least(1.0, 1.0 / (sqrt(sum(x * x)) + 1e-6)), {DIGITS}) AS scale FROM x"

#: The table of embeddings as a model's parameters: for each label a matrix of its rows and a vector of as many entries, and every third matrix
#: once more under its name (tied). The matrix of label 0 is the embedding. Index, name, rows, columns (0: a vector).
_PARAMETERS_SQL = """pl AS (SELECT label::BIGINT AS k, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label),
pa AS (SELECT 2 * k AS idx, 'label' || k AS name, n, 64::BIGINT AS m FROM pl UNION ALL SELECT 2 * k + 1, 'bias' || k, n, 0 FROM pl
       UNION ALL SELECT 1000000 + k, 'label' || k, n, 64 FROM pl WHERE k % 3 = 0)"""
EMBEDDING = "label0"


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("label").cast("long")
    labels = table(spark, sf_dir, "embeddings").where("label is not null").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda idx, name, m: F.struct(F.expr(idx).alias("idx"), F.concat(F.lit(name), F.col("k").cast("string")).alias("name"), F.col("n"), F.lit(m).cast("long").alias("m"))
    rows = F.array(one("2 * k", "label", 64), one("2 * k + 1", "bias", 0), one("1000000 + k", "label", 64))
    return labels.select("k", F.explode(rows).alias("r")).where("r.idx < 1000000 or k % 3 = 0").select("r.*")


def param_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parameters, those without embeddings, and those that decay (matrices); tied ones count once."""
    once = _parameters(spark, sf_dir).dropDuplicates(["name"]).withColumn("size", F.col("n") * F.greatest("m", F.lit(1)))
    part = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0))
    return once.agg(F.sum("size").alias("total"), part(F.col("name") != EMBEDDING).alias("non_embedding"), part(F.col("m") > 0).alias("decayed"))


PARAM_COUNTS = f"""WITH {_PARAMETERS_SQL}, o AS (SELECT DISTINCT name, n * greatest(m, 1) AS s, m FROM pa)
SELECT sum(s)::BIGINT AS total, coalesce(sum(s) FILTER (name <> '{EMBEDDING}'), 0)::BIGINT AS non_embedding, coalesce(sum(s) FILTER (m > 0), 0)::BIGINT AS decayed FROM o"""
LIMIT = 60000


def gradient_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _parameters(spark, sf_dir).select("idx", (4 * F.col("n") * F.greatest("m", F.lit(1))).alias("bytes"))
    return M.buckets(sizes, LIMIT)


BUCKETS = f"""
WITH RECURSIVE {_PARAMETERS_SQL}, s AS (SELECT idx, 4 * n * greatest(m, 1) AS b, row_number() OVER (ORDER BY idx) AS k FROM pa),
r AS (SELECT k, idx, b, 0::BIGINT AS bucket, b AS used FROM s WHERE k = 1
      UNION ALL SELECT s.k, s.idx, s.b, r.bucket + (r.used + s.b > {LIMIT})::INT, CASE WHEN r.used + s.b > {LIMIT} THEN s.b ELSE r.used + s.b END FROM r JOIN s ON s.k = r.k + 1)
SELECT idx::BIGINT AS idx, b::BIGINT AS bytes, bucket FROM r"""


def shard_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.owners(_parameters(spark, sf_dir), RANKS)


OWNERS = f"WITH {_PARAMETERS_SQL} SELECT name, idx::BIGINT AS idx, ((row_number() OVER (ORDER BY idx) - 1) % 4)::BIGINT AS owner FROM (SELECT name, min(idx) AS idx FROM pa GROUP BY name)"


def gradient_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over four ranks of each coordinate: an all-reduce as one aggregate."""
    rows = _e(spark, sf_dir).select(F.pmod("vec_id", F.lit(4)).alias("rank"), F.posexplode("v").alias("dim", "g"))
    local = rows.groupBy("rank", "dim").agg(F.avg("g").alias("g"))
    return local.groupBy("dim").agg(F.round(F.avg("g"), DIGITS).alias("g"))


GRADIENT_MEAN = f"WITH {X}, l AS (SELECT vec_id % 4 AS r, dim, avg(x) AS g FROM x GROUP BY ALL) SELECT dim, round(avg(g), {DIGITS}) AS g FROM l GROUP BY dim"


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    stats = R.step_stats(steps, ["impl"], 2).join(R.throughput(R.slowest_rank(steps, ["impl"], 2), 4096), "impl")
    return stats.select("impl", "steps", *(F.round(c, DIGITS).alias(c) for c in ("mean_ms", "std_ms", "step_ms", "tokens_s")))


BENCH_SUMMARY = f"""
WITH {_STEPS_SQL}, a AS (SELECT impl, count(*) AS steps, avg(ms) AS mean_ms, coalesce(stddev_samp(ms), 0) AS std_ms FROM st WHERE step >= 2 GROUP BY impl),
w AS (SELECT impl, avg(ms) AS step_ms FROM (SELECT impl, step, max(ms) AS ms FROM st WHERE step >= 2 GROUP BY ALL) GROUP BY impl)
SELECT impl, steps, round(mean_ms, {DIGITS}) AS mean_ms, round(std_ms, {DIGITS}) AS std_ms, round(step_ms, {DIGITS}) AS step_ms, round(4096 * 1000.0 / step_ms, {DIGITS}) AS tokens_s FROM a JOIN w USING (impl)"""

#: Events above so much have failed: their time isn't known.
MOST = 200.0


def bench_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best variant (of the event's number) of each type against that of views, by users' last digit; what failed has no time."""
    rows = _steps(spark, sf_dir)
    ok = F.col("ms") <= MOST
    results = rows.select(F.expr("cast(user_id % 10 as string)").alias("size"), "impl", F.expr("concat('v', event_id % 3)").alias("variant"), F.when(ok, "ok").otherwise("oom").alias("status"), F.when(ok, F.col("ms")).alias("ms"))
    return R.speedup(results, "size", "view").select("size", "impl", "variant", "ms", "base_ms", F.round("speedup", DIGITS).alias("speedup"))


BENCH_SPEEDUP = f"""
WITH {_STEPS_SQL}, re AS (SELECT (user_id % 10)::VARCHAR AS size, impl, 'v' || (event_id % 3) AS variant, ms FROM st WHERE ms <= {MOST}),
b AS (SELECT size, impl, arg_min(variant, (ms, variant)) AS variant, min(ms)::DOUBLE AS ms FROM re GROUP BY size, impl)
SELECT b.size, b.impl, b.variant, b.ms, n.ms AS base_ms, CASE WHEN b.ms <> 0 THEN round(n.ms / b.ms, {DIGITS}) END AS speedup FROM b LEFT JOIN b n ON n.size = b.size AND n.impl = 'view'"""


def reduce_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency and bandwidth by a size and a number of ranks of the event's number."""
    size = F.element_at(F.array(*map(F.lit, (1, 10, 100, 1024))), F.expr("cast(event_id % 4 + 1 as int)"))
    rows = _steps(spark, sf_dir).withColumns({"mb": size, "world": F.expr("2 + 2 * (event_id div 4 % 3)")})
    return R.latency(rows, 1).select("mb", "world", F.round("latency_ms", DIGITS).alias("latency_ms"), F.round("gib_s", DIGITS).alias("gib_s"))


REDUCE_LATENCY = f"""
WITH {_STEPS_SQL}, r AS (SELECT [1, 10, 100, 1024][event_id % 4 + 1] AS mb, 2 + 2 * (event_id // 4 % 3) AS world, rank, ms FROM st WHERE step >= 1),
m AS (SELECT mb, world, rank, avg(ms) AS ms FROM r GROUP BY ALL)
SELECT mb, world, round(max(ms), {DIGITS}) AS latency_ms, round(mb / 1024.0 / (max(ms) / 1000.0), {DIGITS}) AS gib_s FROM m GROUP BY mb, world"""


def bench_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of the types of events, the types of parts and the ranks; bucket sizes only for purchases."""
    events, parts = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    world = F.expr(f"cast(user_id % {RANKS} + 1 as int)")
    return R.sweep(events.select(F.col("event_type").alias("impl")).distinct(), parts.select(F.col("p_type").alias("size")).distinct(), events.select(world.alias("world")).distinct(), "purchase", [1, 10, 100])


BENCH_SWEEP = f"""
SELECT impl, size, world, unnest(CASE WHEN impl = 'purchase' THEN [1, 10, 100] ELSE [NULL::INT] END) AS bucket_mb
FROM (SELECT DISTINCT event_type AS impl FROM events), (SELECT DISTINCT p_type AS size FROM part), (SELECT DISTINCT (user_id % {RANKS} + 1)::INT AS world FROM events)"""

#: Line items as runs: the quantity is the budget, the price the parameters, and how far the price is from a rate per piece, with the discount, the loss.
_LOSS = "abs(l_extendedprice - 1500 * l_quantity) / 1000 + l_discount"
_RUNS_SQL = f"ru AS (SELECT l_quantity AS c, round(l_extendedprice)::BIGINT AS n, {_LOSS} AS l FROM lineitem)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("compute_budget"), F.round("l_extendedprice").cast("long").alias("parameters"), F.expr(_LOSS).alias("final_loss"))


def isoflop_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.best_per_budget(_runs(spark, sf_dir))
    return best.select(F.round(F.log10("compute_budget"), DIGITS).alias("log_budget"), "parameters", F.round("final_loss", DIGITS).alias("final_loss"))


_BEST = f"{_RUNS_SQL}, be AS (SELECT c, arg_min(n, (l, n)) AS n, min(l) AS l FROM ru GROUP BY c)"
ISOFLOP = f"WITH {_BEST} SELECT round(log10(c), {DIGITS}) AS log_budget, n AS parameters, round(l, {DIGITS}) AS final_loss FROM be"


def scaling_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.power_law(R.best_per_budget(_runs(spark, sf_dir))).select(F.round("exponent", DIGITS).alias("exponent"), F.round("intercept", 4).alias("intercept"))


SCALING_FIT = f"WITH {_BEST} SELECT round(regr_slope(ln(n), ln(c)), {DIGITS}) AS exponent, round(regr_intercept(ln(n), ln(c)), 4) AS intercept FROM be"

QUERIES = {
    "embedding_norms": (embedding_norms, f"WITH {X} SELECT vec_id, round(sqrt(sum(x * x)), {DIGITS}) AS norm FROM x GROUP BY vec_id"),
    "embedding_lookup_all": (embedding_lookup_all, EMBEDDING_LOOKUP_ALL),
    "swiglu_all_rows": (swiglu_all_rows, SWIGLU_ALL),
    "linear_rows": (linear_rows, _linear_sql()),
    "rmsnorm": (_per_row(V.rmsnorm), _per_row_sql(f"x / sqrt(q / 64 + {EPS})", f"sum(x * x) {OVER} AS q")),
    "layer_norm": (_per_row(V.layer_norm), _per_row_sql(f"(x - a) / sqrt(s + {EPS})", f"avg(x) {OVER} AS a, var_pop(x) {OVER} AS s")),
    "softmax_rows": (_per_row(V.softmax), _per_row_sql(f"exp(x - m) / sum(exp(x - m)) {OVER}", LSE)),
    "log_softmax_rows": (_per_row(V.log_softmax), _per_row_sql(f"x - m - ln(sum(exp(x - m)) {OVER})", LSE)),
    "silu_rows": (_per_row(lambda v: F.transform(v, V.silu)), _per_row_sql("x / (1 + exp(-x))")),
    "gelu_rows": (_per_row(lambda v: F.transform(v, V.gelu)), _per_row_sql("0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x)))")),
    "rope_rows": (rope_rows, ROPE),
    "causal_attention": (causal_attention, CAUSAL_ATTENTION),
    "masked_attention": (masked_attention, MASKED_ATTENTION),
    "attention_gradients": (attention_gradients, ATTENTION_GRADIENTS),
    "learned_positions": (learned_positions, LEARNED_POSITIONS),
    "eval_batches": (eval_batches, EVAL_BATCHES),
    "replicated_state": (replicated_state, REPLICATED_STATE),
    "flat_gradient_mean": (flat_gradient_mean, FLAT_GRADIENT_MEAN),
    "attention_peaks": (attention_peaks, ATTENTION_PEAKS),
    "memory_profile": (memory_profile, MEMORY_PROFILE),
    "block_attention": (block_attention, BLOCK_ATTENTION),
    "online_logsumexp": (online_logsumexp, ONLINE),
    "cross_entropy_ppl": (cross_entropy_ppl, CROSS_ENTROPY),
    "top_p_filter": (top_p_filter, TOP_P),
    "top_k_filter": (top_k_filter, TOP_K),
    "lr_cosine": (lr_cosine, LR_COSINE),
    "adamw_steps": (adamw_steps, _adamw_sql()),
    "grad_clip": (grad_clip, GRAD_CLIP),
    "param_counts": (param_counts, PARAM_COUNTS),
    "gradient_buckets": (gradient_buckets, BUCKETS),
    "gradient_mean": (gradient_mean, GRADIENT_MEAN),
    "shard_owners": (shard_owners, OWNERS),
    "bench_summary": (bench_summary, BENCH_SUMMARY),
    "bench_speedup": (bench_speedup, BENCH_SPEEDUP),
    "bench_sweep": (bench_sweep, BENCH_SWEEP),
    "reduce_latency": (reduce_latency, REDUCE_LATENCY),
    "isoflop_minima": (isoflop_minima, ISOFLOP),
    "scaling_fit": (scaling_fit, SCALING_FIT),
}
