"""Queries of byte-level BPE and token streams, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import bpe, tokens
from textloom.session import materialize
from textloom.sources.tables import table

MERGES, VOCAB, SEQUENCE = 6, 400, 512
WINDOW, SAMPLES, STRIDE = 16, 64, 7919
#: Ids of a block of a stored stream.
BLOCK = 4096

#: DuckDB's patterns can't look ahead, so the last white space before a word is set apart by a mark first.
PRETOKENS = r"""
pt AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '(\s)(\S)', chr(57344) || '\1\2', 'g'),
  '''(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}' || chr(57344) || ']+|\s+') AS p FROM documents)"""
COUNTS = f"{PRETOKENS}, pc AS (SELECT pretoken, count(*) AS n FROM (SELECT unnest(p) AS pretoken FROM pt) GROUP BY pretoken)"
WORDS = f"{COUNTS}, w0 AS (SELECT regexp_replace(lower(hex(encode(pretoken))), '(..)', '«\\1»', 'g') AS word, n FROM pc)"


def _pairs(words: str) -> str:
    t = f"SELECT n, string_split(regexp_replace(word, '^«|»$', '', 'g'), '»«') AS t FROM {words}"
    return f"SELECT p[1] AS l, p[2] AS r, sum(n)::BIGINT AS n FROM (SELECT n, unnest([[t[i], t[i + 1]] for i in range(1, len(t))]) AS p FROM ({t})) GROUP BY ALL"


def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.pretoken_counts(table(spark, sf_dir, "documents"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pretoken_counts(spark, sf_dir).select(bpe.as_word(F.col("pretoken")).alias("word"), "n")


def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.pair_counts(_words(spark, sf_dir))


def bpe_first_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = bpe.train_distributed(pretoken_counts(spark, sf_dir), MERGES)
    return spark.createDataFrame([(k, left.hex(), right.hex()) for k, (left, right) in enumerate(merges)], "rank long, left string, right string")


def _merges_sql() -> str:
    return f"WITH {WORDS}{_merged_sql(MERGES)} " + " UNION ALL ".join(f'SELECT {k}::BIGINT AS rank, l AS "left", r AS "right" FROM m{k}' for k in range(MERGES))


def _merged_sql(merges: int) -> str:
    """``m0, w1, m1, ...``: each merge, and the words after it."""
    out = ""
    for k in range(merges):
        out += f", m{k} AS MATERIALIZED ({_pairs(f'w{k}')} ORDER BY n DESC, l DESC, r DESC LIMIT 1)"
        out += f", w{k + 1} AS MATERIALIZED (SELECT w{k}.* REPLACE (replace(word, '«' || l || '»«' || r || '»', '«' || l || r || '»') AS word) FROM w{k}, m{k})"
    return out


#: Merges that a vocabulary of VOCAB tokens has beside the bytes and one special token.
ALL_MERGES = VOCAB - 257


def _encode_lengths_sql() -> str:
    """Training and encoding in SQL: every pre-token with its merges applied, counted in every document."""
    words = WORDS.replace("AS word, n FROM pc", "AS word, n, pretoken FROM pc")
    return f"""WITH {words}{_merged_sql(ALL_MERGES)}, z AS (SELECT pretoken, len(word) - len(replace(word, '«', '')) AS k FROM w{ALL_MERGES}),
t AS (SELECT doc_id, sum(k) AS k FROM (SELECT doc_id, unnest(p) AS pretoken FROM pt) JOIN z USING (pretoken) GROUP BY doc_id)
SELECT doc_id, coalesce(k, 0)::BIGINT AS tokens FROM documents LEFT JOIN t USING (doc_id)"""


def _longest_sql() -> str:
    made = " UNION ALL ".join(f"SELECT {257 + k}::BIGINT AS id, upper(l || r) AS token_hex FROM m{k}" for k in range(ALL_MERGES))
    return f"""WITH {WORDS}{_merged_sql(ALL_MERGES)}, v AS (SELECT i::BIGINT AS id, printf('%02X', i) AS token_hex FROM range(0, 256) b(i)
UNION ALL SELECT 256, hex(encode('<|endoftext|>')) UNION ALL {made})
SELECT id, token_hex, (len(token_hex) // 2)::BIGINT AS bytes FROM v ORDER BY bytes DESC, id LIMIT 1"""


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bpe.Tokenizer]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = bpe.train(bpe.pretoken_counts(docs), VOCAB, ["<|endoftext|>"])
    return bpe.encode(docs, tokenizer), tokenizer


def bpe_encode_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, _ = _encoded(spark, sf_dir)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("tokens"))


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, tokenizer = _encoded(spark, sf_dir)
    return bpe.decode(encoded, tokenizer).select("doc_id", (F.col("decoded") == F.col("text")).alias("ok"))


def bpe_longest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tokenizer = _encoded(spark, sf_dir)
    vocab = spark.createDataFrame(list(tokenizer.vocab.items()), "id long, token binary")
    best = F.min_by(F.struct("id", F.hex("token").alias("token_hex"), F.octet_length("token").cast("long").alias("bytes")), F.struct(-F.octet_length("token"), F.col("id")))
    return vocab.agg(best.alias("b")).select("b.*")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens of each document and one for its end."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(bpe.pretokens(F.col("text"))) + 1).cast("long").alias("tokens"))


SIZES = f"{PRETOKENS}, sz AS (SELECT doc_id, (len(p) + 1)::BIGINT AS tokens FROM pt)"


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))


TOKEN_STATS = f"WITH {SIZES} SELECT count(*) AS docs, sum(tokens)::BIGINT AS tokens, max(tokens) AS longest FROM sz"


def token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tokens.packed(tokens.running_offsets(_sizes(spark, sf_dir), "doc_id", "tokens"), SEQUENCE)
    return placed.select("doc_id", "tokens", "offset", "first_seq", "last_seq")


TOKEN_PACKING = f"""
WITH {SIZES}, of AS (SELECT *, (sum(tokens) OVER (ORDER BY doc_id) - tokens)::BIGINT AS "offset" FROM sz)
SELECT doc_id, tokens, "offset", "offset" // {SEQUENCE} AS first_seq, ("offset" + tokens - 1) // {SEQUENCE} AS last_seq FROM of"""


def batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the stream of pre-token lengths (0 ends a document), from starts of a fixed rule."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(bpe.pretokens(F.col("text")), lambda p: F.length(p)).alias("t"))
    stream = materialize(tokens.blocks(docs.select("doc_id", F.concat("t", F.array(F.lit(0))).alias("ids")), BLOCK), "blocks")
    n = stream.agg(F.sum(F.size("ids").cast("long"))).first()[0]
    starts = spark.range(SAMPLES).select(F.col("id").alias("sample"), (F.col("id") * STRIDE % (n - WINDOW)).alias("start"))
    return tokens.block_windows(stream, starts, WINDOW, BLOCK).select("sample", "start", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


BATCH_WINDOWS = f"""
WITH {PRETOKENS},
st AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS pos, token FROM (SELECT doc_id, unnest(range(0, len(t))) AS k, unnest(t) AS token
       FROM (SELECT doc_id, list_append(list_transform(p, lambda x: length(x)), 0) AS t FROM pt))),
nn AS (SELECT count(*) AS n FROM st),
ss AS (SELECT i AS sample, i * {STRIDE} % (n - {WINDOW}) AS start FROM range(0, {SAMPLES}) r(i), nn)
SELECT sample, start, string_agg(token::VARCHAR, ' ' ORDER BY pos) FILTER (pos < start + {WINDOW}) AS x, string_agg(token::VARCHAR, ' ' ORDER BY pos) FILTER (pos > start) AS y
FROM ss JOIN st ON pos BETWEEN start AND start + {WINDOW} GROUP BY sample, start"""


def vocab_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest id, after a check that would fail on any id outside the vocabulary."""
    encoded, _ = _encoded(spark, sf_dir)
    ids = encoded.select(F.explode("ids").alias("id")).select(tokens.check_range(F.col("id"), VOCAB).alias("id"))
    return ids.agg((F.max("id") < VOCAB).alias("ok"), (F.min("id") >= 0).alias("from_zero"))


QUERIES = {
    "pretoken_counts": (pretoken_counts, f"WITH {COUNTS} SELECT pretoken, n FROM pc"),
    "bpe_pair_counts": (bpe_pair_counts, f'WITH {WORDS} SELECT l AS "left", r AS "right", n FROM ({_pairs("w0")})'),
    "bpe_first_merges": (bpe_first_merges, _merges_sql()),
    "bpe_encode_lengths": (bpe_encode_lengths, _encode_lengths_sql()),
    "bpe_roundtrip": (bpe_roundtrip, "SELECT doc_id, true AS ok FROM documents"),
    "bpe_longest_token": (bpe_longest_token, _longest_sql()),
    "token_stats": (token_stats, TOKEN_STATS),
    "token_packing": (token_packing, TOKEN_PACKING),
    "batch_windows": (batch_windows, BATCH_WINDOWS),
    "vocab_range": (vocab_range, "SELECT true AS ok, true AS from_zero"),
}
