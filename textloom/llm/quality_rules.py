"""Quality rules per document and per host.

Each document gets five figures from one projection of built-in functions. Rule failures
are then counted by host (the ``source`` column, or any other), each host's failure rate
is shrunk with a beta prior fitted to all hosts (method of moments), and hosts whose
shrunk rate exceeds a limit are rejected with all their documents.

Scale: the projection needs no shuffle; the host totals are partial aggregates, so a host
with a third of all rows sends one row per task; one row (the prior) goes to the driver;
host verdicts join back on the host, where adaptive execution broadcasts or splits.

Defined results: null or blank text has no words and fails the base rule; a null host is
a host of its own; very long texts are judged whole; repeated rows are judged (and counted) one by one; an empty table
gives an empty table; input columns named like a result (the figures, ``base_failed``, ``symbols_failed``, ``kept``) are
replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import unused

#: The separators of words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document with more symbols than words fails the symbol rule.
MAX_SYMBOLS_PER_WORD = 1
#: Hosts with a shrunk failure rate above this are rejected.
MAX_HOST_RATE = 0.8

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class BetaPrior:
    alpha: float
    beta: float


def _repeat_words(words: str) -> str:
    """SQL for the number of words inside 3-word windows that occur at least twice.

    Windows are hashed to 64 bits, sorted with their position, and equal neighbours kept;
    the sorted positions then give the covered words without counting any twice.
    """
    hashes = f"transform({words}, x -> xxhash64(x))"
    windows = "transform(sequence(0, size(hs) - 3), i -> struct(xxhash64(hs[i], hs[i + 1], hs[i + 2]) as h, i as i))"
    twins = (
        "filter(sequence(0, size(ws) - 1), k -> (k > 0 and ws[greatest(k - 1, 0)].h = ws[k].h) "
        "or (k < size(ws) - 1 and ws[least(k + 1, size(ws) - 1)].h = ws[k].h))"
    )
    at = "array_sort(transform(ks, k -> ws[k].i))"
    covered = "aggregate(sequence(0, size(ps) - 1), 3L, (a, k) -> a + if(k = 0, 0, least(3, ps[k] - ps[greatest(k - 1, 0)])))"
    inner = f"transform(array({at}), ps -> if(size(ps) = 0, 0L, {covered}))[0]"
    inner = f"transform(array({twins}), ks -> {inner})[0]"
    inner = f"transform(array(array_sort({windows})), ws -> {inner})[0]"
    inner = f"transform(array({hashes}), hs -> {inner})[0]"
    return f"if(size({words}) < 4, 0L, {inner})"


def figures(text: str = "text") -> Column:
    """A struct of the five figures of the text column."""
    space = SPACE.replace("\\", "\\\\")
    words = f"filter(split(coalesce({text}, ''), '{space}+'), x -> x <> '')"
    lines = f"filter(split(coalesce({text}, ''), '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    return F.expr(
        f"transform(array({words}), w -> transform(array({lines}), l -> named_struct("
        "'n_words', cast(size(w) as bigint), "
        "'word_chars', aggregate(w, 0L, (a, x) -> a + length(x)), "
        f"'n_symbols', cast(regexp_count(coalesce({text}, ''), '{SYMBOLS}') as bigint), "
        "'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint), "
        f"'n_repeat_words', {_repeat_words('w')}))[0])[0]"
    )


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words)


def symbols_failed() -> Column:
    return F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")


def with_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five figures and the two rule results to every row."""
    struct = unused(docs, "figures")
    out = docs.withColumn(struct, figures(text))
    out = out.withColumns({name: F.col(f"{struct}.{name}") for name in FIGURES}).drop(struct)
    return out.withColumns({"base_failed": base_failed(), "symbols_failed": symbols_failed()})


def host_counts(judged: DataFrame, host: str = "source") -> DataFrame:
    """Documents and documents that fail a rule, by host."""
    failed = (F.col("base_failed") | F.col("symbols_failed")).cast("long")
    return judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(failed).alias("failures"))


def fit_prior(hosts: DataFrame) -> BetaPrior:
    """Method of moments over the hosts' failure rates; one row reaches the driver."""
    rate = F.col("failures") / F.col("docs")
    mean, var = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    mean = min(max(mean if mean is not None else 0.5, 1e-6), 1 - 1e-6)
    spread = mean * (1 - mean)
    strength = spread / var - 1 if var and 0 < var < spread else 2.0
    strength = min(max(strength, 2.0), 1e4)
    return BetaPrior(mean * strength, (1 - mean) * strength)


def host_verdicts(hosts: DataFrame, prior: BetaPrior) -> DataFrame:
    """Add the shrunk failure rate and ``host_rejected``."""
    rate = (F.col("failures") + prior.alpha) / (F.col("docs") + prior.alpha + prior.beta)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > MAX_HOST_RATE)


def judge(judged: DataFrame, host: str = "source") -> DataFrame:
    """Add ``kept`` to rows of :func:`with_figures`: neither rule fails and the host isn't rejected."""
    hosts = host_counts(judged, host)
    key, verdict = unused(judged, "host"), unused(judged, "rejected")
    rejected = host_verdicts(hosts, fit_prior(hosts)).where("host_rejected").select(F.col("host").alias(key), F.col("host_rejected").alias(verdict))
    out = judged.join(rejected, F.col(host).eqNullSafe(F.col(key)), "left").drop(key)
    bad = F.coalesce(F.col(verdict), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("symbols_failed") & ~bad).drop(verdict)


def oracle() -> str:
    """DuckDB SQL for the figures, the base rule and the verdict of every document."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
e AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM e)),
twin AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p)::BIGINT AS c FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twin) GROUP BY rid),
f AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c, 0) AS n_repeat_words
      FROM e LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
      n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words AS symbols_failed FROM f),
h AS (SELECT source, count(*) AS docs, sum((base_failed OR symbols_failed)::INT)::BIGINT AS failures FROM b GROUP BY source),
p AS (SELECT least(greatest(avg(failures / docs), 1e-6), 1 - 1e-6) AS m, var_samp(failures / docs) AS v FROM h),
q AS (SELECT m, least(greatest(CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 2.0 END, 2.0), 1e4) AS s FROM p),
r AS (SELECT source, (failures + m * s) / (docs + s) > {MAX_HOST_RATE} AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT symbols_failed AND NOT r.bad AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source"""
