"""Queries of line removal and fuzzy duplicates, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import dedup
from textloom.session import materialize, ship
from textloom.sources.tables import table

N, HASHES, BANDS = 5, 20, 10
FAMILY = dedup.hash_family(HASHES)

LINES = "l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))"


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))


LINE_DEDUP = f"""
WITH {LINES}, once AS (SELECT line FROM l GROUP BY line HAVING count(*) = 1),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l JOIN once USING (line) GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN k USING (doc_id)"""


def duplicate_lines_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent lines; a report."""
    counts = dedup.line_counts(dedup.exploded_lines(table(spark, sf_dir, "documents")))
    return counts.orderBy(F.desc("n"), "hash").limit(20)


DUPLICATE_LINES_TOPK = f"WITH {LINES} SELECT sha1(line) AS hash, count(*) AS n FROM l GROUP BY line ORDER BY n DESC, hash LIMIT 20"


def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dedup.gram_rows(table(spark, sf_dir, "documents"), N)


_GRAM = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(N))
GRAMS = rf"""
tk AS (SELECT doc_id, regexp_extract_all(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '\s+', ' ', 'g'), ' '), '[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, {_GRAM} AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - {N - 2})) AS i FROM tk WHERE len(t) >= {N})
      UNION SELECT doc_id, array_to_string(t, ' ') FROM tk WHERE len(t) BETWEEN 1 AND {N - 1}),
gn AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)"""
PAIRS = f"""{GRAMS},
jo AS (SELECT x.doc_id AS l, y.doc_id AS r, count(*) AS inter FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
jp AS (SELECT l, r, inter, a.n + b.n - inter AS uni FROM jo JOIN gn a ON a.doc_id = l JOIN gn b ON b.doc_id = r WHERE 5 * inter >= 4 * (a.n + b.n - inter))"""


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty n-grams in most documents; a report."""
    ship(spark)
    return dedup.frequent_grams(table(spark, sf_dir, "documents"), 50, N)


NGRAM_COUNTS = f"WITH {GRAMS} SELECT gram, count(*) AS docs FROM g GROUP BY gram ORDER BY docs DESC, gram LIMIT 50"


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dedup.document_pairs(table(spark, sf_dir, "documents"), N)


JACCARD_PAIRS = f"WITH {PAIRS} SELECT l, r, inter, uni::BIGINT AS uni FROM jp"

_H = "('0x' || substr(md5(gram), 1, 7))::BIGINT"
SIGNATURES = f"""{GRAMS}, gh AS (SELECT doc_id, {_H} AS h FROM g),
sg AS (SELECT doc_id, {", ".join(f"min(({a} * h + {b}) % {dedup.PRIME}) AS m{i}" for i, (a, b) in enumerate(FAMILY))} FROM gh GROUP BY doc_id)"""


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signatures = dedup.minhash(_grams(spark, sf_dir), FAMILY)
    return signatures.select("doc_id", F.posexplode("signature").alias("i", "h")).select("doc_id", F.col("i").cast("long").alias("i"), "h")


MINHASH_SIGNATURE = f"WITH {SIGNATURES} " + " UNION ALL ".join(f"SELECT doc_id, {i}::BIGINT AS i, m{i} AS h FROM sg" for i in range(HASHES))

_ROWS = HASHES // BANDS
KEYS = f"""{SIGNATURES}, kb AS ({" UNION ALL ".join(f"SELECT {b} AS band, concat_ws(',', {', '.join(f'm{b * _ROWS + k}' for k in range(_ROWS))}) AS key, doc_id FROM sg" for b in range(BANDS))}),
cp AS (SELECT DISTINCT x.doc_id AS l, y.doc_id AS r FROM kb x JOIN kb y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id)"""


def _keys(grams: DataFrame) -> DataFrame:
    return dedup.bands(dedup.minhash(grams, FAMILY), BANDS, HASHES)


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs, each document with the least of its bucket."""
    return dedup.candidate_stars(_keys(_grams(spark, sf_dir)))


LSH_CANDIDATES = f"WITH {KEYS}, st AS (SELECT min(doc_id) AS l, band, key FROM kb GROUP BY band, key) SELECT DISTINCT l, doc_id AS r FROM st JOIN kb USING (band, key) WHERE l < doc_id"


def lsh_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs of different n-gram sets, by their least documents, and every copy with the least document of its set."""
    return dedup.all_candidates(materialize(_grams(spark, sf_dir), "grams"), _keys)


LSH_CANDIDATE_PAIRS = f"""WITH {KEYS}, cs AS (SELECT doc_id, string_agg(gram, chr(10) ORDER BY gram) AS grams FROM g GROUP BY doc_id),
rp AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS rep FROM cs)
SELECT l, r, false AS copy FROM cp JOIN rp a ON a.doc_id = l AND a.rep = l JOIN rp b ON b.doc_id = r AND b.rep = r
UNION ALL SELECT rep, doc_id, true FROM rp WHERE rep < doc_id"""


def _pairs(spark: SparkSession, sf_dir: str, links_of=None) -> tuple[DataFrame, DataFrame]:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, materialize(dedup.document_links(docs, N, links_of), "links")


def fuzzy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.clusters(*_pairs(spark, sf_dir))


CLUSTERS = """
em AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gn)),
ed AS (SELECT l, r FROM {pairs} UNION SELECT r, l FROM {pairs} UNION SELECT a.doc_id, b.doc_id FROM em a, em b WHERE a.doc_id <> b.doc_id),
rc AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents UNION SELECT rc.a, ed.r FROM rc JOIN ed ON ed.l = rc.b),
cl AS (SELECT a AS doc_id, min(b) AS component FROM rc GROUP BY a)"""
FUZZY_CLUSTERS = f"WITH RECURSIVE {PAIRS}, {CLUSTERS.format(pairs='jp')} SELECT doc_id, component FROM cl"


def fuzzy_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(*_pairs(spark, sf_dir)).select("doc_id")


FUZZY_DEDUP_EXACT = f"WITH RECURSIVE {PAIRS}, {CLUSTERS.format(pairs='jp')} SELECT doc_id FROM cl WHERE doc_id = component"


def fuzzy_dedup_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash, bands, verification and clusters; in a bucket only pairs of different components are verified.

    Signatures are made of the documents that can have a partner at all: any other pair of a bucket fails the verification.
    """

    def banded(found: dedup.SimilarSets) -> DataFrame:
        sets = materialize(found.single(), "single")
        docs = table(spark, sf_dir, "documents").join(sets.select("doc_id"), "doc_id", "left_semi")
        keys = materialize(_keys(dedup.gram_rows(docs, N)), "keys")
        return dedup.bucket_links(keys, lambda pairs: dedup.verified(pairs, sets))

    return dedup.keep_first(*_pairs(spark, sf_dir, banded)).select("doc_id")


FUZZY_DEDUP_LSH = f"""WITH RECURSIVE {KEYS},
jp AS (SELECT l, r FROM (SELECT l, r, (SELECT count(*) FROM g x JOIN g y ON x.gram = y.gram WHERE x.doc_id = l AND y.doc_id = r) AS inter FROM cp)
       JOIN gn a ON a.doc_id = l JOIN gn b ON b.doc_id = r WHERE 5 * inter >= 4 * (a.n + b.n - inter)),
{CLUSTERS.format(pairs='jp')} SELECT doc_id FROM cl WHERE doc_id = component"""

def murmur_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures by 128-bit MurmurHash3, a seed each; SQL has no such hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.canonical(F.col("text")).alias("c"))
    words = docs.select("doc_id", text.tokens(F.col("c")).alias("t"))  # a column of its own: inside the n-grams it would be cut anew for each
    sets = words.select("doc_id", text.ngrams(F.col("t"), N).alias("grams"))
    found = dedup.murmur_signatures(sets, HASHES)
    return found.select("doc_id", F.posexplode("signature").alias("i", "h")).select("doc_id", F.col("i").cast("long").alias("i"), F.col("h").cast("string").alias("h"))


QUERIES = {
    "murmur_signature": (murmur_signature, None),
    "line_dedup": (line_dedup, LINE_DEDUP),
    "duplicate_lines_topk": (duplicate_lines_topk, DUPLICATE_LINES_TOPK),
    "ngram_counts": (ngram_counts, NGRAM_COUNTS),
    "jaccard_pairs": (jaccard_pairs, JACCARD_PAIRS),
    "minhash_signature": (minhash_signature, MINHASH_SIGNATURE),
    "lsh_candidates": (lsh_candidates, LSH_CANDIDATES),
    "lsh_candidate_pairs": (lsh_candidate_pairs, LSH_CANDIDATE_PAIRS),
    "fuzzy_clusters": (fuzzy_clusters, FUZZY_CLUSTERS),
    "fuzzy_dedup_exact": (fuzzy_dedup_exact, FUZZY_DEDUP_EXACT),
    "fuzzy_dedup_lsh": (fuzzy_dedup_lsh, FUZZY_DEDUP_LSH),
}
