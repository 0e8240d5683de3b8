"""Queries of text functions, rules, masking and the document filter, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import pii, rules, text, url
from textloom.operators import curation
from textloom.session import materialize, new_dir
from textloom.sources import archives
from textloom.sources.html import plain_text, plain_text_sql
from textloom.sources.tables import table

NORM = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ')"
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"
LINES = r"regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c]')"
KEYWORDS = "[" + ", ".join(f"'{k}'" for k in rules.BLOCKED_KEYWORDS) + "]"
PARKED = "[" + ", ".join(f"'{k}'" for k in rules.PARKED_PHRASES) + "]"


def text_normalize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("chars"), F.size(text.words(F.col("t"))).cast("long").alias("words"), text.digest(F.col("t")).alias("sha1"))


TEXT_NORMALIZE_STATS = rf"""
SELECT doc_id, length(t)::BIGINT AS chars, len(list_filter(string_split(t, ' '), lambda w: w <> ''))::BIGINT AS words, sha1(t) AS sha1
FROM (SELECT doc_id, {NORM} AS t FROM documents)"""


def _gopher(spark: SparkSession, sf_dir: str, words) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.gopher(words(F.col("text")), text.lines(F.col("text"))).alias("g")).select("doc_id", "g.*")


def gopher_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gopher(spark, sf_dir, text.words)


def gopher_rules_treebank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gopher(spark, sf_dir, text.treebank)


def _gopher_sql(words: str) -> str:
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w, list_filter(list_transform({LINES}, lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS l FROM documents),
e AS (SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS c, len(l) AS ls,
      len(list_filter(l, lambda x: ends_with(x, '...'))) AS dots, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS a FROM d)
SELECT *, word_count_ok AND mean_length_ok AND ellipsis_ok AND alpha_ok AS keep FROM (
SELECT doc_id, n BETWEEN 50 AND 100000 AS word_count_ok, n > 0 AND c >= 3 * n AND c <= 10 * n AS mean_length_ok,
       ls > 0 AND 10 * dots <= 3 * ls AS ellipsis_ok, n > 0 AND 5 * a >= 4 * n AS alpha_ok FROM e)"""


def boilerplate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rules.boilerplate(text.lines(F.col("text")), text.normalize(F.col("text")))
    out = docs.select("doc_id", found.alias("b")).select("doc_id", "b.*")
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("lines", "distinct_lines", "words", "distinct_words", "nav_hits")), "keep")


_NAV = " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in rules.NAVIGATION_PHRASES)
BOILERPLATE_CTES = rf"""
bd AS (SELECT doc_id, lower({NORM}) AS t,
      list_filter(list_transform({LINES}, lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g'), ' '))), lambda x: x <> '') AS l FROM documents),
be AS (SELECT doc_id, len(l)::BIGINT AS lines, len(list_distinct(l))::BIGINT AS distinct_lines,
      list_filter(string_split(t, ' '), lambda x: x <> '') AS w, ({_NAV})::BIGINT AS nav_hits FROM bd),
bf AS (SELECT doc_id, lines, distinct_lines, len(w)::BIGINT AS words, len(list_distinct(w))::BIGINT AS distinct_words, nav_hits FROM be),
b AS (SELECT *, NOT (lines >= 5 AND 5 * distinct_lines < 4 * lines) AND words > 0 AND NOT (words >= 80 AND 100 * nav_hits > 3 * words)
       AND NOT (words >= 200 AND 4 * distinct_words < words) AS keep FROM bf)"""
BOILERPLATE_RULES = f"WITH {BOILERPLATE_CTES} SELECT * FROM b"


def blocked_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("t", text.normalize(plain_text(F.col("html"))))
    hits = rules.keyword_hits(F.col("url"), F.col("t")).cast("long")
    return pages.select("page_id", hits.alias("hits"), (hits < 2).alias("keep"))


BLOCKED_TOPIC = rf"""
SELECT page_id, hits, hits < 2 AS keep FROM (SELECT page_id, len(list_filter({KEYWORDS}, lambda k: contains(s, k)))::BIGINT AS hits FROM
(SELECT page_id, lower(coalesce(url, '') || ' ' || substr(trim(regexp_replace({plain_text_sql("html")}, '\s+', ' ', 'g'), ' '), 1, {rules.KEYWORD_CHARS})) AS s FROM pages))"""


def parked_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("t", text.normalize(plain_text(F.col("html"))))
    return pages.select("page_id", (~rules.is_parked(F.col("t"))).alias("keep"))


PARKED_DOMAIN = rf"""
SELECT page_id, len(list_filter({PARKED}, lambda k: contains(lower(trim(regexp_replace({plain_text_sql("html")}, '\s+', ' ', 'g'), ' ')), k))) = 0 AS keep FROM pages"""


def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask_all(table(spark, sf_dir, "documents")).select("doc_id", "masked", "emails", "phones", "ips")


MASK_PII = f"WITH {pii.mask_all_sql('documents')} SELECT doc_id, masked, emails, phones, ips FROM masked_ips"


def pii_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.mask_all(table(spark, sf_dir, "documents"))
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("emails", "phones", "ips")]
    return found.agg(*total, F.count(F.when(F.col("emails") + F.col("phones") + F.col("ips") > 0, 1)).alias("docs_modified"))


PII_TOTALS = f"""WITH {pii.mask_all_sql('documents')}
SELECT sum(emails)::BIGINT AS emails, sum(phones)::BIGINT AS phones, sum(ips)::BIGINT AS ips, count(*) FILTER (emails + phones + ips > 0) AS docs_modified FROM masked_ips"""


def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"), url.registered_domain(F.col("url")).alias("domain"))


def _domain_sql(column: str) -> str:
    h = f"lower(regexp_extract(coalesce({column}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    return (
        f"CASE WHEN {h} = '' THEN coalesce({column}, '') WHEN regexp_matches({h}, '^[0-9.]+$') THEN {h} "
        f"ELSE array_to_string(list_slice(string_split({h}, '.'), CASE WHEN array_to_string(string_split({h}, '.')[-2:], '.') IN "
        f"({', '.join(repr(s) for s in url.TWO_LABEL_SUFFIXES)}) THEN -3 ELSE -2 END, -1), '.') END"
    )


URL_DOMAIN = f"""
SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, {_domain_sql("url")} AS domain FROM pages"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source as the address, the given language, and the toxic label as the harm score."""
    docs = table(spark, sf_dir, "documents").withColumn("uri", F.col("source"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic_label"))
    docs = docs.join(labels, "doc_id", "left")
    toxic = F.when(F.coalesce("toxic_label", F.lit(0)) == 1, "toxic").otherwise("non-toxic")
    config = curation.FilterConfig()
    harmful = curation.harm(F.lit("non-nsfw"), F.lit(1.0), toxic, F.lit(1.0), config)
    return curation.first_failure(docs, F.col("lang"), F.lit(1.0), harmful, config)


_JUDGED = rf"""
{BOILERPLATE_CTES},
j0 AS (SELECT d.doc_id, d.source, d.lang, {NORM.replace("text", "d.text")} AS one, {WORDS.replace("text", "d.text")} AS w, b.keep AS bp, coalesce(t.toxic, 0) AS toxic
       FROM documents d JOIN b USING (doc_id) LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) t USING (doc_id)),
j1 AS (SELECT *, lower(source || ' ' || substr(one, 1, {rules.KEYWORD_CHARS})) AS s, len(w) AS n,
       coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS c, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS a FROM j0),
judged AS (SELECT *, CASE WHEN source IS NULL THEN 'missing_uri' WHEN one = '' THEN 'empty_text' WHEN length(one) < 200 OR n < 50 THEN 'too_short'
       WHEN len(list_filter({KEYWORDS}, lambda k: contains(s, k))) >= 2 THEN 'blocked_topic'
       WHEN len(list_filter({PARKED}, lambda k: contains(lower(one), k))) > 0 THEN 'parked_domain'
       WHEN lang <> 'en' THEN 'non_english'
       WHEN NOT (n BETWEEN 50 AND 100000 AND c >= 3 * n AND c <= 10 * n AND NOT ends_with(one, '...') AND 5 * a >= 4 * n) THEN 'low_gopher_quality'
       WHEN NOT bp THEN 'boilerplate' WHEN toxic = 1 THEN 'toxic' END AS reason FROM j1),
passed AS (SELECT doc_id, source, one FROM judged WHERE reason IS NULL),
{pii.mask_all_sql("passed", "one", "doc_id, source")},
h AS (SELECT *, row_number() OVER (PARTITION BY sha1(masked) ORDER BY doc_id) AS nth FROM masked_ips),
o AS (SELECT *, nth > 1 AS dup, row_number() OVER (PARTITION BY source, nth > 1 ORDER BY doc_id) AS place FROM h)"""

#: A cap that binds on the small tables.
CAP = 10


def pii_totals_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is masked in the documents that pass the rules, in all."""
    found = pii.mask_all(_judged(spark, sf_dir).where("reason is null"), "normalized")
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("emails", "phones", "ips")]
    return found.agg(*total, F.count(F.when(F.col("emails") + F.col("phones") + F.col("ips") > 0, 1)).alias("docs_modified"))


PII_TOTALS_PASSED = f"""WITH {_JUDGED}
SELECT coalesce(sum(emails), 0)::BIGINT AS emails, coalesce(sum(phones), 0)::BIGINT AS phones, coalesce(sum(ips), 0)::BIGINT AS ips, count(*) FILTER (emails + phones + ips > 0) AS docs_modified FROM masked_ips"""


def _curated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    judged = _judged(spark, sf_dir).select("doc_id", "source", "reason", F.when(F.col("reason").isNull(), F.col("normalized")).alias("normalized"))
    judged = materialize(judged, "judged")  # read twice: for the counts, and to go on with what passed
    return judged, curation.curate(judged, F.col("source"), [], config=curation.FilterConfig(max_per_domain=CAP))


def filter_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, curated = _curated(spark, sf_dir)
    return curation.failure_counts(judged.select("reason").unionByName(curated.select("reason")))


FILTER_FIRST_FAILURE = f"""
WITH {_JUDGED},
r AS (SELECT reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT CASE WHEN dup THEN 'exact_duplicate' WHEN place > {CAP} THEN 'domain_cap' END FROM o)
SELECT x.reason, count(r.reason) AS n FROM (SELECT unnest({list(curation.REASONS)}) AS reason) x LEFT JOIN r USING (reason) GROUP BY x.reason"""


def exact_doc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, curated = _curated(spark, sf_dir)
    return curated.where("reason is null or reason <> 'exact_duplicate'").select("doc_id")


EXACT_DOC_DEDUP = f"WITH {_JUDGED} SELECT doc_id FROM o WHERE NOT dup"


def domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, curated = _curated(spark, sf_dir)
    return curated.where("reason is null").groupBy("domain").agg(F.count(F.lit(1)).alias("kept"))


DOMAIN_CAP = f"WITH {_JUDGED} SELECT source AS domain, count(*) AS kept FROM o WHERE NOT dup AND place <= {CAP} GROUP BY source"


def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per source and merged over all."""
    judged, curated = _curated(spark, sf_dir)
    rows = judged.select("source", F.lit(1).alias("seen"), F.lit(0).alias("kept"))
    rows = rows.unionByName(curated.select("source", F.lit(0).alias("seen"), F.col("reason").isNull().cast("int").alias("kept")))
    totals = rows.rollup("source").agg(F.sum("seen").alias("records"), F.sum("kept").alias("kept"), F.grouping("source").cast("int").alias("total"))
    return totals


STATS_ROLLUP = f"""
WITH {_JUDGED}, x AS (SELECT source, 1 AS seen, 0 AS kept FROM judged UNION ALL SELECT source, 0, (NOT dup AND place <= {CAP})::INT FROM o)
SELECT source, sum(seen)::BIGINT AS records, sum(kept)::BIGINT AS kept, grouping(source)::INT AS total FROM x GROUP BY ROLLUP (source)"""


def records_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five records of each source, as if it were a file."""
    return curation.first_records(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


RECORDS_PER_FILE = "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5"


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", plain_text(F.col("html")).alias("text"))


HTML_TEXT = f"SELECT page_id, {plain_text_sql('html')} AS text FROM pages"


def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record of WET archives, and what the data source reads of them."""
    folder = new_dir(spark, "archives")
    id = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    archives.write_archives(table(spark, sf_dir, "pages").select(id.alias("id"), F.col("url").alias("uri"), F.col("html").alias("text")), folder)
    back = archives.read_archives(spark, folder, columns=["type", "id", "uri", "length", "text"], split_bytes=1 << 20).where("type = 'conversion'")
    return back.select(F.regexp_extract("id", "[0-9]+", 0).cast("long").alias("page_id"), F.col("uri").alias("url"), "length", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ARCHIVE_RECORDS = "SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS length, md5(coalesce(html, '')) AS text_md5 FROM pages"

QUERIES = {
    "archive_records": (archive_records, ARCHIVE_RECORDS),
    "text_normalize_stats": (text_normalize_stats, TEXT_NORMALIZE_STATS),
    "gopher_rules": (gopher_rules, _gopher_sql(WORDS)),
    "gopher_rules_treebank": (gopher_rules_treebank, _gopher_sql(text.treebank_sql("text"))),
    "boilerplate_rules": (boilerplate_rules, BOILERPLATE_RULES),
    "blocked_topic": (blocked_topic, BLOCKED_TOPIC),
    "parked_domain": (parked_domain, PARKED_DOMAIN),
    "mask_pii": (mask_pii, MASK_PII),
    "pii_totals": (pii_totals, PII_TOTALS),
    "pii_totals_passed": (pii_totals_passed, PII_TOTALS_PASSED),
    "url_domain": (url_domain, URL_DOMAIN),
    "filter_first_failure": (filter_first_failure, FILTER_FIRST_FAILURE),
    "exact_doc_dedup": (exact_doc_dedup, EXACT_DOC_DEDUP),
    "domain_cap": (domain_cap, DOMAIN_CAP),
    "stats_rollup": (stats_rollup, STATS_ROLLUP),
    "records_per_file": (records_per_file, RECORDS_PER_FILE),
    "html_text": (html_text, HTML_TEXT),
}
