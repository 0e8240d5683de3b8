"""The queries opN_<name> of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import merkle, mixing, ngram_join, packing, png_media, quality_rules, sharding, token_store, toxicity, url_filter, warc, whitening, wrappers
from textloom.session import materialize, new_dir
from textloom.sources.tables import table

#: 3-word shingles; a link needs a Jaccard similarity of 0.9.
LINKS = ngram_join.JoinSpec(n=3, num=90, den=100)


@cache
def url_model() -> url_filter.UrlModel:
    return url_filter.train(url_filter.labelled_urls())


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 3-word shingle sets with a Jaccard similarity of 0.9."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), LINKS)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to a token store and read back from its files."""
    folder = new_dir(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return token_store.read(spark, folder)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, base rule and verdict of every document; hosts are the sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged = materialize(quality_rules.with_figures(docs).drop("text"), "quality")
    return quality_rules.judge(judged).select("doc_id", *quality_rules.FIGURES, "base_failed", "kept")


def op4_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def held_out() -> Column:
    """Documents that no model is trained on."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(toxicity.sample(docs, labels, "toxic", ~held_out()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    folder = new_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("url")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the n-gram model."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_model()).select("page_id", "host", "path", "rule", "verdict")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a PNG in a Parquet table, read back, checked and hashed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    return png_media.read(materialize(png_media.store(docs, "payload"), "media"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what its proof says of it where one in seven was tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proved = merkle.prove(merkle.leaves(table(spark, sf_dir, "documents"), tampered), "lang", ["doc_id"])
    checked = merkle.verify(proved, F.coalesce("changed", "leaf"))
    digests = [merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return checked.select("doc_id", *digests, merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every sound vector on the four strongest components."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    shares = F.array(*(F.lit(float(e)) for e in model.explained)).cast("array<double>")
    out = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as long)").alias("deviation"),
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op13_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to the files of 40 shards and read back; its shard with one more beside it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_dir(spark, "shards")
    sharding.write(docs, folder)
    rows = sharding.read(spark, folder, docs.schema).select("row.doc_id", "row.text", "shard", "slot")
    text = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    grown = sharding.shard_of(F.col("doc_id"), sharding.SHARDS + 1)
    return rows.select("doc_id", sharding.size_bytes().alias("size"), text.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_store, op3_quality_rules, op4_html_wrappers, op5_toxicity, op6_warc, op7_best_fit_packing, op8_url_filter, op9_source_mixing, op10_png_media, op11_merkle_manifest, op12_embedding_whitening, op13_jump_sharding)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_join.oracle(LINKS),
        "op3_quality_rules": quality_rules.oracle(),
        "op6_warc": warc.oracle(),
        "op8_url_filter": url_filter.oracle(url_model()),
        "op11_merkle_manifest": merkle.oracle(),
        "op13_jump_sharding": sharding.oracle(),
    }
