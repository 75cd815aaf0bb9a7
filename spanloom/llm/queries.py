"""The registered queries of these operators: thin digests of the operators' outputs on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, itq, jaccard, language, lexical, lines, mixing, negatives, packing, quality, recompression, secrets, warc
from .common import table


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind != "cnn")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [n(kind) for kind in secrets.KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_scored", F.array_max(F.transform("spans", lambda s: s.p)).alias("best_p"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup_substrings(table(spark, sf_dir, "documents"), window=35).drop("kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path, index = warc.write_warc(pages, min_bytes=0)
    got = warc.read_warc(path, index)
    response = F.col("h_type") == "response"
    return got.select(
        F.col("key").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(response, warc.base32_sha1(F.sha1("payload"))).otherwise(F.col("h_digest")).alias("payload_digest"),
        F.col("h_type").alias("record_type"),
        F.col("h_refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), word_bpe_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "lang_id", "lang_posterior", "lang_kept")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_language(table(spark, sf_dir, "pages")).select("page_id", "lang_id", "lang_posterior", "lang_kept")


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_benchmark_decontamination, op3_secret_scan, op4_ngram_jaccard, op5_lm_score, op6_quality, op7_substring_dedup, op8_warc, op9_packing, op10_language_id, op11_line_dedup, op12_lexical_search, op13_hard_negatives, language_id_pages)}

ORACLES: dict[str, str] = {"op11_line_dedup": lines.op11_sql(), "op12_lexical_search": lexical.op12_sql(), "op13_hard_negatives": negatives.op13_sql()}
