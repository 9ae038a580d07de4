"""Queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, divergence, embedding_dedup, license_scan, mixing, packing, quality_knn, quality_rules, secret_scan, sharding, simhash, token_counts, treap_search
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``path, text, doc_id``: documents have no paths, so a hash of the id gives each a directory ``source/lang/a/b``.  Of those that speak of a licence three in four stand there, or one or two levels above, as the licence file ``LICENSE-<id>``; whether it states one is up to the scan."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    bits = lambda k, n: F.pmod(F.shiftright("crc", k), F.lit(n))
    keyed = docs.select("doc_id", "text", part("source").alias("s"), part("lang").alias("l"), part("doc_id").alias("i"), F.crc32(part("doc_id").cast("binary")).alias("crc"))
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    speaks = low.contains("licen") | low.contains("copyright") | low.contains("spdx") | low.contains("public domain")
    stands, up, top = speaks & (bits(2, 4) != 0), bits(4, 3), F.concat_ws("/", "s", "l")
    folder = F.when(stands & (up == 2), top).when(stands & (up == 1), F.concat_ws("/", top, bits(0, 2))).otherwise(F.concat_ws("/", top, bits(0, 2), bits(1, 2)))
    return keyed.select(F.concat_ws("/", folder, F.when(stands, F.concat(F.lit("LICENSE-"), "i")).otherwise(F.concat("i", F.lit(".txt")))).alias("path"), "text", "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(document_paths(table(spark, sf_dir, "documents")), carried=("doc_id",))
    return out.select("doc_id", "path", "own_license", "similarity", "license", "inherited_from")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"), F.col("n_examples").cast("long").alias("n_examples"), F.col("n_owned").cast("long").alias("n_owned"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = binpack.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_near_vectors": op5_near_vectors,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_best_fit": op12_best_fit,
    "op13_divergence": op13_divergence,
}
