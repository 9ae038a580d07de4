"""A training-data pipeline of five stages, each written and read again as the next one's documents.

``STAGES``: quality rules, near-dedup, secret scans, mixing to target weights, packing.  All but the last return the
columns of ``documents``.  SQL cannot express XXH64 hashes, so ``ORACLE_SQL`` is None and the stages are tested against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import mixing, near_texts, packing, quality_rules, secret_scan
from veilframe.llm.common import row_key, stored, whole_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive fences keep, all their columns as they are.

    A null or empty text has no words and fails the base rules; equal rows fare alike and all stay; a null language or source is a group of its own; an empty table gives an empty one; columns of any name may stand beside.
    """
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of texts whose five-word shingles have a Jaccard of 0.8 or more: the SimHash trie join's links, then what it leaves apart.

    Null and empty texts are alike and so one group; of equal rows one stays; rows of a null id are told apart by their texts, and a group whose smallest ids are equal or all null keeps one row; texts of fewer than five words are compared whole.
    An empty table gives an empty one; columns of any name may stand beside.
    """
    return near_texts.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secret values replaced; ``n_chars`` follows the text (null for a null text).

    A null text stays null and an empty one empty; repeated rows stay repeated; an empty table gives an empty one; columns of any name may stand beside, as in :func:`veilframe.llm.secret_scan.redact`.
    """
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes of it: whole repetitions, then one more whose chance is the fraction left.

    Null and empty texts have no words, so the mix takes none of them; rows of equal id, text and source share the sum of their copies; a null source is a source, last in order; a null id is drawn as an empty one.
    An empty table gives an empty one; columns of any name may stand beside.
    """
    takes = mixing.mix(docs.select("doc_id", "source", "text", row_key("source").alias("key")), carried=("key",)).select("key", "doc_id", "size", "taken")
    copies = takes.groupBy("key").agg(F.sum(repetitions()).cast("int").alias("n")).where("n > 0")
    # rows of equal id, text and source share the sum of their copies
    out = whole_rows(docs, key=row_key("source")).join(copies, "key").dropDuplicates(["key"])
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def repetitions():
    """``taken / size`` rounded by a fixed hash of the id, so that sums come near their targets and reruns agree."""
    share = F.coalesce(F.col("taken") / F.when(F.col("size") > 0, F.col("size")), F.lit(0.0))
    chance = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return (F.floor(share) + F.when(chance < share - F.floor(share), 1).otherwise(0)).cast("int")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens.

    A null or empty text is one piece of the closing id; repeated rows are packed each; a null id stays null; an empty table gives no pieces; other columns are left out.
    """
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("secret scans", secrets), ("mixing to target weights", mixed), ("packing", packed)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
