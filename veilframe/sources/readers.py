"""Sources and sinks: documents from text, tables and files of several kinds; masked results and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A handful of literal texts as documents (``doc_id, text``)."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def documents(spark: SparkSession, path: str, kind: str = "parquet", text: str = "text", doc_id: str | None = "doc_id") -> DataFrame:
    """``doc_id, text`` of a table or of whole text files (``kind``: parquet, orc, json, csv, text); only the needed columns are read.

    Without an id column the id is a hash of the text, the same on every run; equal texts share it.
    """
    if kind == "text":
        files = spark.read.text(path, wholetext=True)
        return files.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"') if kind == "csv" else spark.read
    table = reader.format(kind).load(path)
    return table.select((F.col(doc_id) if doc_id else F.xxhash64(F.col(text).cast("string"))).alias("doc_id"), F.col(text).cast("string").alias("text"))


def file_kind(path: Column, content: Column) -> Column:
    """``pdf``, ``image`` or ``other``, by the first bytes, else by the name."""
    head = F.hex(F.substring(content, 1, 4))
    magic = F.when(head == "25504446", "pdf").when(head.startswith("FFD8FF") | head.isin("89504E47", "47494638", "52494646"), "image")
    named = F.when(F.lower(path).endswith(".pdf"), "pdf").when(F.lower(path).rlike("\\.(png|jpe?g|gif|webp|bmp)$"), "image").otherwise("other")
    return F.coalesce(magic, named)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, kind, content`` of binary files."""
    read = spark.read.format("binaryFile").load(path)
    return read.select("path", "length", file_kind(F.col("path"), F.col("content")).alias("kind"), "content")


def paged(pages: DataFrame) -> DataFrame:
    """``doc_id, text, pages, from_pdf`` from extracted pages (``doc_id, page_number, text``): a document without a text is its non-empty pages, a blank line between."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    joined = pages.groupBy("doc_id").agg(ordered.alias("pages"))
    texts = F.filter(F.transform("pages", lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != "")
    return joined.select("doc_id", F.array_join(texts, "\n\n").alias("text"), "pages", F.lit(True).alias("from_pdf"))


def write_masked(matched: DataFrame, path: str, kind: str = "parquet") -> None:
    """Masked texts with their ids."""
    matched.select("doc_id", "text_masked").write.format(kind).save(path)


def write_report(matched: DataFrame, path: str) -> None:
    """Counts and risk of each document, as JSON lines."""
    matched.select("doc_id", "hit_count", "by_key", "category_counts", "risk").write.json(path)
