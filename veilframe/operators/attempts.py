"""Fallback by attempts: a page is tried with one source of its text after the other, and only pages that the ones before left empty are tried again."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import ScrubConfig
from .spans import raw_hits, unmarked

PAGE = ["doc_id", "page_number"]


def kept(df: DataFrame) -> DataFrame:
    """A table that is read more than once: checkpointed where the session names a folder for that, else persisted (and worked out again if an executor is lost)."""
    context = df.sparkSession.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not named:
        return df.persist()
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return df.checkpoint()


def first_served(pages: DataFrame, attempts: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Pages with the first attempt that gave something: the rows of that attempt, with ``attempt``.

    An attempt is a name and a function from pages to rows (``doc_id, page_number`` and what it found; no row for a page it cannot serve; the same columns from all).  Each runs over the pages
    that those before it left, told by an anti join; once no page is left the rest are not run at all.  Pages that none serves have no row (:func:`audit` counts them).
    """
    left, done = pages, []
    for name, run in attempts:
        rows = kept(run(left).withColumn("attempt", F.lit(name)))
        done.append(rows)
        left = left.join(rows.select(*PAGE).distinct(), PAGE, "left_anti")
        if left.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, done)


def audit(pages: DataFrame, served: DataFrame) -> DataFrame:
    """``attempt, pages, rows``: how many pages each attempt served and with how many rows; null for those that none did."""
    each = served.groupBy(*PAGE, "attempt").agg(F.count("*").alias("n"))
    told = pages.select(*PAGE).distinct().join(each, PAGE, "left")
    return told.groupBy("attempt").agg(F.count("*").alias("pages"), F.sum(F.coalesce("n", F.lit(0))).alias("rows"))


def hit_attempts(texts: dict[str, Column], hits: Callable[[str], Column]) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """Attempts by several texts of a page: ``hits`` gives the array of hits over a named column; rows are ``doc_id, page_number, text, hits`` of pages with a hit."""

    def attempt(text: Column) -> Callable[[DataFrame], DataFrame]:
        def run(pages: DataFrame) -> DataFrame:
            tried = pages.select(*PAGE, F.coalesce(text.cast("string"), F.lit("")).alias("text")).withColumn("_text", unmarked(F.col("text")))
            found = tried.select(*PAGE, "text", hits("_text").alias("hits"))
            return found.where(F.size("hits") > 0)

        return run

    return [(name, attempt(text)) for name, text in texts.items()]


def page_hits(pages: DataFrame, texts: dict[str, Column], config: ScrubConfig) -> DataFrame:
    """Hits of the planned rules on each page by the first of its texts that has any: ``doc_id, page_number, text, hits, attempt``."""
    return first_served(pages, hit_attempts(texts, lambda text: raw_hits(text, replace(config, from_pdf=True))))
