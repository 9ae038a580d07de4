"""The scrub on a stream: the same projections as in batch, and windowed counts of what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scrub import match
from ..plans.config import ScrubConfig


def masked_stream(docs: DataFrame, config: ScrubConfig, text: str = "text") -> DataFrame:
    """A stream of documents with masked texts and summaries; stateless, so any output mode and any recovery works."""
    return match(docs, config, text)


def counts_by_window(matched: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Hits by key in windows of event time; rows later than ``late`` are left out."""
    each = matched.withWatermark(time, late).select(time, F.explode_outer("by_key").alias("key", "n")).where("key IS NOT NULL")
    return each.groupBy(F.window(time, width), "key").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))
