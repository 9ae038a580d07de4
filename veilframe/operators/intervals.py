"""Interval joins by position bins: an equi-join that Spark can deal out, in place of comparing all ranges of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions in a bin: of texts whose ranges are pages, and of pages whose ranges are items.
PAGE_BIN, ITEM_BIN = 2048, 64


def _binned(rows: DataFrame, start: str, end: str, width: int, first: str) -> DataFrame:
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    low = bin_of(F.col(start))
    return rows.withColumn(first, low).withColumn("_bin", F.explode(F.sequence(low, F.greatest(low, bin_of(F.col(end) - 1)))))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], ranges: tuple[str, str], others: tuple[str, str], width: int) -> DataFrame:
    """Rows of both sides that agree in ``on`` and whose half-open ranges (``ranges`` of ``left``, ``others`` of ``right``) overlap.

    Each range stands in every bin of ``width`` positions that it meets, so a key with very many ranges is dealt over its bins and costs about the sum of both sides; a pair that
    shares several bins is taken in the first.  Choose a width near the longer ranges' length: a range stands in ``length / width + 1`` bins.  Names other than ``on`` must
    differ.  Rows with a null in ``on`` or in a range join nothing; a range without length lies in those that begin before it and end after it.
    """
    known = lambda rows, a, b: rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    one, two = _binned(known(left, *ranges), *ranges, width, "_first"), _binned(known(right, *others), *others, width, "_other")
    met = one.join(two, [*on, "_bin"]).where((F.col("_bin") == F.greatest("_first", "_other")) & _overlap(ranges, others))
    return met.drop("_bin", "_first", "_other")


def _overlap(ranges: tuple[str, str], others: tuple[str, str]) -> Column:
    return (F.col(ranges[0]) < F.col(others[1])) & (F.col(ranges[1]) > F.col(others[0]))
