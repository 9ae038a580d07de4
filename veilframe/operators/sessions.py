"""What a session remembers: the latest value of a side table as of a row's time, and the language lock that the turns of a session keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .language import LOCK, detect

#: Languages that a lock may hold; an override to any other value takes the lock off.
LANGUAGES = ("en", "de", "zh")


def as_of(rows: DataFrame, updates: DataFrame, on: list[str], time: str, value: str, name: str, stretch: Column | None = None) -> DataFrame:
    """``rows`` with ``name``: the ``value`` of the latest of ``updates`` of the same key that is not after the row's ``time``; null where there is none or where that value is null.

    Both tables go into one order per key and a running last value carries updates to the rows after them, so there is no range join.  ``stretch`` (an expression over
    ``time`` that never falls, such as its hour) cuts a key with very many rows: each stretch is ordered by itself and the value at its begin comes from the stretches before it, of which
    only those with updates count.  Of several updates of one time the greatest value counts.  Rows with a null time or key take no value; all columns of ``rows`` stay.
    """
    part = F.lit(0) if stretch is None else stretch
    key = [F.col(c) for c in on]
    known = F.col(time).isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    mine = rows.select(*key, F.col(time), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.lit(None).cast(f"struct<v:{updates.schema[value].dataType.simpleString()}>").alias("_got"))
    news = updates.where(known).groupBy(*on, time).agg(F.max(value).alias("_v")).select(*key, F.col(time), F.lit(0).alias("_kind"), F.struct(F.col("_v").alias("v")).alias("_got")).withColumn("_part", part)
    both = mine.withColumn("_part", part).unionByName(news, allowMissingColumns=True)
    running = Window.partitionBy(*on, "_part").orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # the value with which each stretch begins: the last of the stretches that had updates
    last = news.groupBy(*on, "_part").agg(F.max_by("_got", time).alias("_end"))
    marks = both.select(*on, "_part").distinct().join(last, [*on, "_part"], "left")
    before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = marks.withColumn("_begin", F.last("_end", ignorenulls=True).over(before)).where("_begin IS NOT NULL").select(*on, "_part", "_begin")
    told = both.withColumn("_now", F.last("_got", ignorenulls=True).over(running)).where("_kind = 1")
    if stretch is not None:
        told = told.join(begins, [*on, "_part"], "left")
    got = F.coalesce("_now", "_begin") if stretch is not None else F.col("_now")
    return told.select("_row.*", F.when(known, got["v"]).alias(name))


def locked(turns: DataFrame, overrides: DataFrame | None = None, session: str = "session", turn: str = "turn", text: str = "text") -> DataFrame:
    """The language of each turn as a session goes on: adds ``content_lang``, ``asked`` and ``lock``.

    The first sure detection locks the turns after it, which are then not detected anew.  ``overrides`` (``session, turn, lang``) lock from their turn on, or take the lock off (null or any
    value that is no language of ours), so that the next sure detection locks.  A turn without text has no language and asks nothing; one without a lock that cannot be told
    is ``asked``.  Turns of one number go by their text; a null session is a session of its own.  A session's turns are ordered in one task.
    """
    mine = turns.select(F.col(session).alias("_s"), F.col(turn).alias("_t"), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in turns.columns]).alias("_row"), F.col(text).alias("_x"), F.lit(None).cast("string").alias("_forced"))
    if overrides is not None:
        lang = F.lower("lang")
        mine = mine.unionByName(overrides.select(F.col(session).alias("_s"), F.col(turn).alias("_t"), F.lit(0).alias("_kind"), F.when(lang.isin(*LANGUAGES), lang).otherwise("").alias("_forced")), allowMissingColumns=True)
    session_order = Window.partitionBy("_s").orderBy("_t", "_kind", "_x", "_forced").rowsBetween(Window.unboundedPreceding, 0)
    seen = mine.withColumn("_part", F.count("_forced").over(session_order)).withColumn("_set", F.nullif(F.last("_forced", ignorenulls=True).over(session_order), F.lit("")))
    told = seen.where("_kind = 1").withColumn("_d", detect(F.col("_x")))
    sure = F.when(~F.col("_d.needs_confirm") & (F.col("_d.lang") != "") & (F.col("_d.confidence") >= LOCK), F.col("_d.lang"))
    within = Window.partitionBy("_s", "_part").orderBy("_t", "_x").rowsBetween(Window.unboundedPreceding, 0)
    held = told.withColumn("_lock", F.coalesce("_set", F.first(sure, ignorenulls=True).over(within)))
    blank = F.trim(F.coalesce("_x", F.lit(""))) == ""
    return held.select("_row.*", F.when(blank, "").otherwise(F.coalesce("_lock", F.when(~F.col("_d.needs_confirm"), F.col("_d.lang")), F.lit(""))).alias("content_lang"), (~blank & F.col("_lock").isNull() & F.col("_d.needs_confirm")).alias("asked"), F.col("_lock").alias("lock"))
