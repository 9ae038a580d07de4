"""Event-time streams: counts in windows and sessions of a key, with a watermark that bounds state and drops what comes too late."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import shared_folder


def _zoned(events: DataFrame, time: str) -> DataFrame:
    """Times without a zone are those of UTC; event time needs one."""
    if events.schema[time].dataType.simpleString() != "timestamp_ntz":
        return events
    return events.withColumn(time, F.concat(F.col(time).cast("string"), F.lit("Z")).cast("timestamp"))


def window_counts(events: DataFrame, by: str, time: str = "ts", width: str = "12 hours", late: str = "1 day") -> DataFrame:
    """``start, end, by, n`` of a stream's rows in windows of event time.  A row whose window ended before the watermark (the latest time of earlier batches less ``late``) is left out; windows come out once the watermark passes their end."""
    counted = _zoned(events, time).withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def user_sessions(events: DataFrame, user: str, time: str = "ts", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """``user, start, end, n`` of sessions: rows of a user with less than ``gap`` between them.  A session's end is its last row's time and the gap; it comes out once the watermark passes that."""
    counted = _zoned(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n"))
    return counted.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(source: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Runs a stream over what its source has now and ends.  State, offsets and the watermark stay in ``checkpoint``; the next call with it goes on from there, so a run that was cut short loses and repeats nothing."""
    build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def replayed(spark: SparkSession, arrivals: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives for tables that arrive one after the other; the stream is stopped and started again from its checkpoint between any two.

    The tables, the checkpoint and the results lie in the session's shared folder.  The source reads files of a folder as they come, so what is kept in memory is the open windows alone.
    """
    folder, schema = shared_folder(spark), None
    for rows in arrivals:
        schema = rows.schema
        rows.write.mode("append").parquet(f"{folder}/in")
        drain(spark.readStream.schema(schema).parquet(f"{folder}/in"), build, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")
