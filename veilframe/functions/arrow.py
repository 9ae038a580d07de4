"""Column functions by Arrow batches, for what column expressions can only do in time that grows with the square of a text's hits."""

from __future__ import annotations

import os
import pathlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Characters of text that are worked on at once.
SLICE = 4_000_000


def _findable(spark: SparkSession) -> None:
    """Workers look for this package where the driver found it, too."""
    env, root = spark.sparkContext.environment, str(pathlib.Path(__file__).parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def arrow_function(spark: SparkSession, work: Callable[[list, list], list], kind: str, result: pa.DataType) -> Callable[[Column, Column], Column]:
    """A column function of a text and one further column.  Nondeterministic by name, so the optimizer never works it out again for a filter."""
    _findable(spark)

    def run(text: pa.Array, more: pa.Array) -> pa.Array:
        done, at, held, size = [], 0, [], 0
        for k in range(len(text)):
            held.append(text[k].as_py())
            size += len(held[-1] or "")
            if size > SLICE or k + 1 == len(text):
                done.append(pa.array(work(held, more.slice(at, len(held)).to_pylist()), result))
                at, held, size = k + 1, [], 0
        return pa.concat_arrays(done) if done else pa.array([], result)

    return F.arrow_udf(run, kind).asNondeterministic()


def ordered_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Each group's rows in order through a plain function that returns the group's rows of ``schema`` (its keys first).

    For folds whose state depends on what they have decided so far, which windows cannot say.  Rows are dealt by key and sorted by Spark; a task streams
    them and holds one group at a time, so a group (a page, a turn list) must fit a worker's memory, a partition need not.
    """
    _findable(df.sparkSession)
    n = len(keys)
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    out = StructType.fromDDL(schema)
    types, names = [to_arrow_type(f.dataType) for f in out], out.names

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, done = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != group:
                    if held:
                        done += fold(held)
                    group, held = row[:n], []
                held.append(row)
            if len(done) > 20_000:
                yield told(done)
                done = []
        if held:
            done += fold(held)
        if done:
            yield told(done)

    dealt = df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)
