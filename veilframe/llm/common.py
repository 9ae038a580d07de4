"""What the operators of this subpackage share: scratch tables, vocabulary paths, Arrow helpers."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters, in Java, Python and SQL alike.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``; where neither is set, a temporary one on a local master (tests) and an error on a cluster, whose machines share no such folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared scratch folder and reads it again: computed once, lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(*more: str) -> Column:
    """64-bit hash of a row's id and whole text (and further columns): rows of one id and different texts, null ids included, differ."""
    named = [c for name in ("doc_id", *more) for c in (F.col(name).isNull(), F.col(name))]
    return F.xxhash64(*named, text_of())


def whole_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct) and further columns worked out from them: no name of a column can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[value.alias(name) for name, value in more.items()])


def only_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) whose :func:`row_key` is a ``key`` of ``chosen``; of rows with equal id and text, one."""
    keyed = whole_rows(docs, key=row_key())
    return keyed.join(chosen.select("key"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes in an Arrow batch, where the session has Spark's default of 64 MB: a worker holds a batch, its Python values and its result at once.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16m"


def _findable(spark: SparkSession) -> None:
    """Lets workers look for this package where the driver found it, too (on a cluster it comes with the job's files), and bounds their batches."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    env, root = spark.sparkContext.environment, str(pathlib.Path(__file__).parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def text_function(spark: SparkSession, work: Callable[..., pa.Array], kind: str, most: int = 4_000_000) -> Callable[..., Column]:
    """A column function of a text column (and others) by Arrow batches in slices of about ``most`` bytes of text.

    Only the given columns go to the workers and only the result comes back; the rest of each row stays with Spark.  Named
    nondeterministic so that the optimizer never works it out a second time for a filter.
    """
    import pyarrow.compute  # noqa: F401

    def run(text: pa.Array, *more: pa.Array) -> pa.Array:
        parts = cuts([x or 0 for x in pa.compute.binary_length(text).to_pylist()], most)
        found = [work(*(c.slice(a, b - a) for c in (text, *more))) for a, b in parts]
        return pa.concat_arrays(found) if found else work(text, *more)

    def one(text: pa.Array) -> pa.Array:
        return run(text)

    def two(text: pa.Array, more: pa.Array) -> pa.Array:
        return run(text, more)

    _findable(spark)
    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else two, kind).asNondeterministic()(*columns)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = 4_000_000, text: str = "text") -> DataFrame:
    """``mapInArrow`` over slices of a batch that hold about ``most`` bytes of text each, so memory follows the largest text, not the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            if at < 0:
                parts = [(0, batch.num_rows)]
            else:
                sizes = [x or 0 for x in pa.compute.binary_length(batch.column(at)).to_pylist()]
                parts = cuts(sizes, most)
            for a, b in parts:
                out = work(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    import pyarrow.compute  # noqa: F401

    return arrow_map(df, run, schema)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package."""
    _findable(df.sparkSession)
    return df.mapInArrow(run, schema)


def cuts(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Index ranges of consecutive items of about ``most`` in all; a larger item stands alone."""
    out, begin, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            out.append((begin, k))
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
