"""Token counts of whole texts by compiled transducers (see :mod:`.bpe_fst`)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_fst import transducer
from .common import map_arrow, text_of, vocabulary


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text under a byte-level BPE vocabulary file.

    One narrow pass without a shuffle: each worker compiles the transducers once and keeps bounded tables.
    Returns ``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``; repeated rows stay repeated.
    A null text counts as empty (0 bytes, 0 tokens); a null ``doc_id`` stays null; an empty table gives an empty result; further
    columns of ``docs`` are neither read nor returned.  Special strings inside a text count as their one special token.
    """
    path = path or vocabulary()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = transducer(path).counts(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = map_arrow(rows, work, f"doc_id {ids}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
