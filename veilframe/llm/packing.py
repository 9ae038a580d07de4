"""Sequence packing along a Hilbert curve through projected document vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import ids_of
from .common import arrow_map, map_arrow, partitions, text_of, vocabulary

#: Hashed features, curve dimensions and bits per dimension; the seed of the projection.
FEATURES, DIMS, BITS, SEED = 1024, 4, 12, 42
#: Low bits of the sort key that spread documents of one curve cell (copies) over partitions.
TIE_BITS = 15
#: Rows that are sampled for each partition's bounds; they steer balance only, never results.
SAMPLED = 60


@functools.cache
def projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((FEATURES, DIMS)).astype(np.float32)


def curve_cells(docs: list[np.ndarray]) -> np.ndarray:
    """Grid cell of each document: hashed token counts, damped, scaled to length one, projected, squashed into ``2**BITS`` steps."""
    size = np.array([len(d) for d in docs])
    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    feature = (flat.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(22)
    counts = np.bincount(np.repeat(np.arange(len(docs)), size) * FEATURES + feature, minlength=len(docs) * FEATURES).reshape(len(docs), FEATURES)
    vector = np.sqrt(counts, dtype=np.float32)
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1)
    at = vector @ projection()
    return np.minimum((at / (1 + np.abs(at)) + 1) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of grid cells ``(rows, dims)`` (Skilling's transposed form, for all rows at once)."""
    x = [c.copy() for c in cells.T.astype(np.int64)]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(n):
            on = (x[k] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x = [v ^ flip for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            out = (out << 1) | ((x[k] >> b) & 1)
    return out


def tokenized(docs: DataFrame, path: str, bounds: list[int] | None = None) -> DataFrame:
    """``doc_id, ids, spot, part``: packed ids with the closing id 0 (16 bits each where the vocabulary allows), the sort key along the curve, and how many bounds are not above it."""
    edges = np.array(bounds or [], np.int64)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = ids_of(path)
        kind = "<u2" if encode.largest < 1 << 16 else "<u4"
        ids = [encode(x) for x in batch.column("text").to_pylist()]
        tie = np.array(batch.column("tie").to_pylist(), np.int64)
        spot = hilbert(curve_cells(ids)) << TIE_BITS | tie
        packed = [x.astype(kind).tobytes() + bytes(int(kind[-1])) for x in ids]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array(spot, pa.int64()), pa.array(np.searchsorted(edges, spot, side="right"), pa.int32())], ["doc_id", "ids", "spot", "part"])

    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select("doc_id", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.length("text")), F.lit(1 << TIE_BITS)).alias("tie"))
    return map_arrow(rows, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, spot long, part int")


def _bounds(docs: DataFrame, path: str, parts: int) -> list[int]:
    """Splits of the curve into ``parts`` ranges, from a sample of bounded size (as a range partitioner takes, but of rows before they are tokenized)."""
    rows = docs.count()
    if parts < 2 or not rows:
        return []
    share = min(1.0, 1.2 * SAMPLED * parts / rows)
    some = docs.select("doc_id", "text")
    spots = tokenized(some if share == 1 else some.sample(fraction=share, seed=SEED), path).select("spot")
    got = np.sort(np.array([r[0] for r in spots.limit(4 * SAMPLED * parts).collect()], np.int64))
    return np.unique(got[np.arange(1, parts) * len(got) // parts]).tolist() if len(got) else []


def pack(docs: DataFrame, path: str | None = None, length: int = 1024, parts: int | None = None) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens, neighbours along the curve together.

    A document is its ids under the vocabulary plus id 0.  Documents are hashed to vectors, projected to four dimensions and sorted by
    Hilbert key over range partitions; each partition is cut into full sequences, and its rest into sequences whose lengths are powers of
    two, so nothing is padded.  Ids cross the network once.  Copies of one text share a curve cell; the low bits of the key, a hash of the
    id, spread them.  A task streams its sorted rows and holds at most one unfinished sequence besides the current batch.

    Returns per piece ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (``ids``: 32-bit little-endian), for every row of
    ``docs``, repeated rows included.  A null text is empty (one piece, id 0), a null ``doc_id`` stays null, an empty table gives no
    pieces, and further columns are ignored.
    """
    path, width = path or vocabulary(), parts or partitions(docs.sparkSession)
    bounds = _bounds(docs, path, width)
    keyed = tokenized(docs, path, bounds)
    dealt = keyed.repartitionById(len(bounds) + 1, F.col("part")) if bounds else keyed.repartition(1)
    ordered = dealt.sortWithinPartitions("spot", "doc_id", F.xxhash64("ids"))
    kind = "<u2" if ids_of(path).largest < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rest = TaskContext.get().partitionId() << 33, []  # rest: pieces of the unfinished sequence
        ids_type = None
        for batch in batches:
            ids_type = batch.column("doc_id").type
            names, packed = batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()
            for a, b in _by_size(packed):
                docs_ = [(name, 0, np.frombuffer(x, kind).astype("<u4")) for name, x in zip(names[a:b], packed[a:b], strict=True)]
                rows, number, rest = _cut(rest + [(n, s, x, len(x)) for n, s, x in docs_], number, [length], False)
                if rows:
                    yield _batch(rows, ids_type)
        if rest:
            left = sum(len(x[2]) for x in rest)
            powers = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
            rows, _, _ = _cut(rest, number, powers, True)
            yield _batch(rows, ids_type)

    key = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(ordered.drop("spot", "part"), run, f"doc_id {key}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _by_size(packed: list[bytes]) -> list[tuple[int, int]]:
    from .common import cuts

    return cuts([len(x) for x in packed], 4_000_000)


def _cut(pieces: list[tuple], number: int, sizes: list[int], last: bool) -> tuple[list[tuple], int, list[tuple]]:
    """Lays pieces ``(doc, start, ids, doc_tokens)`` into sequences of the given sizes (the only size repeats); returns rows, the next number, and what does not fill one."""
    total = sum(len(x[2]) for x in pieces)
    room = total if last else total // sizes[0] * sizes[0]
    edges = np.cumsum(sizes) if last else np.arange(sizes[0], room + 1, sizes[0])
    rows, rest, at, k = [], [], 0, 0  # at: tokens laid so far; k: sequence
    for name, start, ids, whole in pieces:
        done = 0
        while done < len(ids):
            if at >= room:
                rest.append((name, start + done, ids[done:], whole))
                break
            take = min(len(ids) - done, int(edges[k]) - at)
            offset = at - (int(edges[k - 1]) if k else 0)
            rows.append((name, start + done, take, whole, number + k, offset, ids[done : done + take].tobytes()))
            done += take
            at += take
            k += at == edges[k]
    return rows, number + k, rest


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [key, *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
