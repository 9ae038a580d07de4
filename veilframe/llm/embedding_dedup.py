"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, stored
from .components import connected, local_roots

#: Least cosine of a link, most hash tables, probes in each table, seed of the rotations.
THRESHOLD, TABLES, PROBES, SEED = 0.98, 10, 4, 42
#: Hash tables for one, two and three hashes to a table; more hashes take them all.  A table with one hash misses 0.00008 of the pairs
#: right at the threshold, with two 0.018, with three 0.06, with four 0.15 (measured in 64 dimensions); tables are independent,
#: so by multiplication a pair there stays unmet in fewer than 1 case of 10^12, 10^10, 10^9 and 10^8.
TABLES_BY_HASHES = (3, 6, 8)
#: Runners-up of each hash that probes combine.
RUNNERS = 3
#: Vectors of a label to a hash value that the number of values aims at, so that buckets do not grow with the table; least number of values.
PER_BUCKET, LEAST_VALUES = 100, 16
#: Cosines worked out at once in a task.
SLAB = 1_000_000
#: Narrowest rotation: sign flips of few coordinates give few different ones, so tables would miss the same pairs.  Widest rotation that is kept as a matrix.
NARROWEST, MATRIX = 64, 512
#: Most groups that are broadcast.
FEW = 20_000
#: Most vectors in a block; buckets beyond it are cut into blocks, and blocks pair up over tasks.
BLOCK = 2_000


@functools.lru_cache(maxsize=64)
def signs(table: int, hash_: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, hash_, dim]).integers(0, 2, (3, dim)) * 2.0 - 1.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two wide), scaled to keep lengths."""
    n, dim = x.shape
    half = 1
    while half < dim:
        y = x.reshape(n, dim // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, dim)
        half *= 2
    return x / np.sqrt(dim)


@functools.lru_cache(maxsize=64)
def matrix(table: int, hash_: int, wide: int, look: int) -> np.ndarray:
    return np.ascontiguousarray(turned(np.eye(wide), table, hash_)[:, :look])


def turned(x: np.ndarray, table: int, hash_: int) -> np.ndarray:
    """Rows after the three sign flips and Hadamard transforms of a table's hash."""
    for s in signs(table, hash_, x.shape[1]):
        x = hadamard(x * s)
    return x


def width(dim: int) -> int:
    """Power of two that vectors are padded to."""
    return max(NARROWEST, 1 << (dim - 1).bit_length())


def widths(many: int, dim: int) -> tuple[int, ...]:
    """Coordinates that each hash of a table looks at, for ``many`` vectors of a label: whole rotations, then as many coordinates of another as are wanting.

    A hash over w coordinates has 2 w values, so their number follows the table in steps of two, whatever the dimension.
    """
    wide = width(dim)
    out, left = [], max(min(LEAST_VALUES, 2.0 * wide), many / PER_BUCKET)
    while left > 2 * wide:
        out.append(wide)
        left /= 2 * wide
    last = 1 << max(0, math.ceil(math.log2(left)) - 1)
    return (*out, last) if left > 1 or not out else tuple(out)


def tables(looks: tuple[int, ...]) -> int:
    return (*TABLES_BY_HASHES, TABLES)[min(len(looks) - 1, len(TABLES_BY_HASHES))]


def codes(x: np.ndarray, looks: tuple[int, ...]) -> np.ndarray:
    """Bucket codes ``(rows, tables, PROBES)`` of unit rows: the likeliest combinations of nearest cross-polytope vertices, sorted."""
    n, dim = x.shape
    wide = width(dim)
    padded = np.zeros((n, wide))
    padded[:, :dim] = x
    out = np.empty((n, tables(looks), PROBES), np.int64)
    for t in range(out.shape[1]):
        vertex, loss = [], []
        for h, look in enumerate(looks):
            y = padded @ matrix(t, h, wide, look) if wide <= MATRIX else turned(padded, t, h)[:, :look]
            # vertices of both signs: with few coordinates the opposite one is among the nearest
            near = np.concatenate([y, -y], axis=1)
            take = min(RUNNERS if len(looks) > 1 else PROBES, 2 * look)
            top = np.argsort(-near, axis=1, kind="stable")[:, :take]
            best = np.take_along_axis(near, top, 1)
            vertex.append(top)
            loss.append(best[:, :1] - best)
        mixes = list(itertools.product(*[range(v.shape[1]) for v in vertex]))
        cost = np.stack([sum(l[:, k] for l, k in zip(loss, m, strict=True)) for m in mixes], axis=1)
        code = np.stack([functools.reduce(lambda c, vk: c * (2 * wide) + vk[0][:, vk[1]], zip(vertex, m, strict=True), np.zeros(n, np.int64)) for m in mixes], axis=1)
        chosen = np.argsort(cost, axis=1, kind="stable")[:, : min(PROBES, len(mixes))]
        got = np.take_along_axis(code, chosen, 1)
        out[:, t] = np.sort(got if got.shape[1] == PROBES else np.concatenate([got, np.repeat(got[:, :1], PROBES - got.shape[1], 1)], axis=1), axis=1)
    return out


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of equally long lists, scaled to length one in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(reps: DataFrame) -> DataFrame:
    """``label, dim, rep, copies, embedding, codes``: each distinct vector once, with its buckets in every table."""
    sizes = stored(reps.groupBy("label", "dim").agg(F.count("*").alias("many")).where(F.col("many") > PER_BUCKET * LEAST_VALUES), "large-labels")
    sized = reps.join(F.broadcast(sizes) if sizes.count() <= FEW else sizes, ["label", "dim"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "many"))
            kinds, kind_of = np.unique(np.stack([dims, many], axis=1), axis=0, return_inverse=True)
            looked = [(dim, widths(m, dim)) for dim, m in kinds.tolist()]
            for alike in sorted(set(looked)):
                part = batch.filter(pa.array(np.array([k == alike for k in looked])[kind_of]))
                looks = alike[1]
                c = codes(unit(part.column("embedding")), looks)
                c = c * TABLES + np.arange(c.shape[1])[None, :, None]
                each = c.shape[1] * PROBES
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * each), pa.array(c.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("label", "dim", "rep", "copies", "embedding")), lists], ["label", "dim", "rep", "copies", "embedding", "codes"])

    kind = {f.name: f.dataType.simpleString() for f in reps.schema}
    kept = ", ".join(f"{c} {kind[c]}" for c in ("label", "dim", "rep", "copies", "embedding"))
    return arrow_map(sized.select("label", "dim", "rep", "copies", "embedding", F.coalesce("many", F.lit(0)).alias("many")), run, f"{kept}, codes array<long>")


def tasks(vectors: DataFrame, block: int) -> DataFrame:
    """``label, dim, bucket, left, right, part`` and the columns of ``vectors``: vectors that meet.  A bucket of more than ``block`` vectors is several blocks, which meet pairwise."""
    key = ["label", "dim", "bucket"]
    bucket = F.explode(F.array_distinct("codes")).alias("bucket")
    hot = stored(vectors.select("label", "dim", bucket).groupBy(*key).count().where(F.col("count") > block), "hot-buckets")
    few = hot.count()
    zero, rest = F.lit(0), ["rep", "copies", "codes", "embedding"]
    keys = vectors.select("label", "dim", bucket, *rest)
    if not few:
        return keys.select(*key, zero.alias("left"), zero.alias("right"), zero.alias("part"), *rest)
    hot = F.broadcast(hot) if few <= FEW else hot
    parts = F.ceil(F.col("count") / block).cast("int")
    split = keys.join(hot, key).withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(zero, parts - 1)))
    split = split.select(*key, F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", *rest)
    return keys.join(hot, key, "left_anti").select(*key, zero.alias("left"), zero.alias("right"), zero.alias("part"), *rest).union(split)


def firsts(code: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: int) -> np.ndarray:
    """Which of the pairs ``i, j`` of rows of ``code`` (tables, probes) have ``bucket`` as the first that they share."""
    on, most = np.arange(len(i)), np.iinfo(np.int64).max
    table = bucket % TABLES
    a, b = code[i, table], code[j, table]
    on = on[np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, most).min(axis=1) == bucket]
    for t in range(table):
        on = on[~(code[i[on], t][:, :, None] == code[j[on], t][:, None, :]).any(axis=(1, 2))]
    return on


def verified(reps: DataFrame, threshold: float, block: int) -> DataFrame:
    """``rep, links, root``: links of each distinct vector found in a task, and its smallest companion there.  A pair is counted in the first bucket it shares.

    Codes are worked out once a vector and travel with it, so a task compares them and hashes nothing again.
    """
    met = tasks(stored(hashed(reps), "hashed-vectors"), block)
    key = ["label", "dim", "bucket", "left", "right"]
    dealt = met.repartition(partitions(reps.sparkSession), *key).sortWithinPartitions(*key).select(F.xxhash64(*key).alias("task"), "bucket", "left", "right", "part", "rep", "copies", "codes", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            task = now.column("task").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])).tolist()
            for a, b in itertools.pairwise(edge):
                yield from pairs(now.slice(a, b - a))
            held = now.slice(edge[-1])
        if held is not None and held.num_rows:
            yield from pairs(held)

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        if n < 2:
            return
        bucket, left, right = (rows.column(c)[0].as_py() for c in ("bucket", "left", "right"))
        rep = rows.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")  # places in the order of rep, so that the smallest place is the smallest rep
        rep, part, copies = (rows.column(c).to_numpy()[order] for c in ("rep", "part", "copies"))
        x = unit(rows.column("embedding").combine_chunks())[order]
        code = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(n, -1, PROBES)[order]
        one, two = (np.arange(n),) * 2 if left == right else (np.flatnonzero(part == left), np.flatnonzero(part == right))
        links, root = np.zeros(n, np.int64), np.arange(n)
        step = max(1, SLAB // max(1, len(two)))
        for lo in range(0, len(one), step):
            if left == right:
                i, j = np.nonzero(np.triu(x[lo : lo + step] @ x[lo:].T >= threshold, 1))
                i, j = i + lo, j + lo
            else:
                i, j = np.nonzero(x[one[lo : lo + step]] @ x[two].T >= threshold)
                i, j = one[lo + i], two[j]
            on = firsts(code, i, j, bucket)
            i, j = i[on], j[on]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = local_roots(n, i, j, root)
        on = np.flatnonzero(links)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(links[on]), pa.array(rep[root[on]])], ["rep", "links", "root"])

    return arrow_map(dealt, run, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``threshold``: one row per row of ``vectors``.

    Equal vectors of a label collapse first, so copies cost one entry.  Distinct vectors are rotated by three sign flips and Hadamard
    transforms for each hash, sent to the nearest cross-polytope vertices in three to ten tables with four probes each, and every
    candidate pair is verified in double precision.  More vectors of a label mean more hashes to a table and more tables.  Buckets have
    no cap: larger ones are cut into blocks that pair up in tasks of their own.  Tasks return link counts and spanning edges, never pairs.

    Returns ``vec_id, n_links, component_id, kept``.  Null, empty or zero vectors, vectors with null or non-finite components, and null
    labels link with nothing; vectors of other lengths are not compared; a null ``vec_id`` stays its own component and is not a
    representative; repeated rows count as vectors of their own; an empty table gives an empty result; further columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    group = [F.col("label"), F.col("embedding")]
    valid = rows.where(usable)
    # a node is a vector of a label, told by a hash: an id may stand for several vectors
    reps = valid.groupBy(*group).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.xxhash64(*group))
    reps = stored(reps.withColumn("dim", F.size("embedding")), "distinct-vectors")
    found = stored(verified(reps, threshold, block), "links")
    roots = stored(connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "roots").withColumnRenamed("node", "rep")
    components = roots.join(reps.select("rep", "least"), "rep").groupBy("root").agg(F.min("least").alias("component_id"))
    links = found.groupBy("rep").agg(F.sum("links").alias("others"))
    told = reps.join(links, "rep", "left").join(roots.join(components, "root").select("rep", "component_id"), "rep", "left")
    told = told.select(F.col("label").alias("r_label"), F.col("embedding").alias("r_embedding"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    # hash first: comparing whole vectors only where a 64-bit key agrees keeps the join's key short
    keyed = rows.withColumn("hash", F.when(usable, F.xxhash64("label", "embedding")))
    told = told.withColumn("r_hash", F.xxhash64("r_label", "r_embedding"))
    out = keyed.join(told, (F.col("hash") == F.col("r_hash")) & (F.col("label") == F.col("r_label")) & (F.col("embedding") == F.col("r_embedding")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
