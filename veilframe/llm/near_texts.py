"""Near-duplicate texts by similarity: candidates from the SimHash trie join and from bands of minimum hashes, each pair verified by exact Jaccard.

Four bits of 64 find nearly every pair above a similarity of some 0.95 and all large groups of near copies, but few pairs at 0.8; a budget
that reaches those would leave the trie nothing to prune.  So what the trie join leaves apart meets in buckets of minimum hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, map_arrow, only_rows, partitions, row_key, stored, text_of
from .components import connected, local_roots
from .simhash import fingerprint_of, links, shingle_hashes

#: Words in a shingle, hash seed, least similarity of a link in fifths (4 of 5: 0.8).
SHINGLE, SEED, LEAST_FIFTHS = 5, 42, 4
#: Bands, and minimum hashes in each: texts at a similarity of exactly 0.8 share a band with a chance of 0.9995, nearer ones with a higher one.
BANDS, DEPTH = 32, 7
_RNG = np.random.default_rng(SEED)
_FACTOR, _SHIFT = (_RNG.integers(0, 1 << 32, (BANDS * DEPTH, 1), np.uint32) for _ in range(2))
_FACTOR |= np.uint32(1)
#: Shingles hashed at once; keys that are broadcast rather than joined.
PART, FEW = 1024, 200_000
#: Pairs of one text from which on they are dealt to parts, and the parts.
PAIRS, SALTS = 1000, 32
#: Texts in a block of a bucket, and shingles in a block of a product.
BLOCK, COLUMNS = 500, 4096


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the text's five-word shingles, sorted; a shorter text is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def bands(hashes: np.ndarray) -> list[int]:
    """Bucket of each band, as signed longs."""
    least = np.full(BANDS * DEPTH, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(high), PART):
        np.minimum(least, (_FACTOR * high[k : k + PART] + _SHIFT).min(axis=1), out=least)
    raw, wide = least.tobytes(), DEPTH * 4
    return [xxhash.xxh64_intdigest(raw[k * wide : (k + 1) * wide], k) - (1 << 63) for k in range(BANDS)]


def signatures(texts: DataFrame) -> DataFrame:
    """``key, fp, buckets`` of ``key, text``: fingerprint and bucket of each band, of one pass over the shingles; a batch's copies once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {}
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key not in found:
                hashes = shingle_hashes(text, SHINGLE)
                found[key] = fingerprint_of(hashes), bands(np.unique(hashes))
        flat = pa.array(np.array([b for _, b in found.values()], np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), flat)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([f for f, _ in found.values()], pa.int64()), lists], ["key", "fp", "buckets"])

    return map_arrow(texts, work, "key long, fp long, buckets array<long>")


def shingle_table(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, hashes`` (packed) of the texts with these keys, once each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = dict(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([shingles(x).tobytes() for x in found.values()], pa.binary())], ["key", "hashes"])

    named = F.broadcast(keys) if keys.count() <= FEW else keys
    return map_arrow(texts.join(named, "key", "left_semi"), work, "key long, hashes binary").dropDuplicates(["key"])


def verified(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets' exact Jaccard is 0.8 or more; two texts without words are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if min(len(p), len(q)) * 5 < max(len(p), len(q)) * LEAST_FIFTHS:
                    near.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                near.append(both * 5 >= (len(p) + len(q) - both) * LEAST_FIFTHS)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    # most pairs have one text of a group in common: such a text is copied to a few tasks, its pairs dealt over them
    many = pairs.groupBy("a").count().where(F.col("count") > PAIRS).select("a", F.lit(SALTS).alias("parts"))
    many = stored(many, "hubs")
    held = F.broadcast(many) if many.count() <= FEW else many
    dealt = pairs.join(held, "a", "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("parts")
    left = table.select(F.col("key").alias("a"), F.col("hashes").alias("x")).join(held, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    right = table.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    return arrow_map(dealt.join(left, ["a", "salt"]).join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def components(texts: DataFrame) -> DataFrame:
    """``node, root`` of the keys of ``key, text`` that have links.

    First come the links of the trie join.  Then a bucket's texts meet its smallest key, unless they are in one component already, so a bucket
    of one group costs at most a pair a text.  What that leaves apart meets within tasks: every two texts of a bucket that are not in one
    component yet.  Nothing is capped, and no pairs are written but those with the bucket's first text.
    """
    raw = stored(signatures(texts).dropDuplicates(["key"]), "signatures")
    prints = stored(raw.groupBy("fp").agg(F.min("key").alias("lead")), "fingerprints")
    near = stored(links(prints.select("fp")), "near-fingerprints")
    lead = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("lead").alias(name))
    close = near.join(lead("a", "p"), "a").join(lead("b", "q"), "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    same = raw.join(prints, "fp").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    close = stored(close.union(same).distinct(), "pairs")
    rows = raw.select("key", F.explode("buckets").alias("bucket"))
    live = rows.groupBy("bucket").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last").select("bucket")
    members = stored(rows.join(live, "bucket").distinct(), "members")
    wanted = members.select("key").union(close.select(F.explode(F.array("a", "b")))).distinct()
    table = stored(shingle_table(texts, stored(wanted, "shared")), "shingles")
    edges = stored(verified(close, table), "links")
    tried, placed = close, _placed(members, edges)
    leads = placed.groupBy("bucket").agg(F.min(F.struct("key", "root")).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket", "m")
    first = placed.join(leads, "bucket").where("root <> m.root").select(F.col("m.key").alias("a"), F.col("key").alias("b")).distinct()
    first = stored(first.join(tried, ["a", "b"], "left_anti"), "pairs")
    edges = stored(edges.union(verified(first, table)), "links")
    placed = _placed(members, edges)
    apart = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    more = stored(linked(placed.join(apart, "bucket"), table), "links")
    return connected(stored(edges.union(more), "links"))


def linked(rest: DataFrame, table: DataFrame) -> DataFrame:
    """Links ``a, b`` among texts of one bucket that are in different components so far: exact Jaccards within tasks, which return spanning links and no pairs.

    A bucket is a task.  In one with very many texts the texts of its largest component need not meet each other: they are dealt to parts, each
    of which meets all others, again in blocks.
    """
    counts = rest.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    info = counts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    parts = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    info = stored(info.select("bucket", F.col("m.root").alias("major"), parts(F.col("m.n")).alias("p"), parts(F.col("all") - F.col("m.n")).alias("q")), "bucket-parts")
    rows = rest.join(info, "bucket").withColumn("hash", F.xxhash64("key"))
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = F.pmod("hash", F.col("q"))
    as_major = F.transform(upto("q"), lambda j: task(F.pmod("hash", F.col("p")), j, 0))
    as_minor = F.transform(upto("p"), lambda i: task(i, block, 1))
    across = F.transform(F.filter(upto("q"), lambda j: j != block), lambda j: task(-1 - F.least(j, block), F.greatest(j, block), F.when(block < j, 0).otherwise(1)))
    rows = rows.select("bucket", "key", "root", F.explode(F.when(F.col("root") == F.col("major"), as_major).otherwise(F.concat(as_minor, across))).alias("t"))
    rows = rows.select("key", "root", F.xxhash64("bucket", "t.i", "t.j").alias("task"), (F.col("t.i") == 0).alias("inner"), "t.side").join(table, "key")
    dealt = rows.repartition(partitions(rest.sparkSession), "task").sortWithinPartitions("task", "side", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            tasks = now.column("task").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], tasks[1:] != tasks[:-1]])).tolist()
            for a, b in itertools.pairwise(edge):
                yield from joined(now.slice(a, b - a))
            held = now.slice(edge[-1])
        if held is not None and held.num_rows:
            yield from joined(held)

    def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side, root, key = (rows.column(c).to_numpy() for c in ("side", "root", "key"))
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("hashes")]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = left, right
        if rows.column("inner")[0].as_py():  # the block's own texts meet here, too
            a = np.concatenate([left, right])
        label = np.arange(rows.num_rows)
        label = local_roots(rows.num_rows, *near_pairs(a, b, sets, root), label)
        on = np.flatnonzero(label != np.arange(rows.num_rows))
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(key[label[on]]), pa.array(key[on])], ["a", "b"])

    return arrow_map(dealt.select("task", "inner", "side", "root", "key", "hashes"), run, "a long, b long")


def near_pairs(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``a`` and ``b``, of different roots, whose sets have a Jaccard of 0.8 or more, by products of sparse blocks."""
    size = np.array([len(x) for x in sets])

    def table(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([sets[k] for k in rows]), np.repeat(np.arange(len(rows)), size[rows])

    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word_a, row_a = table(a)
    word_b, row_b = table(b)
    shared = np.intersect1d(word_a, word_b)  # only these can count
    on_a, on_b = np.isin(word_a, shared), np.isin(word_b, shared)
    at_a, row_a, at_b, row_b = np.searchsorted(shared, word_a[on_a]), row_a[on_a], np.searchsorted(shared, word_b[on_b]), row_b[on_b]
    both = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(shared), COLUMNS):
        x, y = (np.zeros((n, min(COLUMNS, len(shared) - lo)), np.float32) for n in (len(a), len(b)))
        for m, at, row in ((x, at_a, row_a), (y, at_b, row_b)):
            here = (at >= lo) & (at < lo + COLUMNS)
            m[row[here], at[here] - lo] = 1
        both += x @ y.T
    either = size[a][:, None] + size[b][None, :] - both
    i, j = np.nonzero((both * 5 >= either * LEAST_FIFTHS) & (root[a][:, None] != root[b][None, :]))
    return a[i], b[j]


def _placed(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``bucket, key, root`` under the links so far."""
    roots = stored(connected(edges), "roots")
    return stored(members.join(roots, members["key"] == roots["node"], "left").select("bucket", "key", F.coalesce("root", "key").alias("root")), "placed")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (all columns) of each component of near-duplicate texts: that of the smallest ``doc_id``, null last.

    Texts with a Jaccard of 0.8 or more are linked, directly and through others; copies are one text from the start.  Components without
    any id keep a row each; of one id on several texts of a component the smallest text hash stays.
    """
    texts = docs.select(F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    roots = stored(components(texts), "components")
    rows = docs.select(F.xxhash64(text_of()).alias("node"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_key().alias("key")).alias("row"))
    least = rows.groupBy("node").agg(F.min("row").alias("row"))  # before the join: copies can be a third of all rows
    chosen = least.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row"))
    return only_rows(docs, stored(chosen.select("row.key"), "kept"))
