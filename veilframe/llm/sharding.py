"""Shards by extendible hashing: only buckets over the byte limit split on another bit of the hash."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Byte limit of a shard, directory bits settled in the first round, in a later one and in the last (bits of the row's place), and bits of the content hash.
#: The first round has at most a million cells; a later one few below each open cell, so that its sums shrink before they are shuffled.
LIMIT, ROUND_BITS, NEXT_BITS, HASH_BITS = 1 << 20, 20, 8, 60
#: Depths at which a prefix is short, and parts that the cells below one are dealt to.
SHORT, PARTS = 8, 64


def _hash(text: Column) -> Column:
    """60 hash bits of id and text: the leading hexadecimal digits of their MD5."""
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _width(first: int) -> int:
    """Bits settled in the round that begins at bit ``first``."""
    return NEXT_BITS if 0 < first < HASH_BITS else ROUND_BITS


def _bits(first: int) -> Column:
    """The round's bits from ``first`` on; past the content hash, bits of the row's place, so that equal rows part as well."""
    wide = _width(first)
    if first < HASH_BITS:
        return F.shiftright(F.col("hash"), HASH_BITS - first - wide).bitwiseAND((1 << wide) - 1)
    return F.pmod(F.xxhash64("place"), F.lit(1 << wide))


def _directory(rows: DataFrame, limit: int, last: bool, wide: int) -> DataFrame:
    """``above, cell, depth, shard_bytes, shard_docs``: for each cell of ``wide`` bits below a prefix ``above``, the least depth at which its bucket fits, and what that holds; null depth: none does.

    Sizes of cells are summed once; the sizes of all shorter prefixes and of their halves are sums of those, so no level reads the documents again.
    A bucket stands where a prefix is too large and its half is not; cells are looked up at the depths of such buckets alone.  Every join is
    a merge join: files of sums are far smaller than their rows in memory, so that Spark would collect and broadcast them by the files' size.
    """
    cells = stored(rows.groupBy("above", "cell").agg(F.sum("n_bytes").alias("held"), F.count("*").alias("n")), "cells")
    right = lambda bits: F.call_function("shiftright", F.col("cell"), F.lit(wide) - F.col("depth") - bits)
    levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("depth"))
    levels = levels.select("above", "depth", right(0).alias("prefix"), "held", "n", (1 - right(1) % 2).alias("low"))
    sums = levels.groupBy("above", "depth", "prefix").agg(F.sum("held").alias("held"), F.sum("n").alias("n"), F.sum(F.col("held") * F.col("low")).alias("low_held"), F.sum(F.col("n") * F.col("low")).alias("low_n"))
    fits = lambda held, n: (held <= limit) | (n == 1)
    bucket = lambda depth, prefix, held, n: F.struct(depth.alias("depth"), prefix.alias("prefix"), held.alias("shard_bytes"), n.alias("shard_docs"))
    depth, prefix, held, n, low_held, low_n = map(F.col, ("depth", "prefix", "held", "n", "low_held", "low_n"))
    halves = F.array(bucket(depth + 1, prefix * 2, low_held, low_n), bucket(depth + 1, prefix * 2 + 1, held - low_held, n - low_n))
    settled = F.filter(halves, lambda b: (b["shard_docs"] > 0) & (fits(b["shard_bytes"], b["shard_docs"]) | (F.lit(last) & (b["depth"] == wide))))
    whole = fits(held, n)
    buckets = stored(sums.where(~whole | (depth == 0)).select("above", F.explode(F.when(whole, F.array(bucket(depth, prefix, held, n))).otherwise(settled)).alias("b")).select("above", "b.*"), "buckets")
    # a short prefix has very many cells: they meet it in parts
    short = depth < SHORT
    spread = buckets.withColumn("part", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))))
    depths = F.array(*[F.lit(r.depth) for r in buckets.select("depth").distinct().collect()]).cast("array<int>")
    looked = cells.select("above", "cell", F.explode_outer(depths).alias("depth")).withColumn("prefix", right(0)).withColumn("part", F.when(short, (F.col("cell") % PARTS).cast("int")).otherwise(F.lit(0)))
    found = looked.join(spread.withColumn("at", depth).hint("merge"), ["above", "depth", "prefix", "part"], "left")
    return stored(found.groupBy("above", "cell").agg(F.max("at").alias("depth"), F.max("shard_bytes").alias("shard_bytes"), F.max("shard_docs").alias("shard_docs")), "directory")


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Assigns every document to a shard whose texts hold at most ``limit`` bytes.

    The directory is indexed by prefixes of hash bits.  Starting from one bucket, only oversized buckets split on their next bit; the
    split of a round's bits is found from the sums of the finest cells, and only documents of cells that are still too large go
    another round.  A text over the limit is a shard of its own.  Equal rows have equal content bits and split on the bits of their place.

    Returns ``doc_id, n_bytes, shard`` (the bits), ``depth, shard_bytes, shard_docs`` for every row of ``docs``; repeated rows stay
    repeated.  A null text has no bytes, a null ``doc_id`` hashes as an empty one, an empty table gives an empty result, and further
    columns are ignored.
    """
    text = text_of()
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), _hash(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    open_ = stored(keyed.withColumn("above", F.lit("")).withColumn("cell", _bits(0)), "shard-keys")
    done, first = [], 0
    while True:
        last = first >= HASH_BITS
        wide = _width(first)
        directory = _directory(open_, limit, last, wide)
        placed = open_.join(directory.hint("merge"), ["above", "cell"])
        more = not last and not directory.where(F.col("depth").isNull()).isEmpty()
        placed = stored(placed, "shard-places") if more else placed
        bits = F.lpad(F.bin("cell"), wide, "0")
        done.append(placed.where(F.col("depth").isNotNull()).select("doc_id", "n_bytes", F.concat("above", F.expr(f"substring(lpad(bin(cell), {wide}, '0'), 1, depth)")).alias("shard"), "shard_bytes", "shard_docs"))
        if not more:
            break
        first += wide
        open_ = stored(placed.where(F.col("depth").isNull()).withColumn("above", F.concat("above", bits)).drop("depth", "shard_bytes", "shard_docs").withColumn("cell", _bits(first)), "shard-keys")
    out = functools.reduce(DataFrame.union, done)
    return out.select("doc_id", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs")
