"""SimHash near-duplicates: fingerprints of 4-word shingles, linked by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, map_arrow, only_rows, row_key, stored, text_of
from .components import connected, local_roots

#: Words in a shingle, hash seed, most differing bits of a link.
SHINGLE, SEED, BUDGET = 4, 42, 4
#: Bit fields of a fingerprint: one more than the budget, so a linked pair agrees in one of them.
FIELDS = (13, 13, 13, 13, 12)
#: Fingerprints that a trie node may have before it is split, and that one step of a task takes.
NODE, STEP = 20_000, 50_000
#: A fingerprint is hot from so many rows, or a share of all rows that leaves so many hot ones at most.
HOT_ROWS, MOST_HOT = 10_000, 10_000
#: Node pairs that a traversal holds at once; pairs of nodes with so few leaf pairs are compared leaf by leaf.
FRONTIER, LEAF_PAIRS = 400_000, 32


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.encode().lower().split()  # bytes: lower-cases A-Z alone and splits at the six ASCII blanks alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, as a signed long; 0 for none."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str) -> int:
    """64-bit SimHash of the whole text, as a signed long; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, key, fp`` (longs but for the id) of every row, ``key`` hashing id and text; one narrow pass."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = [fingerprint(x) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fp, pa.int64())], ["doc_id", "key", "fp"])

    return map_arrow(docs.select("doc_id", row_key().alias("key"), text_of().alias("text")), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def trie_links(value: np.ndarray, runs: list[tuple[int, int, int, int]], shared: int, budget: int) -> np.ndarray:
    """Roots (indexes) of values linked within given runs, by traversing pairs of trie nodes together.

    ``value``: unsigned, sorted within each run; ``runs``: ``a_lo, a_hi, b_lo, b_hi``, a run against itself or another.  A node is a
    stretch of sorted values with one prefix.  A pair of nodes carries the bits in which their prefixes differ and is dropped beyond the
    budget; its children pair up.  The first ``shared`` bits are known to agree.  Pairs wait on a stack, so memory is bounded.
    """
    n = len(value)
    label = np.arange(n)
    ones: dict[int, np.ndarray] = {}

    def upto(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        return ones[bit]

    def compare(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        nonlocal label
        wide = b1 - b0
        size = (a1 - a0) * wide
        for lo, hi in _stretches(size, 2_000_000):
            s, w = size[lo:hi], wide[lo:hi]
            at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            w = np.repeat(w, s)
            i, j = np.repeat(a0[lo:hi], s) + at // w, np.repeat(b0[lo:hi], s) + at % w
            near = np.bitwise_count(value[i] ^ value[j]) <= budget
            label = local_roots(n, i[near], j[near], label)

    first = np.array(runs, np.int64).reshape(-1, 4).T
    stack = [(63 - shared, first, np.zeros(first.shape[1], np.int64))]
    while stack:
        bit, (a0, a1, b0, b1), spent = stack.pop()
        if a0.size > FRONTIER:
            half = a0.size // 2
            for part in (slice(half, None), slice(0, half)):
                stack.append((bit, np.array([a0[part], a1[part], b0[part], b1[part]]), spent[part]))
            continue
        small = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS if bit >= 0 else np.ones(a0.size, bool)
        if small.any():
            compare(a0[small], a1[small], b0[small], b1[small])
            a0, a1, b0, b1, spent = (x[~small] for x in (a0, a1, b0, b1, spent))
        if not a0.size:
            continue
        c = upto(bit)
        am, bm, same = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0]), a0 == b0
        other = ~same
        children = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1), tuple(x[other] for x in (am, a1, b0, bm, spent + 1))]
        grown = np.array([np.concatenate(x) for x in zip(*children, strict=True)])
        grown = grown[:, (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= budget)]
        stack.append((bit - 1, grown[:4], grown[4]))
    return label


def _stretches(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    total, out, lo = np.cumsum(size), [], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def _turned(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def trie_tasks(prints: DataFrame, node: int = NODE, budget: int = BUDGET) -> DataFrame:
    """``field, prefix, left, right, side, turned``: which fingerprints meet in which node pair.

    Each fingerprint is turned so that one field after another leads; equal leading fields are a trie node.  A node with more than
    ``node`` fingerprints is split on further bits until each part has no more, and its parts pair up unless their prefixes alone exceed
    the budget; so neither a task nor the work of a hot node grows without bound.
    """
    starts = np.cumsum([0, *FIELDS]).tolist()
    turns = F.array(*[F.struct(F.lit(k).alias("field"), F.shiftrightunsigned(_turned(F.col("fp"), starts[k]), 64 - w).alias("prefix"), _turned(F.col("fp"), starts[k]).alias("turned")) for k, w in enumerate(FIELDS)])
    coded = prints.select(F.explode(turns).alias("t")).select("t.*")
    whole = ["field", "prefix"]
    hot = stored(coded.groupBy(*whole).count().where(F.col("count") > node).select(*whole), "hot-nodes")
    no_node = F.lit(None).cast("struct<depth:int,bits:long>")
    few = hot.count()
    if not few:
        return coded.select(*whole, no_node.alias("left"), no_node.alias("right"), F.lit(0).alias("side"), "turned")
    named = F.broadcast(hot) if few <= 20_000 else hot
    cold = coded.join(named, whole, "left_anti").select(*whole, no_node.alias("left"), no_node.alias("right"), F.lit(0).alias("side"), "turned")
    depths = F.array(*[F.lit(d) for d in range(4, 52, 4)])
    bits = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("turned"), F.lit(13)), F.lit(64) - F.col("depth"))
    split = coded.join(named, whole, "left_semi").select("*", F.explode(depths).alias("depth")).withColumn("bits", bits)
    fits = split.groupBy(*whole, "depth", "bits").count().where(F.col("count") <= node).drop("count")
    placed = split.join(fits, [*whole, "depth", "bits"]).groupBy(*whole, "turned").agg(F.min(F.struct("depth", "bits")).alias("at"))
    placed = stored(placed, "split-nodes")
    nodes = placed.select(*whole, "at").distinct()
    depth = F.least("left.depth", "right.depth")
    cut = lambda side: F.call_function("shiftright", F.col(f"{side}.bits"), F.col(f"{side}.depth") - depth)
    pairs = nodes.withColumnRenamed("at", "left").join(nodes.withColumnRenamed("at", "right"), whole).where("left <= right")
    pairs = pairs.where(F.bit_count(cut("left").bitwiseXOR(cut("right"))) <= budget)
    side = lambda name, k: placed.withColumnRenamed("at", name).join(pairs if k == 0 else pairs.where("left <> right"), [*whole, name]).select(*whole, "left", "right", F.lit(k).alias("side"), "turned")
    return cold.union(side("left", 0)).union(side("right", 1))


def links(prints: DataFrame, node: int = NODE, budget: int = BUDGET) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (``fp``) within ``budget`` bits (fewer than the fields): those that span each task's components, never all pairs."""
    tasks = trie_tasks(prints, node, budget)
    key = ["field", "prefix", "left", "right"]
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.repartition(parts, *key).sortWithinPartitions(*key, "side")
    flat = dealt.select("field", F.xxhash64(*key).alias("task"), "side", "turned")
    widths = np.cumsum([0, *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.array([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]))
            if sum(x.shape[1] for x in held) >= STEP:
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero(rows[1] != rows[1, -1])  # the last task may go on in the next batch
                if len(last):
                    whole = int(last[-1]) + 1
                    yield from joined(rows[:, :whole])
                    rows = rows[:, whole:]
                held = [rows]
        if held:
            yield from joined(np.concatenate(held, axis=1))

    def joined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        field, task, side = rows[:3]
        value = rows[3].view(np.uint64)
        fresh = np.concatenate([[True], (task[1:] != task[:-1])])
        number = np.cumsum(fresh)
        order = np.lexsort((value, side, number))
        field, side, value, number = field[order], side[order], value[order], number[order]
        edge = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
        two = np.concatenate([[0], np.cumsum(side)])
        lo, hi = edge[:-1], edge[1:]
        mid = hi - (two[hi] - two[lo])
        alone = mid == hi
        runs = np.where(alone, [lo, hi, lo, hi], [lo, mid, mid, hi]).T
        label = trie_links(value, runs[(runs[:, 1] - runs[:, 0] > 1) | ~alone], min(FIELDS), budget)
        back = np.empty_like(value)
        for k, by in enumerate(widths[:-1].tolist()):
            here = field == k
            v = value[here]
            back[here] = v if not by else (v >> np.uint64(by)) | (v << np.uint64(64 - by))
        on = np.flatnonzero(label != np.arange(len(label)))
        if len(on):
            ends = [back[on].view(np.int64), back[label[on]].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    return arrow_map(flat, run, "a long, b long")


def near_duplicates(docs: DataFrame, node: int = NODE) -> DataFrame:
    """Near-duplicate components of whole texts: ``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints within four bits are linked, directly and through others; ``component_id`` is the smallest ``doc_id`` reached.  Copies
    collapse to one fingerprint before the join, so a group of copies costs one entry.  A null or word-less text has fingerprint 0 and
    links like any other; a null ``doc_id`` is never a component's smallest id unless no other is there; repeated rows stay repeated; an
    empty table gives an empty result; further columns are ignored.
    """
    found, ids = _components(docs, node)
    # a fingerprint of very many rows takes its component from a broadcast of at most ``MOST_HOT`` rows, so no task gets all its rows
    most = max(HOT_ROWS, found.count() // MOST_HOT)
    hot = F.broadcast(ids.where(F.col("n") > most).select("fp", "component_id"))
    cool = found.join(hot.select("fp"), "fp", "left_anti").join(ids.where(F.col("n") <= most).select("fp", "component_id"), "fp")
    out = found.join(hot, "fp").select("doc_id", "fp", "component_id").unionByName(cool.select("doc_id", "fp", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(docs: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    """All rows' :func:`fingerprints`, and ``fp, root, component_id, n`` of the distinct fingerprints (``n``: their rows)."""
    found = stored(fingerprints(docs), "fingerprints")
    reps = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = stored(connected(links(reps.select("fp"), node)), "roots")
    linked = roots.join(reps, roots["node"] == reps["fp"]).select("fp", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(smallest, "root").select("fp", "root", "component_id")
    ids = reps.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"), "n")
    return found, stored(ids, "components")


def keep_one(docs: DataFrame, node: int = NODE) -> DataFrame:
    """One row of ``docs`` (all columns) of each component: that of the smallest ``doc_id``, null last, then of the smallest text hash.

    The choice is by component, never by id alone: components without any id keep a row each.  Ids with text hashes are joined to the texts.
    """
    found, ids = _components(docs, node)
    least = found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("least"))
    chosen = least.join(ids, "fp").groupBy("root").agg(F.min("least").alias("least")).select("least.key")
    return only_rows(docs, stored(chosen, "kept"))
