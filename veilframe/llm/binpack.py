"""Best-fit packing of whole documents into sequences, improved by exchanges that raise the sum of squared fills."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import ids_of
from .common import arrow_map, cuts, stored, text_of, vocabulary

LENGTH = 2048
#: Tokens that a task packs at once; tokens of a group in later rounds; bins that such a group hands on to the next one.
WINDOW, GROUP, HANDED_ON = 4_000_000, 16_000_000, 16
#: Passes of the local search over a window's bins at most; it ends earlier where nothing moves.
PASSES = 4
#: Sequence numbers: round, task or group, and number within it.
ROUND, PLACE = 1 << 56, 1 << 30
NAMES = ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids", "open"]


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indexes into ``sizes``: the largest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    with_free: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit f: a bin has f free
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        fits = some >> sizes[i]
        if fits:
            free = sizes[i] + (fits & -fits).bit_length() - 1
            at = with_free[free].pop()
            some ^= 0 if with_free[free] else 1 << free
            bins[at].append(i)
        else:
            free, at = room, len(bins)
            bins.append([i])
        if free := free - sizes[i]:
            with_free[free].append(at)
            some |= 1 << free
    return bins


class Exchange:
    """Local search over underfull bins.

    From the fullest bin down, each takes what fills it best from bins no fuller than itself: a document moves over, one is exchanged for one,
    one for two, or two for one.  The taker gains ``d`` tokens of at most its free ones, so the sum of squared fills grows by ``2 d (B - C + d) > 0``
    and the search ends; bins that run empty are dropped.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], room: int):
        self.sizes, self.room = sizes, room
        self.bins = bins
        self.fill = [sum(sizes[i] for i in b) for b in bins]

    def search(self, passes: int = PASSES) -> list[list[int]]:
        for _ in range(passes):
            if not self._pass():
                break
        return [b for b in self.bins if b]

    def _pass(self) -> bool:
        self.home = {i: b for b, held in enumerate(self.bins) if held and self.fill[b] < self.room for i in held}
        self.settled = {b for b in range(len(self.bins)) if self.fill[b] == self.room}
        self.of_size: list[list[int]] = [[] for _ in range(self.room + 1)]
        self.some = 0  # bit n: a document of n tokens may be in a bin that gives
        for i in self.home:
            self._offer(i)
        turn = [(-self.fill[b], b) for b in range(len(self.bins)) if 0 < self.fill[b] < self.room]
        self.low = [(-fill, b) for fill, b in turn]
        heapq.heapify(turn)
        heapq.heapify(self.low)
        moved = False
        while turn:
            fill, b = heapq.heappop(turn)
            if b in self.settled or -fill != self.fill[b]:
                continue
            self.settled.add(b)
            while self.fill[b] < self.room and (step := self._best(b)):
                giver = self._apply(b, *step)
                if self.fill[giver]:
                    heapq.heappush(turn, (-self.fill[giver], giver))
                    heapq.heappush(self.low, (self.fill[giver], giver))
                moved = True
        return moved

    def _offer(self, i: int) -> None:
        self.of_size[self.sizes[i]].append(i)
        self.some |= 1 << self.sizes[i]

    def _given(self, least: int, most: int) -> int:
        """A document of the largest size in the range that a bin still gives, or -1."""
        while most >= least:
            n = (self.some & ((1 << (most + 1)) - 1)).bit_length() - 1
            if n < least:
                return -1
            stack = self.of_size[n]
            while stack and self.home[stack[-1]] in self.settled:
                stack.pop()
            if stack:
                return stack[-1]
            self.some ^= 1 << n
        return -1

    def _best(self, b: int) -> tuple[list[int], list[int]] | None:
        """What bin ``b`` takes and what it gives for that, by the largest gain."""
        free, sizes, best, gain = self.room - self.fill[b], self.sizes, None, 0
        own = sorted({sizes[i]: i for i in self.bins[b]}.items())

        def better(base: int, given: list[int]) -> bool:
            nonlocal best, gain
            got = self._given(base + gain + 1, base + free)
            if got >= 0:
                best, gain = ([got], given), sizes[got] - base
            return gain == free

        if better(0, []):
            return best
        for n, i in own:
            if better(n, [i]):
                return best
        for k, (n, i) in enumerate(own):
            for m, j in own[k + 1 :]:
                if n + m + gain >= self.room or better(n + m, [i, j]):
                    break
            if gain == free:
                return best
        # two of the emptiest bin for one, or for nothing
        held = self._emptiest()
        pairs = {}
        for k, i in enumerate(held):
            for j in held[k + 1 :]:
                pairs[sizes[i] + sizes[j]] = (i, j)
        sums = sum(1 << n for n in pairs if n <= self.room)
        for base, given in [(0, []), *[(n, [i]) for n, i in own]]:
            n = (sums & ((1 << (base + free + 1)) - 1)).bit_length() - 1
            if n > base + gain:
                best, gain = (list(pairs[n]), given), n - base
            if gain == free:
                break
        return best

    def _emptiest(self) -> list[int]:
        """One document of each size of the emptiest bin that still gives."""
        while self.low and (self.low[0][1] in self.settled or self.low[0][0] != self.fill[self.low[0][1]]):
            heapq.heappop(self.low)
        return list({self.sizes[i]: i for i in self.bins[self.low[0][1]]}.values()) if self.low else []

    def _apply(self, b: int, taken: list[int], given: list[int]) -> int:
        giver = self.home[taken[0]]
        for i in taken:
            self.bins[giver].remove(i)
            self.bins[b].append(i)
            self.home[i] = b
        for i in given:
            self.bins[b].remove(i)
            self.bins[giver].append(i)
            self.home[i] = giver
            self._offer(i)
        gain = sum(self.sizes[i] for i in taken) - sum(self.sizes[i] for i in given)
        self.fill[b] += gain
        self.fill[giver] -= gain
        return giver


def packed_bins(sizes: list[int], room: int) -> list[list[int]]:
    return Exchange(best_fit(sizes, room), sizes, room).search()


def _cut(doc_id: object, ids: np.ndarray, room: int) -> list[tuple]:
    """``doc_id, piece, start, ids`` of a document: only one that is longer than a sequence is cut, and its first piece may be shorter."""
    first = len(ids) % room or room
    edges = [0, *range(first, len(ids) + 1, room)]
    return [(doc_id, k, a, ids[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _rows(bins: list[list[tuple]], number: int, key: pa.DataType, still_open: bool) -> pa.RecordBatch:
    rows = []
    for k, held in enumerate(bins):
        at = 0
        for doc_id, piece, start, ids in held:
            rows.append((doc_id, piece, start, len(ids), number + k, at, ids.astype("<u4").tobytes(), still_open))
            at += len(ids)
    kinds = [key, pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def _out(bins: list[list[tuple]], number: int, key: pa.DataType, still_open: bool) -> Iterator[pa.RecordBatch]:
    for a, b in cuts([sum(len(x[3]) for x in held) for held in bins], 1_000_000):
        yield _rows(bins[a:b], number + a, key, still_open)


def _first_round(docs: DataFrame, path: str, room: int) -> DataFrame:
    """Packs the rows of each task as they come.  Full sequences are settled; the documents of others come with ``open`` set."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path)
        number, pieces, tokens, kind = TaskContext.get().partitionId() * PLACE, [], 0, None

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, pieces, tokens
            bins = [[pieces[i] for i in b] for b in packed_bins([len(p[3]) for p in pieces], room)]
            fills = [sum(len(p[3]) for p in b) for b in bins]
            full, rest = [b for b, n in zip(bins, fills, strict=True) if n == room], sorted((n, k) for k, n in enumerate(fills) if n < room)
            # what is not full meets the next window, the emptiest first, up to half a window
            keep = [] if last else rest[: WINDOW // 2 // room]
            left = [bins[k] for _, k in rest[len(keep) :]]
            yield from _out(full, number, kind, False)
            yield from _out(left, number + len(full), kind, True)
            number += len(full) + len(left)
            pieces = [p for _, k in keep for p in bins[k]]
            tokens = sum(len(p[3]) for p in pieces)

        for batch in batches:
            kind = batch.column("doc_id").type
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in cuts(pa.compute.binary_length(texts).to_pylist(), 1_000_000):
                whole = []
                for name, text in zip(names[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                    ids = encode(text)
                    for piece in _cut(name, np.append(ids, np.zeros(1, ids.dtype)).astype("<u4"), room):
                        if len(piece[3]) == room:
                            whole.append([piece])
                        else:
                            pieces.append(piece)
                            tokens += len(piece[3])
                yield from _out(whole, number, kind, False)
                number += len(whole)
                if tokens >= WINDOW:
                    yield from settle(False)
        if pieces:
            yield from settle(True)

    import pyarrow.compute  # noqa: F401

    return arrow_map(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {key}, piece int, start long, length long, sequence_id long, offset long, ids binary, open boolean")


def _later_round(rest: DataFrame, groups: int, turn: int, room: int) -> DataFrame:
    """Packs what is open anew in ``groups`` groups dealt by a hash of the piece; with one group all is settled, else each hands its emptiest sequences on."""
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        key = table.column("doc_id").type
        columns = [table.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids", "sequence_id", "offset")]
        pieces = sorted(zip(*columns, strict=True), key=lambda p: (p[4], p[5]))
        pieces = [(d, k, s, np.frombuffer(ids, "<u4")) for d, k, s, ids, _, _ in pieces]
        bins = [[pieces[i] for i in b] for b in packed_bins([len(p[3]) for p in pieces], room)]
        bins.sort(key=lambda b: sum(len(p[3]) for p in b))
        hand = 0 if groups == 1 else sum(sum(len(p[3]) for p in b) < room for b in bins[:HANDED_ON])
        number = turn * ROUND + table.column("part")[0].as_py() * PLACE
        out = [*_out(bins[:hand], number, key, True), *_out(bins[hand:], number + hand, key, False)]
        return pa.Table.from_batches(out)

    return dealt.groupBy("part").applyInArrow(run, rest.schema)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Packs all documents into few sequences of at most ``length`` tokens.

    A document is its ids under the vocabulary plus id 0.  Only documents longer than a sequence are cut: into whole sequences, and a shorter first piece.
    A task packs its rows in windows by best fit and then by a local search of moves and exchanges (:class:`Exchange`); full sequences are settled where they
    arise, so their ids never cross the network.  The rest travels once to groups of bounded size, which hand at most ``HANDED_ON`` sequences each on, until one
    group settles the last.  A task or group holds one window of ids; each round is written before the next reads it, so lost executors cost their tasks alone.

    Returns per piece ``doc_id, piece, start, length, sequence_id, offset, ids`` (``ids``: 32-bit little-endian; sequence numbers are unique, not gapless), for every row of
    ``docs``, repeated rows included.  A null text is empty (one piece, id 0), a null ``doc_id`` stays null, an empty table gives no pieces, other columns are ignored.
    """
    path = path or vocabulary()
    now, settled = stored(_first_round(docs, path, length), "packed"), []
    for turn in range(1, 64):
        settled.append(now.where(~F.col("open")))
        rest = now.where("open")
        tokens = rest.agg(F.sum("length")).first()[0]
        if not tokens:
            break
        now = stored(_later_round(rest, math.ceil(tokens / GROUP), turn, length), "packed")
    return functools.reduce(DataFrame.unionByName, settled).drop("open")
