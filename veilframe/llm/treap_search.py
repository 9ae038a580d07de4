"""Ranked lexical search by inverted treaps: per term a tree by document, heap-ordered by impact, walked for all terms of a query at once."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, cuts, stored, text_of

TOP = 20
#: Bytes of query texts that are ranked in one walk over the documents; postings of a shard; stretches of documents that are split at once.
QUERY_BYTES, SHARD, AT_ONCE = 2_000_000, 1_000_000, 1024
#: Bytes that stand in terms: ASCII digits and letters, A-Z as a-z, and all of other characters; any other byte parts terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts`` of documents with a term: all terms' number, and of those in ``numbers`` the number and occurrences (32-bit, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts(pa.compute.binary_length(batch.column("text")).to_pylist(), 4_000_000):
                part, rows = batch.slice(a, b - a), []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    words = terms_of(text)
                    if words:
                        found = [(numbers[t], n) for t, n in Counter(words).items() if t in numbers]
                        pairs = np.array(found, "<i4").reshape(-1, 2)
                        rows.append((doc, len(words), pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
                if rows:
                    kinds = [part.column("doc_id").type, pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n", "terms", "counts"])

    import pyarrow.compute  # noqa: F401

    return arrow_map(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms binary, counts binary")


def document_frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """Documents of each numbered term; tasks count first, so at most one row a term and task is shuffled, and one a term comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for term, df in arrow_map(index.select("terms"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[term] = df
    return out


def grown(keys: list[int], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Treaps over posting lists (``starts``: where each begins, and the end): children left and right of each posting, and each list's root.  Postings stand in document order, ``keys`` in heap order."""
    left, right, roots = [-1] * len(keys), [-1] * len(keys), []
    for a, b in zip(starts, starts[1:], strict=False):
        spine: list[int] = []  # from the root down its right children
        for i in range(a, b):
            key, below = keys[i], -1
            while spine and keys[spine[-1]] < key:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        roots.append(spine[0] if spine else -1)
    return np.array(left, np.int32), np.array(right, np.int32), np.array(roots, np.int32)


class Shard:
    """Inverted treaps of some documents, whose places are in the order of their ids."""

    def __init__(self, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, terms: int):
        order = np.lexsort((doc, term))
        self.size, self.doc = len(m), doc[order].astype(np.int32)
        tf = tf[order].astype(np.int64)
        self.value = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc])
        starts = np.searchsorted(term[order], np.arange(terms + 1)).tolist()
        spread = (self.doc.astype(np.int64) * 0x9E3779B1 >> 7) & 0xFFFFFF  # equal impacts: any fixed order of its own keeps trees shallow
        self.left, self.right, self.roots = grown((self.value << 24 | spread).tolist(), starts)

    def settle(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From each node down to the first one whose document is in ``[low, high)``, which has the largest impact there; -1 if none is."""
        node, at = node.copy(), np.arange(len(node))
        while len(at):
            here, doc = node[at], self.doc[node[at]]
            before, after = doc < low[at], doc >= high[at]
            out = before | after
            at, here, before = at[out], here[out], before[out]
            node[at] = np.where(before, self.right[here], self.left[here])
            at = at[node[at] >= 0]
        return node


class Walk:
    """Simultaneous descent through a shard's treaps for many queries.

    A stretch of documents has, for each term of its query, the treap node of largest impact inside it.  Their weighted sum bounds every score in the stretch; where it
    is below the query's ``k``-th best so far, the stretch and all subtrees below it are left.  Else it is split at the document of its largest impact: the
    stretch of that document alone has its exact score as bound, the two others go down the trees.  The most promising stretches come first.
    """

    def __init__(self, shard: Shard, least: np.ndarray, k: int):
        self.shard, self.least, self.k = shard, least, k
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))  # query, score, place

    def run(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """``query, score, place`` of each query's best; the arguments are parallel: a query's terms and their weights, sorted by query."""
        asked, entry = np.unique(query, return_inverse=True)
        whole = (asked, np.zeros(len(asked), np.int32), np.full(len(asked), self.shard.size, np.int32))
        root = self.shard.roots[term]
        waiting = [self._bounded(whole, entry[root >= 0], root[root >= 0], weight[root >= 0])]
        while waiting:
            now = self._first(waiting)
            if now is not None:
                waiting.append(self._bounded(*self._split(*now)))
        return self.best

    def _bounded(self, spans: tuple, entry: np.ndarray, node: np.ndarray, weight: np.ndarray) -> tuple:
        """Settles the nodes in their stretches, adds up bounds, and takes the scores of single documents."""
        query, low, high = spans
        node = self.shard.settle(node, low[entry], high[entry])
        entry, node, weight = entry[node >= 0], node[node >= 0], weight[node >= 0]
        bound = np.bincount(entry, weight * self.shard.value[node], len(query)).astype(np.int64)
        alone = (high - low == 1) & (bound > 0) & (bound >= self.least[query])
        if alone.any():
            self._take(query[alone], bound[alone], low[alone].astype(np.int64))
        return self._kept((query, low, high), bound, entry, node, weight, (high - low > 1) & (bound > 0) & (bound >= self.least[query]))

    @staticmethod
    def _kept(spans: tuple, bound: np.ndarray, entry: np.ndarray, node: np.ndarray, weight: np.ndarray, which: np.ndarray) -> tuple:
        number, of = np.cumsum(which) - 1, which[entry]
        return tuple(x[which] for x in spans), bound[which], number[entry[of]], node[of], weight[of]

    def _first(self, waiting: list[tuple]) -> tuple | None:
        """The most promising stretches of the latest that wait; those that the scores found since rule out are dropped."""
        spans, bound, entry, node, weight = waiting.pop()
        spans, bound, entry, node, weight = self._kept(spans, bound, entry, node, weight, bound >= self.least[spans[0]])
        if len(bound) > AT_ONCE:
            first = np.zeros(len(bound), bool)
            first[np.argsort(self.least[spans[0]] - bound, kind="stable")[:AT_ONCE]] = True
            waiting.append(self._kept(spans, bound, entry, node, weight, ~first))
            spans, bound, entry, node, weight = self._kept(spans, bound, entry, node, weight, first)
        return (spans, entry, node, weight) if len(bound) else None

    def _split(self, spans: tuple, entry: np.ndarray, node: np.ndarray, weight: np.ndarray) -> tuple:
        query, low, high = spans
        impact = weight * self.shard.value[node]
        largest = np.zeros(len(query), np.int64)
        np.maximum.at(largest, entry, impact)
        top = np.flatnonzero(impact == largest[entry])
        at = np.zeros(len(query), np.int32)
        at[entry[top]] = self.shard.doc[node[top]]  # of several equal ones any will do
        n = len(query)
        lows, highs = np.concatenate([low, at, at + 1]), np.concatenate([at, at + 1, high])
        return (np.tile(query, 3), lows, highs), np.concatenate([entry, entry + n, entry + 2 * n]), np.tile(node, 3), np.tile(weight, 3)

    def _take(self, query: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        query, score, place = (np.concatenate(x) for x in zip(self.best, (query, score, place), strict=True))
        order = np.lexsort((place, -score, query))
        query, score, place = query[order], score[order], place[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        keep = nth < self.k
        self.best = query[keep], score[keep], place[keep]
        last = nth == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])


def _ranked(index: DataFrame, items: list[tuple], asked: tuple[np.ndarray, ...], n_docs: int, n_terms: int, terms: int, k: int, kind: pa.DataType, schema: str) -> DataFrame:
    """Each task's best documents of each query: its rows are cut into shards, and what a shard found prunes the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(len(items), np.int64)
        best: dict[int, list[tuple]] = {}
        rows, held, key = [], 0, None

        def walk() -> None:
            rows.sort(key=lambda r: (True,) if r[0] is None else (False, r[0]))
            m = np.array([75 + 25 * n * n_docs // n_terms for _, n, _, _ in rows], np.int64)
            term = np.frombuffer(b"".join(r[2] for r in rows), "<i4")
            doc = np.repeat(np.arange(len(rows)), [len(r[2]) // 4 for r in rows])
            shard = Shard(m, doc, term, np.frombuffer(b"".join(r[3] for r in rows), "<i4"), terms)
            for q, score, place in zip(*(x.tolist() for x in Walk(shard, least, k).run(*asked)), strict=True):
                best.setdefault(q, []).append((-score, rows[place][0] is None, rows[place][0] if rows[place][0] is not None else 0))
            for q, found in best.items():
                found.sort()
                del found[k:]
                if len(found) == k:
                    least[q] = max(least[q], -found[-1][0])

        for batch in batches:
            key = batch.column("doc_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts")), strict=True):
                if row[2]:
                    rows.append(row)
                    held += len(row[2]) // 4
                if held >= SHARD:
                    walk()
                    rows, held = [], 0
        if rows:
            walk()
        told = [(q, items[q][0], None if none else doc, -score) for q, found in best.items() for score, none, doc in found]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), (pa.int64(), kind, key, pa.int64()), strict=True)], ["query", "item_id", "doc_id", "score"])

    return arrow_map(index, run, schema)


def search(queries: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best documents of each query (``item_id, text``): ``item_id, rank, doc_id, score``, by score, then ``doc_id``.

    Terms are runs of ASCII letters (case folded), digits and other characters than ASCII.  A term's weight falls with the documents that hold it, its impact in a document
    grows with its occurrences and falls with the document's length against the mean; all in whole numbers.  Statistics cover all documents.

    Queries are taken in blocks of at most ``QUERY_BYTES`` of text (one query may be larger); a block's terms go to all tasks.  Each block reads every document: a first walk keeps the
    postings of the block's terms and is written, a second counts documents by term, a third builds treaps over shards of ``SHARD`` postings within each task and
    walks them (:class:`Walk`).  Tasks return ``k`` rows a query at most, of which the best are ranked.  No posting is shuffled, and nothing is left out but what provably cannot enter.

    Null or empty texts match nothing; queries without a match have no rows; equal query rows count once, different texts of one ``item_id`` (or of null) are ranked each for itself; repeated
    documents rank one after the other; a null ``doc_id`` comes last among equal scores; empty tables give no rows; other columns are ignored.
    """
    name, doc_key = queries.schema["item_id"].dataType, docs.schema["doc_id"].dataType.simpleString()
    schema = f"query long, item_id {name.simpleString()}, doc_id {doc_key}, score long"
    texts = stored(queries.select("item_id", text_of().alias("text")).distinct(), "queries")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = max(1, math.ceil(size / QUERY_BYTES)), []
    for block in range(blocks):
        items = sorted(map(tuple, texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()), key=repr)
        counts = [Counter(terms_of(text.encode())) for _, text in items]
        numbers = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        index = stored(postings(docs, numbers), "postings")
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not numbers:
            continue
        df = document_frequencies(index, len(numbers)).tolist()
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df]
        asked = [(q, numbers[t], n * weight[numbers[t]]) for q, c in enumerate(counts) for t, n in sorted(c.items()) if weight[numbers[t]]]
        if asked:
            columns = tuple(np.array(c, np.int64) for c in zip(*asked, strict=True))
            ranked = _ranked(index.where(F.length("terms") > 0), [(i,) for i, _ in items], columns, n_docs, n_terms, len(numbers), k, to_arrow_type(name), schema)
            found.append(ranked.withColumn("query", F.col("query") * blocks + block))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {name.simpleString()}, rank int, doc_id {doc_key}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
