"""Treap search, best-fit packing and the divergence audit against brute-force versions."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import binpack, divergence, treap_search
from veilframe.llm.bpe_ids import ids_of
from veilframe.llm.common import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, terms string, score long, rank int, piece int, part string, value long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LETTER = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, 7, "t", "u", 9, 9, 9, "p", 9)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = [f"w{k}" if k % 3 else f"É{k}ß" for k in range(60)]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=n))
    texts = [None, "", "...", "one two 漢字", "Tie tie", "tie TIE", "İ ſ K", "x" * 5000, text(4000), *[text(rng.randint(1, 60)) for _ in range(150)]]
    out = [row(k, t, ["en", "de", None][k % 3], ["s1", "s2", "s3", None][k % 4]) for k, t in enumerate(texts)]
    return [*out, out[20], out[20], row(None, text(30), "en", "s1"), row(None, "tie tie"), row(500, None, "xx", "only"), row(501, "a b", "yy", "p"), row(502, "c", "yy", "q")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def ranked(rows, queries, k=20):
    """Scores by the definition, document by document."""
    terms = [(r[0], TERM.findall(fold(r[1]))) for r in rows]
    terms = [(d, t) for d, t in terms if t]
    n_docs, total = len(terms), sum(len(t) for _, t in terms)
    df = collections.Counter(t for _, words in terms for t in set(words))
    out = []
    for item, text in sorted(set(queries), key=repr):
        asked, scores = collections.Counter(TERM.findall(fold(text))), []
        for doc, words in terms:
            tf, m = collections.Counter(words), 75 + 25 * len(words) * n_docs // total
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, n in asked.items() if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "at_once", "block"), [(1_000_000, 1024, 2_000_000), (40, 2, 2_000_000), (300, 7, 40)])
def test_search_equals_scoring_all(spark, docs, rows, monkeypatch, shard, at_once, block):
    monkeypatch.setattr(treap_search, "SHARD", shard)
    monkeypatch.setattr(treap_search, "AT_ONCE", at_once)
    monkeypatch.setattr(treap_search, "QUERY_BYTES", block)
    queries = [(1, rows[9][1]), (2, "tie Tie nowhere"), (3, None), (4, "...")] + [(10 + k, rows[30 + k][1]) for k in range(8)] + [(1, rows[9][1]), (1, "w1 w1 w2"), (None, "é3ß É3ß w4")]
    asked = spark.createDataFrame([(i, t, 5) for i, t in queries], "item_id long, text string, score int")
    got = sorted((tuple(r) for r in treap_search.search(asked, docs).collect()), key=repr)
    assert got == ranked(rows, queries)
    assert len({r[:2] for r in got}) < len(got) and treap_search.search(asked.where("false"), docs).count() == 0 and treap_search.search(asked, docs.where("false")).count() == 0


def test_search_keeps_ties_by_id_and_any_k(spark):
    rows = [row(k, "same words here") for k in range(60, 0, -1)] + [row(100 + k, f"other {k}") for k in range(200)]
    docs, asked = spark.createDataFrame(rows, SCHEMA).repartition(7), spark.createDataFrame([("q", "same words")], "item_id string, text string")
    for k in (1, 5, 60):
        assert [(r.rank, r.doc_id) for r in treap_search.search(asked, docs, k).orderBy("rank").collect()] == [(n, n) for n in range(1, k + 1)]


def test_treaps_are_treaps_and_walks_prune():
    rng = np.random.default_rng(1)
    n, terms = 3000, 40
    pairs = np.unique(np.stack([rng.integers(0, terms, 20_000) ** 2 // terms, rng.integers(0, n, 20_000)], 1), axis=0)
    term, doc = pairs[:, 0], pairs[:, 1]
    shard = treap_search.Shard(np.full(n, 100), doc, term, rng.integers(1, 9, len(doc)), terms)

    def below(node, low, high, most):
        if node >= 0:
            assert low <= shard.doc[node] < high and shard.value[node] <= most
            below(shard.left[node], low, shard.doc[node], shard.value[node])
            below(shard.right[node], shard.doc[node] + 1, high, shard.value[node])

    for root in shard.roots:
        below(root, 0, n, 10**9)
    seen = 0

    class Counting(treap_search.Walk):
        def _split(self, spans, *rest):
            nonlocal seen
            seen += len(spans[0])
            return super()._split(spans, *rest)

    asked = (np.zeros(3, np.int64), np.array([0, 39 * 39 // 40, 25]), np.array([10, 900, 300]))
    query, score, place = Counting(shard, np.zeros(1, np.int64), 20).run(*asked)
    plain = np.zeros(n, np.int64)
    for t, w in zip(asked[1], asked[2], strict=True):
        at = slice(*np.searchsorted(np.sort(term), [t, t + 1]))
        plain[shard.doc[at]] += w * shard.value[at]
    order = np.lexsort((np.arange(n), -plain))[:20]
    assert place.tolist() == order.tolist() and score.tolist() == plain[order].tolist() and seen < n / 2


@pytest.mark.parametrize("length", [2048, 64, 7])
def test_packing_whole_documents(docs, rows, monkeypatch, length):
    monkeypatch.setattr(binpack, "WINDOW", 40 * length)
    monkeypatch.setattr(binpack, "GROUP", 60 * length)
    monkeypatch.setattr(binpack, "HANDED_ON", 4)
    got = binpack.pack(docs, length=length).collect()
    encode, by_doc, by_sequence = ids_of(vocabulary()), collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and 0 < r.length <= length
    want = collections.Counter()
    for r in rows:
        want[r[0], tuple(encode(r[1] or "").tolist() + [0])] += 1
    seen = collections.Counter()
    for doc, pieces in by_doc.items():
        held = collections.defaultdict(list)
        for r in pieces:
            held[r.piece].append(r)
        starts = {k: {r.start for r in v} for k, v in held.items()}
        assert all(0 in s for s in [starts[0]])
        # rows of one id: put pieces together by length and content
        for (d, ids), n in want.items():
            if d != doc or (d is None and d != doc):
                continue
            first = len(ids) % length or length
            edges = [0, *range(first, len(ids) + 1, length)]
            parts = [np.array(ids[a:b], "<u4").tobytes() for a, b in itertools.pairwise(edges)]
            for k, part in enumerate(parts):
                assert sum(bytes(r.ids) == part and r.start == edges[k] for r in held[k]) >= n
            seen[d, ids] += n
    assert seen == want and sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1] and sum(r.length for r in pieces) <= length
    assert len(by_sequence) <= -(-sum(r.length for r in got) // length) * 1.02 + 2
    assert binpack.pack(docs.where("false"), length=length).count() == 0


def test_exchanges_empty_bins_and_raise_squared_fill():
    rng = random.Random(2)
    gained = 0
    for room, low, high in ((100, 20, 60), (100, 30, 70), (2048, 300, 900), (2048, 1, 2047), (10, 1, 1), (50, 26, 50)):
        for _ in range(6):
            sizes = [rng.randint(low, high) for _ in range(rng.randint(0, 300))]
            bins = binpack.best_fit(sizes, room)
            before, square = len(bins), sum(sum(sizes[i] for i in b) ** 2 for b in bins)
            after = binpack.Exchange([list(b) for b in bins], sizes, room).search()
            assert sorted(i for b in after for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= room for b in after)
            assert len(after) <= before and sum(sum(sizes[i] for i in b) ** 2 for b in after) >= square
            gained += before - len(after)
    assert gained > 5
    # every kind of step: a move, one for one, one for two, two for one
    step = lambda bins, sizes, room: [sorted(sorted(sizes[i] for i in b) for b in binpack.Exchange(bins, sizes, room).search())]
    assert step([[0], [1]], [5, 3], 10) == [[[3, 5]]]
    assert step([[0, 1], [2, 3]], [6, 3, 4, 3], 10) == [[[3, 3], [4, 6]]]
    assert step([[0, 1, 2], [3, 4]], [3, 3, 3, 7, 1], 10) == [[[1, 3, 3, 3], [7]]]
    assert step([[0, 1], [2, 3]], [5, 4, 2, 3], 10) == [[[2, 3, 5], [4]]]


def audited(rows, least=3, ranks=200):
    count, held = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in rows:
        words = LETTER.findall(fold(text))
        count[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang in {k[0] for k in count}:
        kept = [t for t, n in held[lang].items() if n >= least]
        groups = {s: {t: c[t] for t in kept} for (x, s), c in count.items() if x == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, name, -v, k + 1) for part, listed in (("pair", pairs), ("term", terms)) for k, (v, _, name) in enumerate(listed)]
    return sorted(out)


@pytest.mark.parametrize(("block", "most", "held"), [(512, 20_000, 400_000), (2, 0, 3)])
def test_audit_equals_all_terms_of_all_pairs(docs, rows, monkeypatch, block, most, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "MOST_BROADCAST", most)
    monkeypatch.setattr(divergence, "HELD", held)
    got = sorted(tuple(r) for r in divergence.audit(docs, ranks=5).collect())
    assert got == audited(rows, ranks=5)
    assert ("xx", "only") not in {r[:2] for r in got} and ("yy", "p", "pair", "q", 0, 1) in got


def test_audit_of_nothing_and_of_exact_large_numbers(spark, docs):
    assert divergence.audit(docs.where("false")).count() == 0
    values = spark.createDataFrame([(n, 10**12, 10**6) for n in (0, 1, 10**11, 10**12)], "n long, total long, terms long")
    got = [r[0] for r in values.orderBy("n").select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (10**12 + 10**6) for n in (0, 1, 10**11, 10**12)]
