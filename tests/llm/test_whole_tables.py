"""The classifier and the secret scan over a whole table, against plain versions without Spark."""

import collections
import math
import re
import zlib

import numpy as np

from veilframe.llm import quality_knn, queries

SF = "/root/testdata/sf0.01"


def plain_features(text):
    """Hashed words, hashed shapes and whole-text classes of one text, word by word."""
    words, total = (text or "").encode().split(), collections.Counter()
    for word in words:
        letters = bytes(c for c in word.lower() if 97 <= c <= 122 or c >= 128)
        kinds = "".join("a" if 97 <= c <= 122 or c >= 128 else "A" if 65 <= c <= 90 else "9" if 48 <= c <= 57 else chr(c) for c in word)
        shape = re.sub(r"([aA9])\1+", r"\1", kinds)[:16].encode()
        total[zlib.crc32(letters) % 2048] += 1
        total[2048 + zlib.crc32(shape) % 1024] += 1
    n = max(len(words), 1)
    out = {f: math.log1p(c / n * 50) for f, c in total.items()}
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    out[3072 + min(int(10 * len(set(words)) / n), 10)] = 0.3
    out[3072 + 12 + min(int(20 * twice), 20)] = 2.0
    out[3072 + 34 + min(len(words).bit_length(), 20)] = 0.3
    return out


def test_quality_scores_equal_a_plain_vote(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    rows = [(r.doc_id, plain_features(r.text)) for r in docs]
    df = collections.Counter(f for _, x in rows for f in x)
    vectors = {}
    for doc, x in rows:
        dense = np.zeros(quality_knn.FEATURES)
        for f, w in x.items():
            dense[f] = w * (1 + math.log((1 + len(rows)) / (1 + df[f])))
        vectors[doc] = dense / np.linalg.norm(dense)
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    model = quality_knn.fit(table("documents"), table("labels").where(~quality_knn.is_held_out()).select("doc_id", "quality"), "quality")
    axes = model["axes"].astype(np.float64)
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-4)
    known = [k for k in sorted(labels) if k in vectors]
    assert len(known) == len(model["y"]) and [labels[k] for k in known] == model["y"].astype(int).tolist()
    # the axes hold as much of the labelled rows as the best ones of that rank would
    x = np.stack([vectors[k] for k in known])
    best = np.linalg.svd(x, compute_uv=False)[: axes.shape[1]]
    assert np.linalg.norm(x @ axes) ** 2 > 0.98 * (best**2).sum()
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    at = [unit(vectors[k] @ axes) for k in known]
    apart = []
    for r in queries.op3_quality(spark, SF).collect():
        mine = unit(vectors[r.doc_id] @ axes)
        near = sorted(((float(mine @ v), labels[k]) for k, v in zip(known, at, strict=True)), reverse=True)[:25]
        weights = [(max(c, 1e-6) ** 8, y) for c, y in near]
        want = sum(w * y for w, y in weights) / sum(w for w, _ in weights)
        apart.append(abs(want - r.score))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and (r.predicted == (want >= 0.5) or abs(want - 0.5) < 0.05)
    # single precision may swap the last of 25 neighbours
    assert len(apart) == len(rows) and max(apart) < 0.05 and np.mean(np.array(apart) < 1e-3) > 0.99


def plain_secrets(text):
    """Base spans and candidates of a text, as lists of ``start, end, kind, value``."""
    base = [(m.start(), m.end(), "assign", m[2]) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII) if len(m[2]) >= 12]
    base += [(m.start(), m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]

    def live(value):
        share = [c / len(value) for c in collections.Counter(value).values()]
        return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and -sum(p * math.log2(p) for p in share) >= 3.2

    more = {(b - len(v), b, v) for _, b, _, v in base if live(v)}
    for m in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", text):
        body = m[0].rstrip("=")
        # no further sign may follow what is one string, so its end is where the signs end
        if len(body) >= 20 and live(m[0]) and not any(a < m.end() and m.start() < b for a, b, *_ in base):
            more.add((m.start(), m.end(), m[0]))
    return base, more


def test_secret_spans_equal_a_plain_count_of_owners(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = [(r, *plain_secrets(r.text or "")) for r in docs]
    owners, repositories = collections.defaultdict(set), collections.defaultdict(set)
    for r, _, more in found:
        for _, _, value in more:
            owners[value].add(r.source)
            repositories[value].add((r.source, r.lang))
    copied = {v for v in owners if len(owners[v]) >= 3 or len(repositories[v]) >= 6}
    order = ("assign", "access", "hex", "owned")
    want = {}
    for r, base, more in found:
        spans = [(a, order.index(k), b) for a, b, k, _ in base] + [(a, 3, b) for a, b, v in more if v not in copied]
        want[r.doc_id] = (",".join(f"{order[k]}:{a}:{b}" for a, k, b in sorted(spans)), len([1 for *_, v in more if v in copied]), len([1 for *_, v in more if v not in copied]))
    got = {r.doc_id: (r.spans, r.n_examples, r.n_owned) for r in queries.op10_secret_scan(spark, SF).collect()}
    assert got == want and sum(n for *_, n in want.values()) >= 10


def test_a_value_of_many_owners_is_an_example(spark):
    value = lambda k: f"Zk3Vt9Qw7Lp2Xc8Rb5Nm1H{k}"
    rows = []
    for k, (owners, langs) in enumerate([(1, 5), (2, 2), (3, 1), (2, 3), (1, 6), (1, 1)]):
        rows += [(len(rows) + 1, f"key {value(k)} end", f"l{n}", f"o{k}-{o}") for o in range(owners) for n in range(langs) for _ in range(2)]
    rows.append((None, f"a {value(0)}", None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    from veilframe.llm import secret_scan

    owned = {}
    for r in secret_scan.scan(docs).collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        owned.setdefault(text.split()[1], set()).add((r.n_owned, r.n_examples))
    assert owned == {value(0): {(0, 1)} if 5 + 1 >= 6 else {(1, 0)}, value(1): {(1, 0)}, value(2): {(0, 1)}, value(3): {(0, 1)}, value(4): {(0, 1)}, value(5): {(1, 0)}}
