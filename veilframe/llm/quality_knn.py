"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, text_of

#: Labelled rows that vectors are kept of (those of least hash), neighbours that vote, latent dimensions.
MAX_LABELLED, NEIGHBOURS, RANK, SEED = 6_000, 25, 48, 42
#: Hashed words, hashed word shapes, and features of the whole text (repetition and length classes).
WORDS, SHAPES, WHOLE = 2048, 1024, 64
FEATURES = WORDS + SHAPES + WHOLE
#: Words whose features a worker remembers; documents in a block of cosine products.
MEMO, ROWS = 600_000, 1024

#: Kinds of characters in a shape: lower-case letters and all beyond ASCII as "a", upper-case as "A", digits as "9".
_KIND = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else c for c in range(256))
_OTHER = bytes(c for c in range(128) if not 97 <= c <= 122)
_RUN = re.compile(rb"([aA9])\1+")
_memo: dict[bytes, int] = {}


def word_features(word: bytes) -> int:
    """Hashed word (letters only, lower case) and hashed shape, packed into one number: runs of one kind of character shown once, other characters as they are."""
    if len(_memo) >= MEMO:
        _memo.clear()
    shape = _RUN.sub(rb"\1", word.translate(_KIND))[:16]
    got = zlib.crc32(word.lower().translate(None, _OTHER)) % WORDS | (WORDS + zlib.crc32(shape) % SHAPES) << 16
    if len(word) <= 64:
        _memo[word] = got
    return got


def text_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse term frequencies ``(features, damped counts)`` of a whole text."""
    words = text.encode().split()
    n = len(words)
    count = Counter(words)
    packed = np.array([_memo.get(w) or word_features(w) for w in count], np.int64)
    weight = np.fromiter(count.values(), np.float64, len(count))
    total = np.bincount(packed & 0xFFFF, weight, WORDS + SHAPES) + np.bincount(packed >> 16, weight, WORDS + SHAPES)
    on = np.flatnonzero(total)
    damped = np.log1p(total[on] / max(n, 1) * 50)
    doubled = sum(map(bytes.__eq__, words, words[1:])) / max(n, 1)
    whole = [min(int(10 * len(count) / max(n, 1)), 10), 12 + min(int(20 * doubled), 20), 34 + min(n.bit_length(), 20)]
    return np.concatenate([on, np.array(whole) + WORDS + SHAPES]), np.concatenate([damped, [0.3, 2.0, 0.3]])


def _dense(parts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(parts), FEATURES), np.float32)
    for k, (f, w) in enumerate(parts):
        out[k, f] = w * idf[f]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def document_frequency(docs: DataFrame) -> np.ndarray:
    """In how many documents of the corpus each feature occurs: partial sums per batch, then a sum; one number for each feature comes back."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(FEATURES, np.int64)
        for text in batch.column("text").to_pylist():
            total[text_vector(text)[0]] += 1
        on = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["feature", "n"])

    rows = map_arrow(docs.select(text_of().alias("text")), work, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES, np.int64)
    for r in rows:
        out[r["feature"]] = r["n"]
    return out


def fit(docs: DataFrame, labelled: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> dict:
    """Latent space and labelled vectors.  ``labelled``: ``doc_id`` and a 0/1 label; of more than ``most`` rows those whose ids hash lowest."""
    n = docs.count()
    idf = (1 + np.log((1 + n) / (1 + document_frequency(docs)))).astype(np.float32)
    known = labelled.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    ids = stored(chosen, "labelled")
    # at most ``most`` ids are broadcast; of several texts under one id the first in order is learnt
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [text_vector(x) for x in batch.column("text").to_pylist()]
        arrays = [batch.column("doc_id"), batch.column("y"), pa.array([p[0].tolist() for p in parts], pa.list_(pa.int64())), pa.array([p[1].tolist() for p in parts], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "y", "f", "w"])

    got = map_arrow(texts, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, f array<long>, w array<double>")
    rows = sorted(got.collect(), key=lambda r: r["doc_id"])
    if not rows:
        return {"idf": idf, "axes": np.zeros((FEATURES, 1), np.float32), "at": np.zeros((1, 1), np.float32), "y": np.ones(1, np.float32)}
    x = _dense([(np.array(r["f"]), np.array(r["w"])) for r in rows], idf)
    rng = np.random.default_rng(SEED)
    rank = min(RANK, len(rows))
    q = np.linalg.qr(x @ rng.standard_normal((FEATURES, min(rank + 16, len(rows)))).astype(np.float32))[0]
    for _ in range(3):  # randomized singular value decomposition
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    return {"idf": idf, "axes": axes, "at": _unit(x @ axes), "y": np.array([r["y"] for r in rows], np.float32)}


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def vote(x: np.ndarray, at: np.ndarray, y: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors, from exact cosine products of a block."""
    sim = x @ at.T
    k = min(neighbours, sim.shape[1])
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(sim, near, 1), 1e-6).astype(np.float64) ** 8
    return (weight * y[near]).sum(axis=1) / weight.sum(axis=1)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``: the labelled vectors (of bounded number) are broadcast, and no row is moved."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = held.value, batch.column("text").to_pylist()
        out = np.empty(len(texts))
        for k in range(0, len(texts), ROWS):
            x = _dense([text_vector(t) for t in texts[k : k + ROWS]], m["idf"]) @ m["axes"]
            out[k : k + ROWS] = vote(_unit(x), m["at"], m["y"])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    rows = docs.select("doc_id", text_of().alias("text"))
    return map_arrow(rows, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """Quality of every whole text, learnt from the labelled rows that are not held out (crc32 of the id, modulo 3, is not 1).

    Document frequencies of hashed words, word shapes and repetition classes cover all documents; a randomized singular value
    decomposition of the labelled rows' TF-IDF matrix gives the latent axes; each document's cosine to every labelled vector is computed
    in blocks, and the nearest 25 vote by similarity.  Labels, language, source and id are never features.

    Returns ``doc_id, held_out, score, predicted`` for every row of ``docs``, repeated rows included.  A null or empty text is scored like
    any other; rows without an id are not held out; without labelled rows every score is 1; null labels are not learnt; an empty
    table gives an empty result; further columns are ignored.
    """
    model = fit(docs, labels.where(~is_held_out()).select("doc_id", label), label, most)
    return score(docs, model).select("doc_id", is_held_out().alias("held_out"), F.col("score"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
