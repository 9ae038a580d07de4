"""Secret scan: three base patterns, and further candidates judged by who else holds the same value."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, text_function, text_of, whole_rows

#: Base patterns and least lengths (fixed values); kinds in the order of the digest.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "owned")
KEYWORDS = (b"passw", b"secret", b"token", b"api")

#: Further candidates: long opaque strings.  Live-looking: letters and digits both, and at least this entropy a character.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
LEAST_ENTROPY = 3.2
#: A value that this many owners hold, or this many repositories of whatever owners, is a widely copied example and not a credential.
MANY_OWNERS, MANY_REPOSITORIES = 3, 6
#: Parts that the rows of a widely copied value are dealt to; rows of a table up to which it is broadcast.
SALTS, FEW = 16, 20_000


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, secret value`` of the base patterns, in code points, each kind leftmost and not overlapping."""
    out = []
    lower = text.encode().lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return out


def live_looking(value: str) -> bool:
    """Letters and digits both, and a high entropy a character."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= LEAST_ENTROPY


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """What ownership judges: live-looking values of the base spans, and further live-looking strings outside those."""
    out = {(b - len(v), b, v) for _, b, _, v in taken if live_looking(v)}
    starts, ends = zip(*sorted((a, b) for a, b, *_ in taken), strict=True) if taken else ((), ())
    furthest = list(itertools.accumulate(ends, max))
    for m in CANDIDATE.finditer(text):
        before = bisect.bisect_left(starts, m.end())  # spans that begin before its end
        if not (before and furthest[before - 1] > m.start()) and live_looking(m[0]):
            out.add((m.start(), m.end(), m[0]))
    return sorted(out)


def _value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


SPAN = "array<struct<start:long,end:long,kind:string,value_hash:long>>"


def scanned(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """``doc_id, text_hash, repository, owner, base, more``: base spans and the candidates, with hashes of their values (never the values)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value_hash", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, more = [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text)
            base.append([{"start": a, "end": b, "kind": k, "value_hash": _value_hash(v)} for a, b, k, v in sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))])
            more.append([{"start": a, "end": b, "kind": "owned", "value_hash": _value_hash(v)} for a, b, v in candidates(text, found)])
        keep = ["doc_id", "text_hash", "repository", "owner"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(base, kind), pa.array(more, kind)], [*keep, "base", "more"])

    owner = F.col("source").cast("string") if owner is None else owner
    repository = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("source", "lang")]) if repository is None else repository
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), repository.alias("repository"), owner.alias("owner"), text_of().alias("text"))
    return map_arrow(rows, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, repository string, owner string, base {SPAN}, more {SPAN}")


def ownership(found: DataFrame) -> DataFrame:
    """``value_hash, n_repositories, n_owners, n_rows`` of every candidate value over the whole corpus.

    Rows are counted for each value, repository and owner first (partial sums before the shuffle), so a value in very many rows is one
    small row for each of its holders.
    """
    held = found.select(F.explode("more").alias("s"), "repository", "owner").groupBy("s.value_hash", "repository", "owner").agg(F.count("*").alias("n"))
    distinct = lambda c: F.count_distinct(F.coalesce(F.col(c), F.lit("\0")))
    return held.groupBy("value_hash").agg(distinct("repository").alias("n_repositories"), distinct("owner").alias("n_owners"), F.sum("n").alias("n_rows"))


def examples(found: DataFrame) -> DataFrame:
    """``value_hash`` of the widely copied values, stored.  Each has several holders, so they are far fewer than the values that one document has."""
    held = ownership(found)
    return stored(held.where((F.col("n_owners") >= MANY_OWNERS) | (F.col("n_repositories") >= MANY_REPOSITORIES)).select("value_hash"), "examples")


def owned_spans(found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, owned``: the candidates that are not widely copied, per distinct document row."""
    return owned_spans_of(found, examples(found))


def owned_spans_of(found: DataFrame, common: DataFrame) -> DataFrame:
    rows = found.where(F.size("more") > 0).select("doc_id", "text_hash", "more").distinct().select("doc_id", "text_hash", F.explode("more").alias("s")).withColumn("value_hash", F.col("s.value_hash"))
    if common.count() <= FEW:
        left = rows.join(F.broadcast(common), "value_hash", "left_anti")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text_hash"), F.lit(SALTS)).cast("int"))
        left = rows.join(common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["value_hash", "salt"], "left_anti")
    return left.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("owned"))


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Secrets of every whole text, and who holds them.

    Base spans come from three patterns and always stay.  Their live-looking values and further live-looking strings are candidates; hashes of
    their values are aggregated by distinct repositories and owners over the whole corpus.  A candidate that many owners or very many
    repositories hold is a widely copied example; any other becomes a span of kind ``owned`` over its value: one owner's own, however
    often that owner repeats it.  Only hashes leave a document.  Unless told otherwise ``source`` stands for the owner and each language of a source for one of
    its repositories.

    Returns ``doc_id, base, spans, n_examples, n_owned``: arrays of ``start, end, kind, value_hash`` by start, then kind; the counts are those of the
    candidates on either side.  One row for each row of ``docs``, repeated rows included.  A null text is empty and has no spans;
    a null repository or owner counts as one of its own; an empty table gives an empty result; further columns are ignored.
    """
    return judged(stored(scanned(docs, repository, owner), "secrets"))


def judged(found: DataFrame) -> DataFrame:
    owned = owned_spans(found).select(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), "owned", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("o_part"))
    same = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash")) & (F.col("part") == F.col("o_part"))
    # rows without candidates take no part; of the others, those of one id and text are dealt over salts
    some = found.where(F.size("more") > 0).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = some.join(owned, same, "left").select(*found.columns, "owned").unionByName(found.where(F.size("more") <= 0), allowMissingColumns=True)
    extra = F.coalesce("owned", F.array().cast(SPAN))
    order = lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["end"], s["kind"], s["value_hash"])
    back = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value_hash"].alias("value_hash"))
    spans = F.transform(F.array_sort(F.transform(F.concat("base", extra), order)), back)
    return joined.select("doc_id", "base", spans.alias("spans"), (F.size("more") - F.size(extra)).alias("n_examples"), F.size(extra).alias("n_owned"), "text_hash")


def redact(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of :func:`scan` replaced by ``mark`` (of an assignment, its value only); all rows and columns stay.

    Base spans are found again where the text is; only those ``owned`` spans that lie outside them are joined, by id and text hash.  The text
    goes to the workers and comes back; the rest of a row stays with Spark.  A null text stays null; a column of any name may stand beside.
    """
    found = scanned(docs, repository, owner)
    # values within base spans are replaced anyway: only the others need judging here
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    found = stored(found.select("doc_id", "text_hash", "repository", "owner", "base", "more", apart.alias("apart")), "secrets")
    common = examples(found)
    owned = stored(owned_spans_of(found.select("doc_id", "text_hash", F.col("apart").alias("more")), common), "owned")
    small = owned.select(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), "owned")
    rows = whole_rows(docs, hash=F.xxhash64(text_of()))
    same = F.col("row.doc_id").eqNullSafe(F.col("o_id")) & (F.col("hash") == F.col("o_hash"))
    joined = rows.join(F.broadcast(small) if owned.count() <= FEW else small, same, "left")

    def work(texts: pa.Array, more: pa.Array) -> pa.Array:
        return pa.array([text if text is None else masked(text, [(s["start"], s["end"]) for s in spans or []], mark) for text, spans in zip(texts.to_pylist(), more.to_pylist(), strict=True)], pa.string())

    replaced = text_function(docs.sparkSession, work, "string")(F.col("row.text"), F.col("owned"))
    kind = docs.schema["text"].dataType
    done = joined.select("row", replaced.cast(kind).alias("text"))
    return done.select(*[F.col("text") if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def masked(text: str, more: list[tuple[int, int]], mark: str) -> str:
    """The text with its secret values replaced; overlapping spans are joined."""
    spans = sorted([(b - len(v) if k == "assign" else a, b) for a, b, k, v in base_spans(text)] + more)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
