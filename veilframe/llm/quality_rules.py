"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored, text_function, text_of, whole_rows

#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Metrics: name, numerator, first occurrences that never count, denominator, factor, inner and outer percentile, stretch, whether low values
#: are fenced too.  The upper fence lies ``stretch`` times the distance of the two percentiles above the outer one; a lower fence mirrors it.
METRICS = (
    ("punctuation", "n_punctuation", 5, "n_words", 1000, 50, 75, 8, False),
    ("word_length", "word_chars", 0, "n_words", 100, 50, 75, 6, True),
    ("repeats", "n_repeat_words", 10, "n_words", 1000, 90, 98, 2, False),
    ("line_copies", "n_dup_lines", 1, "n_lines", 1000, 90, 98, 1, False),
    ("doubled", "n_doubled_words", 2, "n_words", 1000, 75, 95, 3, False),
    ("shouting", "n_upper_words", 0, "n_words", 1000, 75, 95, 3, False),
)
PERCENTILES = (25, 50, 75, 90, 95, 98)
#: A group's percentiles are drawn towards its language's with the weight of so many documents, and a language's towards the corpus's.
PRIOR = 200
#: Sketch resolution: values below 2**EXACT_BITS are exact, larger ones keep that many leading bits (relative error under 2**-EXACT_BITS).
EXACT_BITS = 6
#: Rows of a table up to which it is broadcast.
FEW = 20_000


def text_features(text: str) -> tuple[int, ...]:
    """The numbers named ``FEATURES`` of one whole text."""
    data = text.encode()
    words = data.split()  # bytes split at exactly the six ASCII blanks
    seen: set[str] = set()
    again = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        once: set[tuple] = set()
        twice: set[tuple] = set()
        for g in grams:
            (twice if g in once else once).add(g)
        upto = 0
        for k, g in enumerate(grams):
            if g in twice:
                repeated += k + WINDOW - max(k, upto)
                upto = k + WINDOW
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), again, repeated, len(data) - len(data.translate(None, PUNCTUATION)), sum(map(bytes.isupper, words)), sum(map(bytes.__eq__, words, words[1:])), lines


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_upper_words", "n_doubled_words", "n_lines")
_KIND = pa.struct([(c, pa.int64()) for c in FEATURES])


def _found(texts: pa.Array) -> list[pa.Array]:
    got = [text_features(x) for x in texts.to_pylist()]
    return [pa.array(c, pa.int64()) for c in zip(*got, strict=True)] if got else [pa.array([], pa.int64()) for _ in FEATURES]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the features of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ["doc_id", "lang", "source"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *_found(batch.column("text"))], [*names, *FEATURES])

    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select("doc_id", "lang", "source", text_of().alias("text"))
    return map_arrow(rows, work, ", ".join([*(f"{c} {kind[c]}" for c in ("doc_id", "lang", "source")), *(f"{c} long" for c in FEATURES)]))


def metric(name: str, held: str = "") -> Column:
    """Bucket of a metric; ``held`` is the struct that has the features, if any."""
    _, over, free, under, factor, *_ = next(m for m in METRICS if m[0] == name)
    at = lambda c: F.col(f"{held}.{c}" if held else c)
    return bucket(F.floor(F.greatest(at(over) - free, F.lit(0)) * factor / F.greatest(at(under), F.lit(1))).cast("long"))


def bucket(value: Column) -> Column:
    """Sketch bucket of a value, given as the least value of its bucket: all but the leading bits are cleared."""
    extra = F.greatest(F.length(F.bin(value)) - EXACT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, extra), extra)


def base_failed(held: str = "") -> Column:
    at = lambda c: F.col(f"{held}.{c}" if held else c)
    return (at("n_words") < LEAST_WORDS) | (at("n_repeat_words") * 100 > at("n_words") * MOST_REPEATED)


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable sketches of the documents that pass the base rules: counts of ``(level, lang, source, metric, bucket)``, level 0 a language and source, 1 a language, 2 everything.

    Buckets are the same everywhere, so a merge is a sum: partial sums before the shuffle, rolled up from groups to languages to all.
    """
    values = F.array(*[F.struct(F.lit(m[0]).alias("metric"), metric(m[0]).alias("bucket")) for m in METRICS])
    base = rows.where(~base_failed()).select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.explode(values).alias("v")).groupBy("lang", "source", "v.metric", "v.bucket").agg(F.count("*").alias("n"))
    langs = base.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    total = langs.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    level = lambda df, k, lang, source: df.select(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"), "metric", "bucket", "n")
    return level(base, 0, F.col("lang"), F.col("source")).union(level(langs, 1, F.col("lang"), none)).union(level(total, 2, none, none))


def percentiles(sketch: DataFrame) -> DataFrame:
    """``level, lang, source, metric, n_docs`` and the ``PERCENTILES`` of each sketch as ``p25`` and so on."""
    group = ["level", "lang", "source", "metric"]
    ranked = sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    reached = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))).alias(f"p{q}")
    return ranked.groupBy(*group).agg(F.max("total").alias("n_docs"), *[reached(q) for q in PERCENTILES])


def group_fences(found: DataFrame) -> DataFrame:
    """``lang, source, n_docs`` and a map from metric to its lowest and highest kept bucket.

    Percentiles are shrunk by counts: a group of n documents weighs n against ``PRIOR`` for its language, whose own weigh likewise against
    the corpus's.  So a large source has its own fences and a small one borrows, with no step between.
    """
    names = [f"p{q}" for q in PERCENTILES]
    every = {r["metric"]: r for r in found.where("level = 2").collect()}  # a row for each metric
    if not every:
        return found.select("lang", "source", "n_docs", F.lit(None).cast("map<string,struct<low:long,high:long>>").alias("fences"))
    drawn = lambda own, n, to: F.expr(f"({n} * {own} + {PRIOR} * {to}) div ({n} + {PRIOR})")
    of_all = {c: F.element_at(F.create_map(*[x for m, r in every.items() for x in (F.lit(m), F.lit(r[c]).cast("long"))]), F.col("metric")) for c in names}
    langs = found.where("level = 1").select("lang", "metric", "n_docs", *names, *[of_all[c].alias(f"all_{c}") for c in names])
    langs = stored(langs.select(F.col("lang").alias("of_lang"), F.col("metric").alias("of_metric"), *[drawn(c, "n_docs", f"all_{c}").alias(f"lang_{c}") for c in names]), "language-percentiles")
    own = found.where("level = 0").join(F.broadcast(langs) if langs.count() <= FEW else langs, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("metric") == F.col("of_metric")))
    own = own.select("lang", "source", "metric", "n_docs", *[drawn(c, "n_docs", f"lang_{c}").alias(c) for c in names])
    low, high = F.lit(-1).cast("long"), F.lit(None).cast("long")
    for name, _, _, _, _, inner, outer, stretch, both in METRICS:
        # a spread is at least the sketch's resolution there
        reach = lambda edge, a, b: F.greatest(F.col(a) - F.col(b), F.expr(f"{edge} div {1 << (EXACT_BITS - 1)}")) * stretch  # noqa: B023, E731
        high = F.when(F.col("metric") == name, F.col(f"p{outer}") + reach(f"p{outer}", f"p{outer}", f"p{inner}")).otherwise(high)
        if both:
            low = F.when(F.col("metric") == name, F.col(f"p{100 - outer}") - reach(f"p{100 - outer}", f"p{inner}", f"p{100 - outer}")).otherwise(low)
    entry = F.struct("metric", F.struct(low.alias("low"), high.alias("high")).alias("fence"))
    return own.select("lang", "source", "n_docs", entry.alias("e")).groupBy("lang", "source").agg(F.max("n_docs").alias("n_docs"), F.map_from_entries(F.collect_list("e")).alias("fences"))


def adaptive_fences(found: DataFrame) -> DataFrame:
    """Fences of every language and source, as a stored table (a handful of numbers for each group)."""
    return stored(group_fences(stored(percentiles(sketches(found)), "percentiles")), "fences")


def judged(rows: DataFrame, group: DataFrame, lang: Column, source: Column, key: Column, held: str = "") -> DataFrame:
    """Adds ``base_failed, kept``.  Fences of few groups are broadcast; of many (their number is checked), joined over salted keys."""
    limits = group.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), "fences")
    match = lang.cast("string").eqNullSafe(F.col("fence_lang")) & source.cast("string").eqNullSafe(F.col("fence_source"))
    if group.count() <= FEW:
        joined = rows.join(F.broadcast(limits), match, "left")
    else:
        salts = 32
        limits = limits.withColumn("fence_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.join(limits, match & (F.pmod(F.xxhash64(key.cast("string")), F.lit(salts)).cast("int") == F.col("fence_salt")), "left")
    inside = F.lit(True)
    for name, *_ in METRICS:
        fence = F.col("fences")[name]
        inside = inside & metric(name, held).between(fence["low"], fence["high"])
    failed = base_failed(held)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(False)))


def assess(docs: DataFrame) -> DataFrame:
    """Base features and the verdict of every document.

    One pass computes the features of whole texts; sketches of all documents that pass the base rules give each language and source its own
    fences from percentiles, small groups drawn towards their language and the corpus; the features are joined with the fences.  Only counts
    cross the network before that join.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and ``lang, source`` and the other
    features for every row of ``docs``, repeated rows included.  A null text has no words and fails the base rules; null
    languages and sources are groups of their own; an empty table gives an empty result; further columns are ignored.
    """
    found = stored(features(docs), "features")
    return judged(found, adaptive_fences(found), F.col("lang"), F.col("source"), F.col("doc_id")).select("doc_id", *FEATURES[:5], "base_failed", "kept", "lang", "source", *FEATURES[5:])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that :func:`assess` keeps.

    Texts are read twice rather than shuffled; the second time a text goes to the workers once, only its features come back, and the rest of
    the row stays with Spark.  Nulls, repeated rows and empty tables as in :func:`assess`.
    """
    fenced = adaptive_fences(features(docs))
    measure = text_function(docs.sparkSession, lambda texts: pa.StructArray.from_arrays(_found(texts), fields=list(_KIND)), "struct<" + ",".join(f"{c}:long" for c in FEATURES) + ">")
    return judged(whole_rows(docs, found=measure(text_of())), fenced, F.col("row.lang"), F.col("row.source"), F.col("row.doc_id"), "found").where("kept").select("row.*")
