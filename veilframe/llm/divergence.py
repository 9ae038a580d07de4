"""Divergence of sources: chi-square-like distances of term shares, summed by inclusion and exclusion over the terms that groups hold."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cuts, stored, text_of

#: Documents of a language that must hold a term, terms listed for each group, and the scale of shares.
LEAST_DOCS, RANKS, SCALE = 3, 200, 1_000_000_000
#: Terms that a task counts before it hands them on; rows of a key on either side of a block of pairs; groups that are broadcast at most.
HELD, BLOCK, MOST_BROADCAST = 400_000, 512, 20_000
#: Bytes that stand in terms: ASCII letters, A-Z as a-z, and all of other characters; any other byte parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: a term's occurrences and its documents in each group; tasks count before anything is shuffled."""
    rows = docs.select(*[text_of(c).alias(c) for c in ("lang", "source")], text_of().alias("text"))
    names = ["lang", "source", "term", "n", "docs"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def told(held: dict) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, holders) in held.items():
            for column, values in zip(columns, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), map(holders.__getitem__, n)), strict=True):
                column.extend(values)
        columns[2] = [t.decode() for t in columns[2]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            lang, source, text = (batch.column(c) for c in ("lang", "source", "text"))
            for a, b in cuts(pa.compute.binary_length(text).to_pylist(), 4_000_000):
                part = zip(lang.slice(a, b - a).to_pylist(), source.slice(a, b - a).to_pylist(), text.slice(a, b - a).cast(pa.binary()).to_pylist(), strict=True)
                for x, y, t in part:
                    n, holders = held.setdefault((x, y), (Counter(), Counter()))
                    words = t.translate(LETTERS).split()
                    n.update(words)
                    holders.update(set(words))
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield told(held)
                    held = {}
        if held:
            yield told(held)

    import pyarrow.compute  # noqa: F401

    counted = arrow_map(rows, run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))``, exactly."""
    exact = lambda c: c.cast("decimal(20,0)")
    top, bottom = F.lit(SCALE).cast("decimal(10,0)") * exact(count + 1), exact(total + terms)
    return F.call_function("div", top, bottom) + 1


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)`` of whole numbers."""
    return F.call_function("div", (p - q) * (p - q), q)


def paired(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both sides that agree in ``on``.  Where a key has many rows, each side's column ``blocks`` says into how many blocks they are cut; pairs of blocks then meet in tasks of their own.

    ``left`` and ``right`` have ``salt`` (any hash of the row) and ``blocks`` (the same number on both sides for a key).
    """
    one = left.select("*", F.pmod("salt", "blocks").alias("l_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("r_block")).drop("salt", "blocks")
    two = right.select("*", F.pmod("salt", "blocks").alias("r_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("l_block")).drop("salt", "blocks")
    return one.join(two, [*on, "l_block", "r_block"]).drop("l_block", "r_block")


def _blocks(rows: Column) -> Column:
    return F.ceil(rows / BLOCK).cast("long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """How far each group ``(lang, source)`` is from each other source of its language, and which terms it has too many of.

    A language keeps the terms that at least ``least_docs`` of its documents hold.  A group's share of a kept term is ``p = 1 + floor(10^9 (count + 1) / (N + V))``
    (``N``: the group's occurrences of kept terms, ``V``: kept terms), and ``f = floor((p - q)^2 / q)``.  Part ``pair``: the sum of ``f`` against another
    source over all kept terms.  Part ``term``: the first ``ranks`` terms that the group has, by ``f`` against the whole language, where ``p > q``.

    A pair's sum needs no row for a term that either side lacks.  Terms that both lack all give one constant.  Terms of one side give ``f`` by their count
    alone, so a histogram of counts prices them.  Both are first added up as if no term were in both; a join of the groups' posting lists then corrects the
    terms that are.  Lists of more than ``BLOCK`` sources are cut into blocks whose pairs meet in tasks of their own.

    Returns ``lang, source, part, item, value, rank``.  A null text, language or source is the empty string; a repeated row counts again; groups without any
    term stand in the pairs (a language without kept terms has distance 0 throughout); a language of one source has no pairs; an empty table gives no rows; other columns
    are ignored.
    """
    counts = stored(term_counts(docs), "term-counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("sources"))
    kept = by_term.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", _blocks(F.col("sources")).alias("blocks"))
    held = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "blocks"), "postings")

    # one row a group: its totals, its language's, and its share of a term that it lacks
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    there = docs.select(*[text_of(c).alias(c) for c in ("lang", "source")]).distinct()
    number = there.groupBy("lang").agg(_blocks(F.count("*")).alias("blocks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = there.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").join(number, "lang").select("lang", "source", zero("total"), zero("support"), zero("terms"), zero("lang_total"), "blocks")
    groups = stored(groups.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))), "groups")

    few = groups.count() <= MOST_BROADCAST
    facts = groups.select("lang", "source", "total", "terms", "lang_total", "p0")
    if few:
        known = held.join(F.broadcast(facts), ["lang", "source"])
    else:  # a group may hold a third of all rows: it is dealt over salts
        known = held.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(64))).join(facts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("salt")), ["lang", "source", "salt"]).drop("salt")
    priced = stored(known.select("lang", "source", "term", "n", "blocks", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "priced")

    sums = _constants(groups).unionByName(_one_sided(priced, groups)).unionByName(_overlaps(priced))
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    listed = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(listed).unionByName(ranked(over).where(F.col("rank") <= ranks))


def _sides(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    """The named columns with a prefix, and the salt for :func:`paired`."""
    return rows.select("lang", *[F.col(c).alias(f"{side}_{c}") for c in columns], "blocks", F.xxhash64("source").alias("salt"))


def _both_ways(rows: DataFrame, a: str, b: str, there: Column, back: Column) -> DataFrame:
    """``lang, source, item, value`` of both directions of a pair."""
    way = lambda x, y, v: F.struct(F.col(x).alias("source"), F.col(y).alias("item"), v.alias("value"))
    return rows.select("lang", F.inline(F.array(way(a, b, there), way(b, a, back))))


def _constants(groups: DataFrame) -> DataFrame:
    """Terms that neither side has, as if none were in both."""
    columns = ("source", "support", "terms", "p0")
    met = paired(_sides(groups, "a", *columns), _sides(groups, "b", *columns), ["lang"]).where("a_source < b_source")
    absent = F.col("a_terms") - F.col("a_support") - F.col("b_support")
    value = lambda p, q: F.when(F.col("a_terms") > 0, absent * distance(F.col(p), F.col(q))).otherwise(F.lit(0).cast("long"))
    return _both_ways(met, "a_source", "b_source", value("a_p0", "b_p0"), value("b_p0", "a_p0"))


def _one_sided(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """Terms of one side against the other's share of a term that it lacks, by histograms of counts."""
    bars = priced.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.first("p0").alias("p0"), F.count("*").alias("bars"))
    blocks = groups.select("lang", "source", F.col("blocks"))
    one = _sides(bars.join(blocks, ["lang", "source"]), "a", "source", "p", "bars")
    met = paired(one, _sides(groups, "b", "source", "p0"), ["lang"]).where("a_source <> b_source")
    there, back = F.col("a_bars") * distance(F.col("a_p"), F.col("b_p0")), F.col("a_bars") * distance(F.col("b_p0"), F.col("a_p"))
    summed = met.groupBy("lang", "a_source", "b_source").agg(F.sum(there).alias("there"), F.sum(back).alias("back"))
    return _both_ways(summed, "a_source", "b_source", F.col("there"), F.col("back"))


def _overlaps(priced: DataFrame) -> DataFrame:
    """What terms of both sides change: posting lists joined, summed by pair within tasks first."""
    side = lambda x: priced.select("lang", "term", *[F.col(c).alias(f"{x}_{c}") for c in ("source", "p", "p0")], "blocks", F.xxhash64("source").alias("salt"))
    met = paired(side("a"), side("b"), ["lang", "term"]).where("a_source < b_source")
    p, p0, q, q0 = F.col("a_p"), F.col("a_p0"), F.col("b_p"), F.col("b_p0")
    change = lambda p, p0, q, q0: distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)
    summed = met.groupBy("lang", "a_source", "b_source").agg(F.sum(change(p, p0, q, q0)).alias("there"), F.sum(change(q, q0, p, p0)).alias("back"))
    return _both_ways(summed, "a_source", "b_source", F.col("there"), F.col("back"))
