"""The whole scrub: hits, masked text, summary and risk of every document, one narrow projection for each language."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import config as C
from ..plans.config import ScrubConfig, norm_lang
from .spans import HIT, clean, let, raw_hits, settled, standard_hits, unmarked


def by_key(hits: Column) -> Column:
    """Map from key to number of hits, keys in the order of their first hit."""
    keys = F.array_distinct(F.transform(hits, lambda h: h["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.size(F.filter(hits, lambda h: h["key"] == k)))))


def summary(hits: Column) -> Column:
    """``hit_count, masked_length, by_key, category_counts`` of standard hits."""
    categories = F.array_distinct(F.transform(hits, lambda h: h["category"]))
    counts = F.map_from_entries(F.transform(categories, lambda c: F.struct(c, F.size(F.filter(hits, lambda h: h["category"] == c)))))
    length = F.aggregate(hits, F.lit(0), lambda a, h: a + h["end"] - h["start"])
    return F.struct(F.size(hits).alias("hit_count"), length.alias("masked_length"), by_key(hits).alias("by_key"), counts.alias("category_counts"))


def risk(counts: Column, length: Column, from_pdf: Column) -> Column:
    """``score, level, top`` from hits by key (a map): capped counts of each group saturate, groups add up by weight; long and paged texts add a little."""
    total = F.lit(0.0)
    for group, keys in C.RISK_GROUPS.items():
        hits = reduce(lambda a, b: a + b, [F.least(F.coalesce(F.element_at(counts, F.lit(k)), F.lit(0)), F.lit(C.CAP_PER_KEY)) for k in keys])
        total = total + F.lit(C.GROUP_WEIGHT[group]) * F.when(hits > 0, 1 - F.exp(-F.lit(C.GROUP_K[group]) * hits)).otherwise(0.0)
    bonus = F.lit(C.BONUS["base"]) + F.when(length >= 1500, C.BONUS["len1500"]).otherwise(0) + F.when(length >= 4000, C.BONUS["len4000"]).otherwise(0) + F.when(from_pdf, C.BONUS["from_pdf"]).otherwise(0)
    score = F.least(F.greatest(F.floor(total * 100 + 0.5) + bonus, F.lit(0)), F.lit(100)).cast("int")
    level = F.when(score >= C.THRESHOLDS["high"], "high").when(score >= C.THRESHOLDS["mid"], "mid").otherwise("low")
    weights = F.create_map(*[x for k, w in C.RISK_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    weighed = F.transform(F.map_entries(counts), lambda e, i: F.struct((-e["value"] * F.coalesce(F.element_at(weights, e["key"]), F.lit(0))).alias("neg"), i.alias("i"), e["key"].alias("k"), e["value"].alias("c"), F.coalesce(F.element_at(weights, e["key"]), F.lit(0)).alias("w")))
    top = F.transform(F.slice(F.array_sort(weighed), 1, 3), lambda t: F.struct(t["k"].alias("k"), t["c"].alias("c"), t["w"].alias("w"), (-t["neg"]).alias("s")))
    return F.struct(score.alias("score"), level.alias("level"), top.alias("top"))


def _matched(docs: DataFrame, config: ScrubConfig, langs: dict[str, Column], text: str) -> DataFrame:
    """``docs`` with the results of :func:`match`; ``langs``: pack and the rows it is for."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hits = None
    given = docs.select(row, whole.alias("whole"), unmarked(whole).alias("_text"), *[test.alias(f"is_{p}") for p, test in langs.items()])
    for pack in langs:
        raw = raw_hits("_text", replace(config, lang=pack))
        hits = F.when(F.col(f"is_{pack}"), raw) if hits is None else hits.when(F.col(f"is_{pack}"), raw)
    lang = F.coalesce(*[F.when(F.col(f"is_{p}"), F.lit(p)) for p in langs])
    # each step in a projection of its own, read more than once by the next: the optimizer copies nothing
    found = given.select("row", "whole", lang.alias("pack"), hits.alias("raw"))
    done = found.select("row", "whole", "pack", "raw", settled(F.col("raw"), F.col("whole")).alias("s"))
    length = F.octet_length(F.encode("whole", "UTF-16BE")) / 2
    kept = F.transform(F.col("s.kept"), lambda k: F.get("raw", k))
    told = let(standard_hits(kept, F.col("s.starts"), F.col("s.ends"), F.col("pack")), lambda h: F.struct(h.alias("hits"), summary(h).alias("s")))
    fields = ["hit_count", "masked_length", "by_key", "category_counts"]
    done = done.select("row", F.col("s.masked").alias("text_masked"), length.alias("length"), told.alias("t"))
    return done.select("row.*", "t.hits", "text_masked", *[F.col(f"t.s.{f}") for f in fields], risk(F.col("t.s.by_key"), F.col("length"), F.lit(config.from_pdf)).alias("risk"))


def match(docs: DataFrame, config: ScrubConfig, text: str = "text") -> DataFrame:
    """Adds ``hits`` (standard records), ``text_masked``, ``hit_count``, ``masked_length``, ``by_key``, ``category_counts``, ``risk`` to ``docs``.

    A null text is empty.  Nothing is shuffled; the plan is projections over the scan.
    """
    return _matched(docs, config, {norm_lang(config.lang) or "zh": F.lit(True)}, text)


def scrub(docs: DataFrame, config: ScrubConfig, lang: str = "lang", text: str = "text") -> DataFrame:
    """:func:`match` for each row's language, in one pass over the input; rows of other languages take the configured one.  Adds ``rule_lang``."""
    known = F.lower(F.col(lang).cast("string"))
    routed = docs.withColumn("rule_lang", F.when(known.isin(*C.PACKS), known).otherwise(F.lit(norm_lang(config.lang) or "zh")))
    return _matched(routed, config, {p: F.col("rule_lang") == p for p in C.PACKS}, text)


def mask_text(docs: DataFrame, config: ScrubConfig, token: str = "███", text: str = "text") -> DataFrame:
    """``raw`` and ``masked_text``: every hit of the cleaned text replaced by one fixed token.  Blank texts have no hits."""
    given = docs.withColumn("raw", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_whole", clean(F.col(text)))
    given = given.withColumn("_text", unmarked(F.col("_whole")))
    hits = F.when(F.trim("_text") != "", raw_hits("_text", replace(config, enabled=config.enabled or frozenset()))).otherwise(F.array().cast(f"array<{HIT}>"))
    return given.withColumn("_hits", hits).withColumn("masked_text", settled(F.col("_hits"), F.col("_whole"), lambda h: F.lit(token))["masked"]).drop("_text", "_hits", "_whole")


def highlighted(masked: Column) -> Column:
    """Masked text as HTML: escaped, placeholders in a ``span``."""
    out = masked
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "(【[^【】]{1,36}】|\\[[^\\[\\]]{1,36}\\])", '<span class="ph">$1</span>')


def hit_rows(matched: DataFrame, *keys: str) -> DataFrame:
    """One row for each hit: ``keys`` and the hit's fields.  (An outer explode and a filter: for an inner one the optimizer tests the array first, and so works it out thrice.)"""
    return matched.select(*keys, F.explode_outer("hits").alias("h")).where("h IS NOT NULL").select(*keys, "h.*")


def hit_totals(matched: DataFrame, by: list[str], doc: str = "doc_id") -> DataFrame:
    """Hits by ``by`` and key with subtotals: ``by, key, level, hits, documents``; ``level`` is the grouping number (bits of the columns that are summed over, the last column lowest).

    Hits are counted within their row first, so what is dealt out by group is a row a document and key, not a row a hit.  A document counts once at each level.
    """
    counts = F.transform(F.array_distinct(F.transform("hits", lambda h: h["key"])), lambda k: F.struct(k.alias("key"), F.size(F.filter("hits", lambda h: h["key"] == k)).cast("long").alias("n")))
    each = matched.select(doc, *by, F.explode_outer(counts).alias("c")).where("c IS NOT NULL").select(doc, *by, "c.key", "c.n")
    return each.rollup(*by, "key").agg(F.grouping_id().alias("level"), F.sum("n").alias("hits"), F.count_distinct(doc).alias("documents"))


def coverage(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Differences of two runs' counts by key: ``keys, key, left_count, right_count`` where they differ."""
    count = lambda df, name: df.select(*keys, F.explode_outer("by_key").alias("key", name)).where("key IS NOT NULL")
    both = count(left, "left_count").join(count(right, "right_count"), [*keys, "key"], "full").na.fill(0, ["left_count", "right_count"])
    return both.where("left_count <> right_count")


# Words for risk levels, and advice, by language; other languages take the English ones.
RISK_WORDS = {
    "en": {"low": ("Low", "Ok to use. Money protection is on by default."), "mid": ("Medium", "Review top risks; consider stronger masking or manual redaction."), "high": ("High", "Do not send as-is: remove signature/account details and mask more.")},
    "de": {"low": ("Niedrig", "OK. Geldschutz ist standardmäßig aktiv (M1)."), "mid": ("Mittel", "Top-Risiken prüfen; ggf. stärker maskieren oder manuelle Schwärzung/Begriffe ergänzen."), "high": ("Hoch", "Nicht so versenden: Signatur/Konten entfernen und stärker maskieren.")},
    "zh": {"low": ("低", "可以使用。金钱保护默认开启（M1）。"), "mid": ("中", "请检查主要风险来源；可考虑加强遮罩或添加手工涂抹/术语。"), "high": ("高", "不建议直接发送：请移除签名/账户等敏感细节，并加强遮罩。")},
}


def risk_words(level: Column, lang: Column) -> Column:
    """``word, advice`` for a risk level in a language."""
    pick = lambda words, k: F.coalesce(*[F.when(level == name, F.lit(pair[k])) for name, pair in words.items()])
    told = lambda k: F.coalesce(*[F.when(lang == code, pick(words, k)) for code, words in RISK_WORDS.items()], pick(RISK_WORDS["en"], k))
    return F.struct(told(0).alias("word"), told(1).alias("advice"))
