"""Stored match results as JSON: hit records of several makes, whole results, pages of items; and this library's own results in that form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a record may hold its key, its start and its end, in the order in which they are tried, and a length that ends it.
KEY_NAMES, START_NAMES, END_NAMES, LENGTH_NAME = ("key", "ruleKey", "type"), ("a", "start", "from", "index"), ("b", "end", "to"), "len"
VERSION, SOURCE, LANGUAGE = "match-result-v1", "matcher-core", "zh"
LANGUAGES = ("zh", "en", "de")

RESULT = (
    "version string, source string, lang string, hits array<struct<id:string, key:string, page:double, start:double, end:double, text:string, masked:string, "
    "rects:array<struct<x:double, y:double, w:double, h:double>>>>"
)
PAGES = "array<struct<pageNumber:double, items:array<struct<str:string, transform:array<double>, width:double, height:double, hasEOL:boolean>>>>"


def _string(record: Column, name: str) -> Column:
    held = F.try_variant_get(record, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get(record, f"$.{name}", "string"))


def _number(record: Column, name: str) -> Column:
    held = F.try_variant_get(record, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(held).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(record, f"$.{name}", "double"))


def hit_span(record: Column) -> Column:
    """``key, a, b, part_a, part_b, id`` of one hit record (a variant, as ``try_parse_json`` gives it), or null if it has no key, no place, or no length.

    The first name that holds a string is the key; the first ones that hold numbers are the start and the end, which a length may stand for.  ``preferSub`` (``offsetStart, offsetEnd``) is the part that the span
    prefers.  Places before the text's begin count as its begin.
    """
    key = F.coalesce(*[_string(record, n) for n in KEY_NAMES], F.lit(""))
    a = F.coalesce(*[_number(record, n) for n in START_NAMES])
    b = F.coalesce(*[_number(record, n) for n in END_NAMES], a + _number(record, LENGTH_NAME))
    whole = lambda c: F.greatest(c, F.lit(0.0)).cast("int")
    part = lambda n: F.try_variant_get(record, f"$.preferSub.{n}", "double").cast("int")
    told = F.struct(key.alias("key"), whole(a).alias("a"), whole(b).alias("b"), part("offsetStart").alias("part_a"), part("offsetEnd").alias("part_b"), F.coalesce(F.try_variant_get(record, "$.id", "string"), F.lit("")).alias("id"))
    return F.when((key != "") & (b > a), told)


def hit_spans(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with the usable hits of JSON strings in ``column`` as ``key, a, b, part_a, part_b, id``; strings that are no JSON objects, and hits without a key or a place, are left out."""
    others = [F.col(f"`{c}`") for c in records.columns if c != column]
    # exploded, so that the optimizer does not copy the parsing to each of the places that read it
    parsed = records.select(*others, F.explode_outer(F.array(F.try_parse_json(F.col(column)))).alias("_record"))
    given = parsed.select(*others, F.explode_outer(F.array(hit_span(F.col("_record")))).alias("_hit"))
    return given.where("_hit IS NOT NULL").select(*others, "_hit.*")


def results(stored: DataFrame, doc_id: str = "doc_id", column: str = "result") -> DataFrame:
    """``doc_id, version, source, lang, id, key, page, start, end, text, masked, rects``: a row for each hit of stored results (JSON strings); what a result lacks has its default, a language of ours or Chinese."""
    told = stored.select(F.col(doc_id).alias("doc_id"), F.from_json(column, RESULT).alias("r"))
    blank = lambda c, d="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    lang = F.lower(F.col("r.lang"))
    head = told.select("doc_id", blank("r.version", VERSION).alias("version"), blank("r.source", SOURCE).alias("source"), F.when(lang.isin(*LANGUAGES), lang).otherwise(LANGUAGE).alias("lang"), F.explode_outer("r.hits").alias("h")).where("h IS NOT NULL")
    place = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("int").alias(c[2:])
    return head.select(
        "doc_id", "version", "source", "lang", blank("h.id").alias("id"), blank("h.key").alias("key"), F.col("h.page").cast("int").alias("page"), place("h.start"), place("h.end"), blank("h.text").alias("text"), blank("h.masked").alias("masked"),
        F.coalesce("h.rects", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")).alias("rects"),
    )


def paged_items(stored: DataFrame, doc_id: str = "doc_id", column: str = "pages") -> DataFrame:
    """``doc_id, page_number, items`` of stored pages (JSON arrays): a page without a number has its place's, an item without a transform the identity, and missing sizes are 0."""
    identity = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)])
    item = lambda i: F.struct(
        F.coalesce(i["str"], F.lit("")).alias("str"), F.when(i["transform"].isNull(), identity).otherwise(F.slice(i["transform"], 1, 6)).alias("transform"), F.coalesce(i["width"], F.lit(0.0)).alias("width"), F.coalesce(i["height"], F.lit(0.0)).alias("height"),
        F.coalesce(i["hasEOL"], F.lit(False)).alias("hasEOL"),
    )
    each = stored.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(F.from_json(column, PAGES)).alias("n", "p")).where("n IS NOT NULL")
    number = F.coalesce(F.nullif(F.col("p.pageNumber"), F.lit(0.0)), F.col("n") + 1.0).cast("int")
    return each.select("doc_id", number.alias("page_number"), F.transform(F.coalesce("p.items", F.array().cast(each.schema["p"].dataType["items"].dataType)), item).alias("items"))


def to_results(matched: DataFrame, lang: Column | None = None) -> DataFrame:
    """``doc_id, result``: output of :func:`..operators.scrub.match` (or ``scrub``) as stored results, places in UTF-16 units, that :func:`results` reads."""
    lang = lang if lang is not None else F.col("rule_lang")
    hit = lambda h: F.struct(h["id"], h["key"], h["start_utf16"].alias("start"), h["end_utf16"].alias("end"), h["text"], h["masked"])
    told = F.struct(F.lit(VERSION).alias("version"), F.lit(SOURCE).alias("source"), lang.alias("lang"), F.transform("hits", hit).alias("hits"))
    return matched.select("doc_id", F.to_json(told).alias("result"))
