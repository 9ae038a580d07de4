"""Rectangles of hits on pages: item ranges, character-proportional boxes, merging, and the audit of what was mapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import escape
from ..plans.tuning import ITEM_CAP, ITEM_FONT, NAME_KEYS, RECT_FONT, SHORT_TOKEN, BoxTuning, language_tuning, tuned
from .intervals import ITEM_BIN, PAGE_BIN, overlapping
from .merging import export_merged, merged_rects
from .spans import clean

__all__ = [
    "against_authority", "audit", "collapsed", "device_rects", "export_merged", "item_boxes", "item_ranges", "localized", "merged_rects", "merged_spans", "numbered", "on_device", "rects", "value_in", "with_manual",
]

#: Default tuning of boxes and merges.
WHOLE_ITEM_LENGTH, WHOLE_ITEM_SHARE, LONGEST_SPAN = 2, 0.72, 120
PAD_X, PAD_Y, LEAST_DRAG = 1.0, 1.0, 6
#: Characters that do not belong to a value at its ends.
WEAK = " \t\n\r:：,，;；()（）[]【】<>《》\"'“”‘’"


def item_ranges(items: Column) -> Column:
    """``text, ranges`` of a page: items in reading order; ``ranges`` holds each item's index and its place in the text.

    A blank goes only between two ASCII letters or digits; a new line starts a line, two at large gaps.
    """
    row = lambda it, i: F.struct((-(F.floor(it["transform"][5] * 2 + 0.5) / 2)).alias("down"), it["transform"][4].alias("x"), i.alias("idx"), it["str"].alias("s"))
    ordered = F.array_sort(F.filter(F.transform(items, row), lambda r: F.trim(r["s"]) != ""))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit("").alias("text"), F.array().cast("array<struct<idx:int,start:int,end:int>>").alias("ranges"))

    def add(a: Column, r: Column) -> Column:
        fresh = a["y"].isNull() | (F.abs(a["y"] - r["down"]) > 1.2)
        gap = F.when(a["y"].isNull(), "").when(fresh & (r["down"] - a["y"] > 12), "\n\n").when(fresh, "\n").when(a["text"].rlike("[A-Za-z0-9]\\z") & r["s"].rlike("^[A-Za-z0-9]"), " ").otherwise("")
        at = F.length(a["text"]) + F.length(gap)
        return F.struct(F.when(fresh, r["down"]).otherwise(a["y"]).alias("y"), F.concat(a["text"], gap, r["s"]).alias("text"), F.concat(a["ranges"], F.array(F.struct(r["idx"].cast("int").alias("idx"), at.alias("start"), (at + F.length(r["s"])).alias("end")))).alias("ranges"))

    return F.aggregate(ordered, start, add, lambda a: F.struct(a["text"].alias("text"), a["ranges"].alias("ranges")))


def against_authority(built: Column, authority: Column) -> Column:
    """``text, ranges`` of :func:`item_ranges` moved onto an authoritative text of the page.

    Each item's text is found from the end of the one before; if one is missing, or the authority is blank, the page's own text stays.
    """
    target = clean(authority)
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<struct<idx:int,start:int,end:int>>").alias("out"))

    def find(own: Column, whole: Column) -> Column:
        def step(a: Column, r: Column) -> Column:
            chunk = F.substring(own["text"], r["start"] + 1, r["end"] - r["start"])
            got = F.call_function("locate", chunk, whole, a["at"] + 1)
            end = (got - 1 + F.length(chunk)).cast("int")
            told = F.struct(r["idx"].alias("idx"), (got - 1).cast("int").alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), (a["ok"] & (got > 0)).alias("ok"), F.concat(a["out"], F.array(told)).alias("out"))

        return F.aggregate(own["ranges"], start, step)

    pair = F.struct(built.alias("own"), target.alias("whole"))
    moved = F.transform(F.array(pair), lambda p: F.struct(p["own"].alias("own"), p["whole"].alias("whole"), find(p["own"], p["whole"]).alias("got")))
    keep = lambda p: F.when((F.trim(p["whole"]) == "") | (p["own"]["text"] == p["whole"]) | ~p["got"]["ok"], p["own"]).otherwise(F.struct(p["whole"].alias("text"), p["got"]["out"].alias("ranges")))
    return F.transform(moved, keep)[0]


def localized(hits: DataFrame, offsets: DataFrame) -> DataFrame:
    """Hits (``doc_id, id, key, start, end``) clipped to the pages they meet, in page coordinates: ``doc_id, page_number, id, key, a, b``."""
    hits = hits.select("doc_id", "id", "key", "start", "end")
    pages = offsets.select("doc_id", "page_number", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    met = overlapping(hits, pages, ["doc_id"], ("start", "end"), ("p_start", "p_end"), PAGE_BIN)
    return met.select("doc_id", "page_number", "id", "key", (F.greatest("start", "p_start") - F.col("p_start")).alias("a"), (F.least("end", "p_end") - F.col("p_start")).alias("b"))


def merged_spans(spans: DataFrame, longest: int | dict[str, int] | None = None) -> DataFrame:
    """Overlapping or touching spans of one key on a page as one.  ``longest`` (one number, or one for each key and 120 for others) drops longer spans, as the original tuning did; by default none is dropped."""
    if isinstance(longest, dict):
        limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in longest.items() for x in kv]), F.col("key")), F.lit(LONGEST_SPAN)) if longest else F.lit(LONGEST_SPAN)
    else:
        limit = F.lit(longest)
    kept = spans if longest is None else spans.where(F.col("b") - F.col("a") <= limit)
    page = Window.partitionBy("doc_id", "page_number", "key").orderBy("a", "b")
    reach = F.max("b").over(page.rowsBetween(Window.unboundedPreceding, -1))
    flagged = kept.withColumn("fresh", (F.col("a") > F.coalesce(reach, F.lit(-1))).cast("int"))
    island = flagged.withColumn("island", F.sum("fresh").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "page_number", "key", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("id").alias("id")).drop("island")


def rects(spans: DataFrame, items: DataFrame) -> DataFrame:
    """One box for each span and item it covers.

    ``spans``: ``doc_id, page_number, id, key, a, b``; ``items``: ``doc_id, page_number, idx, start, end, x, y, w, h``.  A box takes the
    covered share of its item's width, or all of it if the item is very short or mostly covered.
    """
    met = overlapping(spans, items, ["doc_id", "page_number"], ("a", "b"), ("start", "end"), ITEM_BIN)
    n = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    lo, hi = F.greatest("a", "start") - F.col("start"), F.least("b", "end") - F.col("start")
    whole = (n <= WHOLE_ITEM_LENGTH) | ((hi - lo) / n >= WHOLE_ITEM_SHARE)
    x1 = F.when(whole, F.col("x")).otherwise(F.col("x") + F.col("w") * lo / n)
    x2 = F.when(whole, F.col("x") + F.col("w")).otherwise(F.col("x") + F.col("w") * hi / n)
    return met.select("doc_id", "page_number", "id", "key", (x1 - PAD_X).alias("x"), (F.col("y") - PAD_Y).alias("y"), (x2 - x1 + 2 * PAD_X).alias("w"), (F.col("h") + 2 * PAD_Y).alias("h"))


def on_device(items: DataFrame, layout: DataFrame) -> DataFrame:
    """Items on their page's raster: adds ``left, base, font, n, wide`` (place, font height, characters, width if known) and the page's size.

    ``items``: ``doc_id, page_number, idx, str, transform, width``; ``layout``: ``doc_id, page_number, viewport_width, viewport_height,
    viewport_transform``.  The item's affine matrix is multiplied by the page's; matrices are ``[a, b, c, d, e, f]``.
    """
    identity = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)])
    page, own = F.col("viewport_transform"), F.coalesce(F.col("transform"), identity)
    entry = lambda row, column: page[row] * own[2 * column] + page[row + 2] * own[2 * column + 1]
    length = lambda column, other: F.coalesce(F.nullif(F.hypot(entry(0, column), entry(1, column)), F.lit(0.0)), other)
    across = length(0, F.lit(1.0))
    known = F.when(F.col("width") > 0, F.col("width") * across)
    joined = items.join(layout, ["doc_id", "page_number"])
    return joined.select(*items.columns, "viewport_width", "viewport_height", (entry(0, 2) + page[4]).alias("left"), (entry(1, 2) + page[5]).alias("base"), length(1, across).alias("font"), F.greatest(F.length(F.coalesce("str", F.lit(""))), F.lit(1)).alias("n"), known.alias("wide"))


def _clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.greatest(lit(low), F.least(lit(high), value))


def item_boxes(placed: DataFrame) -> DataFrame:
    """``doc_id, page_number, idx, x, y, w, h`` of items of :func:`on_device`: widths beyond what the characters can fill are cut."""
    factor, least, most, char = ITEM_FONT
    page_w, page_h = F.col("viewport_width"), F.col("viewport_height")
    sized = placed.withColumn("font", _clamp(F.col("font") * factor, least, most)).withColumn("est", F.greatest(F.lit(8.0), F.col("n") * F.col("font") * char))
    wide = F.least(F.coalesce("wide", "est"), F.col("est") * F.when(F.col("n") <= 4, SHORT_TOKEN).otherwise(ITEM_CAP))
    cornered = sized.withColumn("x", _clamp(F.col("left"), 0, page_w)).withColumn("y", _clamp(F.col("base") - F.col("font"), 0, page_h))
    return cornered.select("doc_id", "page_number", "idx", "x", "y", _clamp(wide, 1, page_w - F.col("x")).alias("w"), _clamp(F.col("font"), least, page_h - F.col("y")).alias("h"))


def _of_key(table: dict, otherwise: object, pick: int | None = None) -> Column:
    """A key's entry of a small table, as a literal map."""
    value = lambda v: F.lit(v if pick is None else v[pick])
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), value(v))]), F.col("key")), value(otherwise)) if table else value(otherwise)


def value_in(sub: Column, tuning: BoxTuning) -> Column:
    """``skip, value`` of the covered text ``sub`` for the row's ``key``: the key's label (the first of its list that the text begins with, then blanks and a colon) and weak characters at both ends are left out.

    A key's labels are one alternation, tried once.  Manual terms and the tuning's ``keep_label`` keys stay as they are.
    """
    ends = "[" + "".join("\\" + c if c in "[]" else c for c in WEAK) + "]+"
    bare = sub
    for key, words in tuning.labels.items():
        bare = F.when(F.col("key") == key, F.regexp_replace(sub, "(?iu)\\A(?:" + "|".join(escape(w) for w in words) + ")\\s*[:：]?\\s*", "")).otherwise(bare)
    bare = F.when(F.col("key").isin("manual_term", *tuning.keep_label), sub).otherwise(F.regexp_replace(bare, "\\A" + ends, ""))
    value = F.when(F.col("key").isin("manual_term", *tuning.keep_label), sub).otherwise(F.regexp_replace(bare, ends + "\\z", ""))
    return F.struct((F.length(sub) - F.length(bare)).alias("skip"), value.alias("value"))


def device_rects(spans: DataFrame, placed: DataFrame, lang: str = "", tuning: BoxTuning | None = None, drop_oversize: bool = False) -> DataFrame:
    """Rectangles on the raster, one for each span and item it covers: ``doc_id, page_number, id, key, x, y, w, h``.

    ``spans``: ``doc_id, page_number, id, key, a, b`` and, if spans prefer a part, ``part_a, part_b`` from ``a`` on (see ``preferred``); ``placed``: :func:`on_device` with the items'
    ``start, end``.  A preferred part is covered alone, unless the tuning ignores it for the key; otherwise labels and weak punctuation at a value's ends are not covered; widths are held between what the key's group allows; padding is added.  Without
    ``tuning`` the language's own pack applies.
    ``drop_oversize`` skips implausibly large boxes as the original did, which leaves them readable; by default they stay.
    """
    tuning = tuning or language_tuning(lang)
    factor, least, most, char = RECT_FONT
    page_w, page_h = F.col("viewport_width"), F.col("viewport_height")
    met = overlapping(spans, placed.where(F.coalesce("str", F.lit("")) != ""), ["doc_id", "page_number"], ("a", "b"), ("start", "end"), ITEM_BIN)
    # which part of the item is covered
    met = met.withColumn("lo", F.greatest("a", "start") - F.col("start")).withColumn("hi", F.least("b", "end") - F.col("start"))
    sub = F.substring("str", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    met = met.withColumn("bare", value_in(sub, tuning)).withColumn("rest", F.length(sub) - F.col("bare.skip")).withColumn("core", F.length("bare.value"))
    whole_key = F.col("key").isin(*tuning.whole) if tuning.whole else F.lit(False)
    first, last = F.col("hi") - F.col("rest"), F.col("hi") - F.col("rest") + F.col("core")
    if {"part_a", "part_b"} <= set(spans.columns):
        parted = F.col("part_a").isNotNull() & (~F.col("key").isin(*tuning.ignore_part) if tuning.ignore_part else F.lit(True))
        inside = lambda c: F.col("a") + F.col(c)
        first = F.when(parted, F.greatest(inside("part_a"), "start") - F.col("start")).otherwise(first)
        last = F.when(parted, F.least(inside("part_b"), "end") - F.col("start")).otherwise(last)
    met = met.withColumn("ends", F.struct(F.when(whole_key, 0).otherwise(first).alias("lo"), F.when(whole_key, F.col("n")).otherwise(last).alias("hi"))).withColumn("lo", F.col("ends.lo")).withColumn("hi", F.col("ends.hi")).where("hi > lo")
    # the item's box as the key's group allows it
    met = met.withColumn("group", _of_key({**tuning.groups, "manual_term": "manual_term"}, "default")).withColumn("font", _clamp(F.col("font") * factor, least, most))
    met = met.withColumn("est", F.greatest(F.lit(10.0), F.col("n") * F.col("font") * char))
    limit = lambda k: F.element_at(F.create_map(*[x for g, v in tuning.widths.items() for x in (F.lit(g), F.lit(v[k]))]), F.col("group"))
    given = F.coalesce("wide", "est")
    plausible = F.when(given > F.col("est") * limit(2), F.col("est") * limit(3)).otherwise(given)
    long = F.col("group") == "longValue"
    floor_ = F.least(F.col("est") * F.when(long, 0.92).otherwise(0.80), page_w * F.when(long, 0.38).otherwise(0.18))
    fitted = F.greatest(_clamp(plausible, 1, F.least(page_w * limit(0), F.col("est") * limit(1))), floor_)
    for key, (factor, page_most, est_most, est_least, page_least) in tuning.special.items():
        own = _clamp(plausible * factor, 1, F.least(page_w * page_most, F.col("est") * est_most))
        fitted = F.when(F.col("key") == key, F.greatest(own, F.least(F.col("est") * est_least, page_w * page_least))).otherwise(fitted)
    inset = lambda share: _clamp(F.col("font") * share, 2, 4)
    met = met.withColumn("bx", _clamp(F.col("left"), 0, page_w)).withColumn("bw", _clamp(fitted + 6, 1, page_w - F.col("bx")))
    met = met.withColumn("by", _clamp(F.col("base") - F.col("font") + inset(0.16), 0, page_h)).withColumn("bh", _clamp(F.col("font") - inset(0.14), 4, page_h - F.col("by")))
    # the covered share, padded
    whole = whole_key | (F.col("n") <= WHOLE_ITEM_LENGTH) | (F.col("hi") - F.col("lo") >= F.col("n") * tuning.cover)
    x1 = F.when(whole, F.col("bx")).otherwise(F.col("bx") + F.col("bw") * F.col("lo") / F.col("n"))
    x2 = F.when(whole, F.col("bx") + F.col("bw")).otherwise(F.col("bx") + F.col("bw") * F.col("hi") / F.col("n"))
    pad = lambda size, share, floor: F.greatest(_of_key(tuning.pads, tuning.pad, floor), F.col(size) * _of_key(tuning.pads, tuning.pad, share))
    met = met.withColumn("px", pad("bw", 0, 2)).withColumn("py", pad("bh", 1, 3)).withColumn("nudge", F.when(F.col("key").isin(*NAME_KEYS), _clamp(F.col("bw") * 0.04, 2, 4)).otherwise(0.0))
    met = met.withColumn("x", _clamp(x1 - F.col("px") - F.col("nudge"), 0, page_w)).withColumn("y", _clamp(F.col("by") - F.col("py") + 2 + tuning.down, 0, page_h))
    met = met.withColumn("w", _clamp(x2 - x1 + 2 * F.col("px") + F.col("nudge"), 1, page_w - F.col("x"))).withColumn("h", _clamp(F.col("bh") + 2 * F.col("py") - tuning.trim, 3, page_h - F.col("y")))
    if drop_oversize:
        cap = F.when(F.col("key").isin(*NAME_KEYS), F.least(page_w * 0.16, F.col("bw") * 0.90)).when(F.col("key") == "company", F.least(page_w * 0.40, F.col("bw") * 1.50)).when(F.col("key") == "manual_term", F.least(page_w * 0.45, F.col("bw") * 1.60)).otherwise(page_w)
        huge = (F.col("w") > page_w * 0.92) | (F.col("h") > page_h * 0.35) | ((F.col("w") > page_w * 0.85) & (F.col("h") > page_h * 0.20))
        met = met.where((F.col("w") <= cap) & ~huge)
    return met.select("doc_id", "page_number", "id", "key", "x", "y", "w", "h")


def with_manual(boxes: DataFrame, manual: DataFrame) -> DataFrame:
    """Boxes and a user's own (``doc_id, page_number, x, y, w, h``; dragged in any direction, at least 6 pixels each way), the latter with key ``manual_rect``."""
    ids = F.format_string("manual_%06d", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "y", "x", "w", "h")))
    upright = manual.select("doc_id", "page_number", *[F.least(F.col(a), F.col(a) + F.col(s)).cast("double").alias(a) for a, s in (("x", "w"), ("y", "h"))], *[F.abs(s).cast("double").alias(s) for s in ("w", "h")])
    kept = upright.where((F.col("w") >= LEAST_DRAG) & (F.col("h") >= LEAST_DRAG))
    return boxes.unionByName(kept.select("doc_id", "page_number", ids.alias("id"), F.lit("manual_rect").alias("key"), "x", "y", "w", "h"))


def _bounds(boxes: DataFrame, *keys: str) -> DataFrame:
    held = boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    return held.select(*keys, "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))


def collapsed(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """One bounding box for each hit of the listed keys; other boxes as they are."""
    chosen = F.col("key").isin(keys)
    return _bounds(boxes.where(chosen), "doc_id", "page_number", "id", "key").unionByName(boxes.where(~chosen).select("doc_id", "page_number", "id", "key", "x", "y", "w", "h"))


def numbered(boxes: DataFrame) -> DataFrame:
    """Adds ``rect_id`` in page order within a document."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "y", "x", "id")
    return boxes.withColumn("rect_id", F.format_string("rect_%06d", F.row_number().over(order)))


def audit(hits: DataFrame, boxes: DataFrame) -> DataFrame:
    """``doc_id, hits, mapped, unmapped, rects``: hits with and without a box."""
    each = hits.select("doc_id", "id").distinct().join(boxes.groupBy("doc_id", "id").agg(F.count("*").alias("n")), ["doc_id", "id"], "left")
    told = F.col("n").isNotNull().cast("long")
    return each.groupBy("doc_id").agg(F.count("*").alias("hits"), F.sum(told).alias("mapped"), F.sum(1 - told).alias("unmapped"), F.sum(F.coalesce("n", F.lit(0))).alias("rects"))
