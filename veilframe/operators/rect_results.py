"""From a match result to boxes in one call: pages located, hits clipped, boxes built, merged, numbered and accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tuning import BoxTuning, language_tuning
from . import geometry, pages

BOX = ["doc_id", "page_number", "id", "key", "x", "y", "w", "h"]


def match_rects(hits: DataFrame, paged: DataFrame, layout: DataFrame, lang: str = "", tuning: BoxTuning | None = None, given: DataFrame | None = None) -> DataFrame:
    """Boxes of hits on the raster, numbered in page order: ``doc_id, page_number, id, key, x, y, w, h, rect_id``.

    ``hits``: ``doc_id, id, key, start, end`` in the document's text, which is the pages' texts with two characters between.  ``paged``: ``doc_id, page_number, items`` (``str, transform, width``) and, if
    known, ``text``, the page's own text, onto which items are then laid.  ``layout``: the pages' sizes and transforms (:func:`.geometry.on_device`); a page without one has no boxes.  A hit over two pages
    has boxes on both.  ``given`` (``doc_id, page_number, id, key, x, y, w, h``): boxes that hits bring along, used for hits that get none on that page.
    """
    tuning = tuning or language_tuning(lang)
    built = geometry.item_ranges(F.col("items"))
    place = geometry.against_authority(built, F.col("text")) if "text" in paged.columns else built
    laid = paged.select("doc_id", "page_number", "items", place.alias("p"))
    text = laid.select("doc_id", "page_number", F.col("p.text").alias("text"))
    each = laid.select("doc_id", "page_number", "items", F.explode("p.ranges").alias("r"))
    items = each.select("doc_id", "page_number", "r.idx", "r.start", "r.end", F.get("items", F.col("r.idx")).alias("it")).select("doc_id", "page_number", "idx", "start", "end", "it.str", "it.transform", "it.width")
    local = geometry.localized(hits, pages.page_offsets(text))
    drawn = geometry.merged_rects(geometry.device_rects(local, geometry.on_device(items, layout), lang, tuning), tuning=tuning)
    boxes = geometry.collapsed(drawn, list(tuning.collapse)).select(BOX) if tuning.collapse else drawn.select(BOX)
    if given is not None:
        usable = given.where("w > 0 AND h > 0").select(BOX).join(local.select("doc_id", "page_number", "id").distinct(), ["doc_id", "page_number", "id"], "left_semi")
        boxes = boxes.unionByName(usable.join(boxes.select("doc_id", "page_number", "id").distinct(), ["doc_id", "page_number", "id"], "left_anti").select(BOX))
    return geometry.numbered(boxes)


def page_stats(hits: DataFrame, paged: DataFrame, boxes: DataFrame) -> DataFrame:
    """``doc_id, page_number, hits, mapped, rects`` of every page: hits that meet it, those of them with a box on any page, and its boxes.  ``paged``: ``doc_id, page_number, text``."""
    met = geometry.localized(hits, pages.page_offsets(paged.select("doc_id", "page_number", "text"))).select("doc_id", "page_number", "id").distinct()
    seen = boxes.select("doc_id", "id").distinct().withColumn("seen", F.lit(1))
    counted = met.join(seen, ["doc_id", "id"], "left").groupBy("doc_id", "page_number").agg(F.count("*").alias("hits"), F.count("seen").alias("mapped"))
    drawn = boxes.groupBy("doc_id", "page_number").agg(F.count("*").alias("rects"))
    every = paged.select("doc_id", "page_number").join(counted, ["doc_id", "page_number"], "left").join(drawn, ["doc_id", "page_number"], "left")
    return every.select("doc_id", "page_number", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hits", "mapped", "rects")])
